"""Secret scans by a linear-chain conditional random field.

Fixed patterns find assignments, access keys and long hexadecimal strings. A CRF adds what they miss: it tags
every token of every line as beginning, inside or outside a secret from its shape, the words beside it and
features of the whole text, and Viterbi decodes the best sequence of the whole line. It is trained here, on a
bounded sample of texts whose secrets the fixed patterns mark, by maximum likelihood (forward and backward sums).

That a token looks like a key (eight characters with a digit and a letter, or six behind a cue word) is a feature
and no more. Lines are decoded side by side; a token around which no stretch of other tags can outweigh outside parts
its line in two, which leaves the best path as it is.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import released

#: The fixed patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
# a maximal run is one match of HEX; shorter runs fail and can be passed over
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

OUT, BEGIN, INSIDE = range(3)
FEATURES = 1 << 13
LEAST_CHARS = 8
LEAST_CHARS_CUED = 6
CUE_REACH = 4
SAMPLE_TEXTS = 1500
#: Stretches of lines that teach, for each sampled text, the tokens of a stretch, and how much rarer than others one with a
#: secret is left out.
SAMPLE_RUNS, RUN_TOKENS, MARKED_FIRST = 4, 256, 20
#: Characters that are decoded at once (lines are never parted) and tokens whose scores a worker remembers.
SLICE_CHARS, REMEMBERED = 1 << 19, 200_000
#: Rows that a worker judges at once.
LOT_ROWS = 1000

_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+|[^\sA-Za-z0-9+/_.=-]")
#: Tokens and line ends; what lies between them is blank.
_PARTS = re.compile(r"([A-Za-z0-9+/_.=-]+|\n|[^\sA-Za-z0-9+/_.=-])")
_DIGITS = re.compile(r"[0-9]")
_CUE_WORDS = "pass|secret|token|key|auth|cred|pwd|bearer|private"
#: What holds a fixed span, near enough to draw texts by.
_MARKED = """(?i:(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?[A-Za-z0-9+/_.=-]{6})|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
_CUES = re.compile(_CUE_WORDS, re.I | re.A)
_LOWER, _UPPER, _NUMBERS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_SHAPES = str.maketrans(_LOWER + _UPPER + _NUMBERS, "a" * 26 + "A" * 26 + "9" * 10)
_SIGNS = re.compile("[0-9]|" + _CUE_WORDS, re.I | re.A)


def fixed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the fixed patterns find, by start, then kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _candidate(token: str) -> bool:
    return len(token) >= LEAST_CHARS and bool(_DIGITS.search(token)) and any(c.isalpha() for c in token)


def _shape(token: str) -> str:
    out = []
    for c in token[:64]:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:12])


@lru_cache(1 << 14)
def _place(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % FEATURES


def _places(names: list[str]) -> np.ndarray:
    """The places of many names."""
    raw = b"".join([hashlib.blake2b(n.encode("utf-8", "surrogatepass"), digest_size=4).digest() for n in names])
    return (np.frombuffer(raw, "<u4") % FEATURES).astype(np.int64)


def _own(t: str) -> list[str]:
    """Features of a token by itself."""
    shape = _shape(t)
    digits = sum(c.isdigit() for c in t) / len(t)
    return [
        "bias", "shape=" + shape[:6], f"length={min(len(t) // 4, 12)}", f"digits={int(digits * 5)}",
        f"changes={min(len(shape), 12)}", f"hex={bool(re.fullmatch('[0-9a-f]+|[0-9A-F]+', t))}",
        f"cased={t.islower() + 2 * t.isupper()}", f"own cue={bool(_CUES.search(t))}", f"joined={any(c in t for c in '=')}",
        "start=" + (t[:4] if t[:4].isupper() else ""), f"candidate={_candidate(t)}",
    ]


@lru_cache(1 << 14)
def _own_places(t: str) -> tuple[int, ...]:
    return tuple(_place(n) for n in _own(t))


def _forget_places() -> None:
    _place.cache_clear()
    _own_places.cache_clear()


def _left(before: str) -> str:
    return "left=" + (before.lower() if len(before) < 12 else _shape(before))


def _right(after: str) -> str:
    return "right=" + (after.lower() if len(after) < 3 else _shape(after)[:2])


def _cue(t: str) -> str:
    m = _CUES.search(t)
    return m[0].lower() if m else ""


def _first_cues(tokens: list[str]) -> Iterator[tuple[int, str]]:
    """The number and the cue word of each token that has one, found in all of them at once. A line end may only be a token by itself."""
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1)
    met = list(_CUES.finditer("\n".join(tokens)))
    numbers, first = np.unique(np.searchsorted(ends, [m.start() for m in met], "right"), return_index=True)
    yield from ((n, met[i][0].lower()) for n, i in zip(numbers.tolist(), first.tolist()))


def _alike(t: str) -> object:
    """What is equal for tokens that share their own features, but for the cue, and what they are to the token on their left."""
    if len(t) < 3 or not t.isascii():
        return t
    pattern = t.translate(_SHAPES)
    first = pattern[:4]
    return pattern, t[:4] if "A" in first and "a" not in first else "", not t.strip("0123456789abcdef") or not t.strip("0123456789ABCDEF")


def _cued(cue: str, t: str) -> list[str]:
    """The cue word before a token, by itself and with whether the token is long enough for a key."""
    return ["cue=" + cue, f"cued={bool(cue)} {len(t) >= LEAST_CHARS_CUED}"]


def features(tokens: list[str], at: int, file_marks: tuple[str, ...]) -> list[int]:
    """The active features of a token of a line."""
    t = tokens[at]
    before, after = tokens[at - 1] if at else "^", tokens[at + 1] if at + 1 < len(tokens) else "$"
    cue = next((c for x in tokens[max(0, at - CUE_REACH) : at] if (c := _cue(x))), "")
    names = [_left(before), _right(after), *_cued(cue, t), *("file=" + m for m in file_marks)]
    return [*_own_places(t), *(_place(n) for n in names)]


#: Where a token's features tell what stands before it.
_CONTEXT = [len(_own("x")), len(_own("x")) + 2, len(_own("x")) + 3]


def file_marks(text: str) -> tuple[str, ...]:
    """Features of the whole text."""
    marks = []
    if "AKIA" in text:
        marks.append("access")
    if "{" in text and "}" in text:
        marks.append("braces")
    if " | " in text:
        marks.append("table")
    return tuple(marks)


def candidate_runs(text: str) -> Iterator[tuple[list[str], list[tuple[int, int]], list[int]]]:
    """Stretches of a text's lines that have tokens which look like keys: tokens, their spans, and the numbers of those tokens.

    For looking at texts; the model tags every token, whether it is among these or not.
    """
    done = -1
    for m in _SIGNS.finditer(text):
        if m.start() < done:
            continue
        start = text.rfind("\n", 0, m.start()) + 1
        done = text.find("\n", m.start())
        done = len(text) if done < 0 else done
        yield from _pieces(text, start, done)


def _pieces(text: str, start: int, end: int) -> Iterator[tuple[list[str], list[tuple[int, int]], list[int]]]:
    """Candidates of a line with four tokens on either side; those that lie close share a piece."""
    found = [m for m in _TOKEN.finditer(text, start, end)]
    marked, cue = [], -CUE_REACH - 1
    for i, m in enumerate(found):
        if _candidate(m[0]) or i - cue <= CUE_REACH and len(m[0]) >= LEAST_CHARS_CUED:
            marked.append(i)
        if _CUES.search(m[0]):
            cue = i
    groups: list[list[int]] = []
    for i in marked:
        if groups and i - groups[-1][-1] <= 1:
            groups[-1].append(i)
        else:
            groups.append([i])
    for g in groups:
        a, b = max(0, g[0] - 5), min(len(found), g[-1] + 3)
        yield [m[0] for m in found[a:b]], [m.span() for m in found[a:b]], [i - a for i in g]


@dataclass
class SecretModel:
    emit: np.ndarray  # features x 3
    move: np.ndarray  # 3 x 3, from row to column; INSIDE never follows OUT

    def viterbi(self, emit: np.ndarray) -> list[int]:
        """Best tags of a line, or of what lies between two tokens that are outside."""
        return self.best_tags(emit, np.array([0]), np.array([len(emit)])).tolist()

    def best_tags(self, emit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Best tags of many runs of rows of emit, step by step side by side; the tokens on both sides of a run are outside."""
        tags, lengths = np.zeros(len(emit), dtype=np.int8), ends - starts
        longest = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[longest], lengths[longest]
        if not len(starts):
            return tags
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # runs that have a token at each step
        best, back = self.move[OUT] + emit[starts], []
        for step in range(1, lengths[0]):
            n = alive[step]
            paths = best[:n, :, None] + self.move
            back.append(paths.argmax(axis=1).astype(np.int8))
            best[:n] = paths.max(axis=1) + emit[starts[:n] + step]
        now = (best + self.move[:, OUT]).argmax(axis=1).astype(np.int8)
        for step in range(lengths[0] - 1, 0, -1):
            n = alive[step]
            tags[starts[:n] + step] = now[:n]
            now[:n] = back[step - 1][np.arange(n), now[:n]]
        tags[starts] = now
        return tags

    def decode(self, emit: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Best tags of lines that follow each other in emit; ends marks the line ends, which are no tokens.

        A stretch of other tags must score more than outside throughout it. A token of it gains at most its best other score over that
        of outside and the best move between other tags over that between two outside; entering and leaving the stretch adds a
        constant. Where no stretch around a token can gain, the token is outside. The largest gain around each token comes from
        running sums and their extremes; stretches across line ends only make it larger.
        """
        m = self.move
        step = m[1:, 1:].max() - m[OUT, OUT]
        border = m[OUT, 1:].max() + m[1:, OUT].max() - 2 * m[OUT, OUT] - step
        gain = np.where(ends, -1e3, emit[:, 1:].max(axis=1) - emit[:, OUT] + step)
        total = np.cumsum(gain)
        before = total - gain
        most = total - np.minimum.accumulate(before) + np.maximum.accumulate(total[::-1])[::-1] - before - gain
        sure = ends | (most + border < -1e-6)
        edge = np.diff(np.concatenate([[True], sure, [True]]).astype(np.int8))
        return self.best_tags(emit, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1))

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        return Tagger(self).spans([text])[0]


class Tagger:
    """A model with the scores of the tokens that it has met."""

    def __init__(self, model: SecretModel) -> None:
        self.model = model
        names = ["", *_CUE_WORDS.split("|")]
        self.cue_of = {c: i for i, c in enumerate(names)}
        short, long = "x" * (LEAST_CHARS_CUED - 1), "x" * LEAST_CHARS_CUED
        self.cue_score = np.array([[self._sum(_cued(c, t)) for c in names] for t in (short, long)])
        self._forget()

    def _sum(self, names: list[str]) -> np.ndarray:
        return self.model.emit[[_place(n) for n in names]].sum(axis=0)

    def _forget(self) -> None:
        # a line end: to its left stands a last token, to its right a first one
        self.known: dict[str, int] = {"\n": _place(_left("^"))}
        self.alike: dict[object, int] = {}
        self.kinds = np.concatenate([np.zeros(3), self._sum([_right("$")]), [0, 0]])[None, :]

    def _learn(self, tokens: list[str]) -> None:
        """Numbers tokens by what they share with others and the place of what they are to the token on their right.

        Tokens that are alike have the same score of their own, score as what stands on the right, cue, and whether they are long
        enough behind one: these are summed once for all of them."""
        cues, rows, numbers = dict(_first_cues(tokens)), [], []
        for n, t in enumerate(tokens):
            kind = (_alike(t), cues.get(n, ""))
            number = self.alike.get(kind)
            if number is None:
                number = self.alike[kind] = len(self.kinds) + len(rows)
                rows.append(np.concatenate([self._sum(_own(t)), self._sum([_right(t)]), [self.cue_of[kind[1]], len(t) >= LEAST_CHARS_CUED]]))
            numbers.append(number)
        if rows:
            self.kinds = np.concatenate([self.kinds, rows])
        self.known.update(zip(tokens, (np.array(numbers) * FEATURES + _places([_left(t) for t in tokens])).tolist(), strict=True))

    def _numbers(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self._forget()
        new = list(set(tokens).difference(self.known))
        if new:
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def scores(self, tokens: list[str], marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each token's three tags, and which tokens are line ends; the first and the last one are. marks: what the
        features of the whole text add to each token."""
        numbers = self._numbers(tokens)
        kinds, places = numbers // FEATURES, numbers % FEATURES
        ends = kinds == 0
        emit = self.kinds[:, :3][kinds] + marks
        emit[1:] += self.model.emit[places[:-1]]
        emit[:-1] += self.kinds[:, 3:6][kinds[1:]]
        cues, long = self.kinds[:, 6].astype(np.int8)[kinds], self.kinds[:, 7].astype(np.int8)[kinds]
        line, cue = np.cumsum(ends), np.zeros(len(tokens), dtype=np.int8)
        held = np.flatnonzero(cues)
        for back in range(CUE_REACH, 0, -1):  # the furthest cue word in reach counts
            at = held[held + back < len(tokens)] + back
            at = at[(cue[at] == 0) & (line[at] == line[at - back])]
            cue[at] = cues[at - back]
        return emit + self.cue_score[long, cue], ends

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """The model's spans of each whole text."""
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for lot in _slices(texts):
            self._tag(texts, lot, found)
        return found

    def _tag(self, texts: list[str], lot: list[tuple[int, int, int]], found: list[list[tuple[int, int, str]]]) -> None:
        tokens, pieces, counts, marks = ["\n"], [], [1], [np.zeros(3)]
        for n, a, b in lot:
            parts = _PARTS.split(texts[n][a:b])
            pieces.append(parts)
            tokens += parts[1::2]
            tokens.append("\n")
            counts.append(len(parts) // 2 + 1)
            marks.append(self._sum(["file=" + m for m in file_marks(texts[n])]))
        tags = self.model.decode(*self.scores(tokens, np.repeat(marks, counts, axis=0)))
        tagged, firsts, last = np.flatnonzero(tags), np.cumsum(counts), -1
        for i, which in zip(tagged.tolist(), (np.searchsorted(firsts, tagged, "right") - 1).tolist()):
            n, a, _ = lot[which]
            if which != last:
                ends, last = np.cumsum(np.fromiter(map(len, pieces[which]), dtype=np.int64, count=len(pieces[which]))) + a, which
            at = 2 * (i - firsts[which])
            held, start, end = found[n], int(ends[at]), int(ends[at + 1])
            if tags[i] == BEGIN:
                held.append((start, end, "crf"))
            else:
                held[-1] = (held[-1][0], end, "crf")


def _slices(texts: list[str]) -> Iterator[list[tuple[int, int, int]]]:
    """Lots of (number of a text, start, end), about SLICE_CHARS each, cut at line ends."""
    lot: list[tuple[int, int, int]] = []
    size = 0
    for n, text in enumerate(texts):
        a = 0
        while a < len(text):
            cut = text.find("\n", a + SLICE_CHARS - size) if len(text) - a > SLICE_CHARS - size else -1
            b = cut if cut >= 0 else len(text)
            lot.append((n, a, b))
            size, a = size + b - a, b + 1
            if size >= SLICE_CHARS:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


_BARRED = -1e4


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return top.squeeze(axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit_crf(runs: list[tuple[list[list[int]], list[int]]], epochs: int = 8, rate: float = 0.1, l2: float = 1e-4, lot: int = 64) -> SecretModel:
    """Maximum likelihood by Adam over lots of runs of (features of each token, tags), runs of like length together."""
    emit, move = np.zeros((FEATURES + 1, 3)), np.zeros((3, 3))  # the last row fills up and stays zero
    kept = [[np.zeros_like(w), np.zeros_like(w)] for w in (emit, move)]  # running means of the gradients and of their squares
    turns = 0
    barred = np.zeros((3, 3))
    barred[OUT, INSIDE] = _BARRED
    runs = sorted(runs, key=lambda r: len(r[1]))
    width = max(len(x) for rows, _ in runs for x in rows)
    lots = []
    for first in range(0, len(runs), lot):
        held = runs[first : first + lot]
        ids = np.full((len(held), len(held[-1][1]), width), FEATURES, dtype=np.int32 if FEATURES > 32767 else np.int16)
        tags = np.full(ids.shape[:2], -1, dtype=np.int8)
        for n, (rows, marked) in enumerate(held):
            tags[n, : len(marked)] = marked
            for i, x in enumerate(rows):
                ids[n, i, : len(x)] = x
        lots.append((ids, tags))
    order = np.random.default_rng(3)
    for _ in range(epochs):
        for k in order.permutation(len(lots)):
            ids, tags = lots[k]
            m, (n, steps) = move + barred, tags.shape
            real = tags >= 0
            e = emit[ids].sum(axis=2)
            forward, backward = np.zeros((n, steps, 3)), np.zeros((n, steps, 3))
            forward[:, 0] = m[OUT] + e[:, 0]
            for i in range(1, steps):
                forward[:, i] = np.where(real[:, i, None], _lse(forward[:, i - 1, :, None] + m, 1) + e[:, i], forward[:, i - 1])
            backward[:, -1] = m[:, OUT]
            for i in range(steps - 2, -1, -1):
                backward[:, i] = np.where(real[:, i + 1, None], _lse(m + (e[:, i + 1] + backward[:, i + 1])[:, None, :], 2), m[:, OUT])
            total = _lse(forward[:, -1] + m[:, OUT], 1)[:, None, None]
            g = np.exp(forward + backward - total) * real[:, :, None]
            last = real.sum(axis=1) - 1
            g_move, rows = np.zeros((3, 3)), np.arange(n)
            g_move[OUT] += g[:, 0].sum(axis=0)
            g_move[:, OUT] += g[rows, last].sum(axis=0)
            pairs = np.exp(forward[:, :-1, :, None] + m + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[..., None])
            g_move += (pairs * real[:, 1:, None, None]).sum(axis=(0, 1))
            np.subtract.at(g_move, (np.concatenate([np.full(n, OUT), tags[:, :-1][real[:, 1:]], tags[rows, last]]), np.concatenate([tags[:, 0], tags[:, 1:][real[:, 1:]], np.full(n, OUT)])), 1)
            held = np.nonzero(real)
            g[(*held, tags[held])] -= 1
            active = ids[held].ravel()
            g_emit = np.stack([np.bincount(active, np.repeat(g[held][:, t], width), FEATURES + 1) for t in range(3)], axis=1)
            g_emit += l2 * np.bincount(active, minlength=FEATURES + 1)[:, None] * emit
            g_emit[FEATURES] = 0
            turns += 1
            for weights, g, means in ((emit, g_emit, kept[0]), (move, g_move, kept[1])):
                means[0] += 0.1 * (g - means[0])
                means[1] += 0.01 * (g * g - means[1])
                weights -= rate * means[0] / (1 - 0.9**turns) / (np.sqrt(means[1] / (1 - 0.99**turns)) + 1e-4)
    return SecretModel(emit[:FEATURES], move + barred)


def _overlapping(spans: list[tuple[int, int, str]]) -> Callable[[int, int], tuple[int, int, str] | None]:
    """The first of spans, which are in order of their starts, that overlaps a stretch; found by binary search."""
    furthest = list(accumulate((s[1] for s in spans), max))

    def first(a: int, b: int) -> tuple[int, int, str] | None:
        i = bisect_right(furthest, a)
        return spans[i] if i < len(spans) and spans[i][0] < b else None

    return first


def _values(text: str) -> list[tuple[int, int, str]]:
    """What is secret in the fixed spans: the value of an assignment, all of the others."""
    whole = [s for s in fixed_spans(text) if s[2] != "assign"]
    return sorted(whole + [(*m.span(2), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6])


#: What stands before made-up keys, and what they are made of.
_PHRASES = ("{} ", "password is {} ", "Bearer {} ", "pwd={} ", "auth: {} ", "the key is {} ", "credentials {} ", "private key {} ", '"{}" ', "secret {} ")
_MADE_OF = (_LOWER + _NUMBERS, _UPPER + _NUMBERS, *3 * (_LOWER + _UPPER + _NUMBERS,), _LOWER + _UPPER + _NUMBERS + "+/", _LOWER + _UPPER + _NUMBERS + "-_.")
_PREFIXES = ("", "", "", "sk_", "ghp_", "xoxb-", "eyJ")


def planted(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with made-up keys of other shapes, behind other words, in the place of its fixed spans; and where they stand."""
    pick = random.Random(crc32(text.encode("utf-8", "surrogatepass")))
    out, keys, done, size = [], [], 0, 0
    for a, b, _ in fixed_spans(text):
        if a < done:
            continue
        key = pick.choice(_PREFIXES) + "".join(pick.choices(pick.choice(_MADE_OF), k=pick.randint(12, 44)))
        before, after = pick.choice(_PHRASES).split("{}")
        out += [text[done:a], before, key, after]
        at = size + a - done + len(before)
        keys.append((at, at + len(key), "crf"))
        size, done = at + len(key) + len(after), b
    return "".join([*out, text[done:]]), keys


def marked_runs(text: str, values: list[tuple[int, int, str]] | None = None) -> list[tuple[list[list[int]], list[int]]]:
    """The lines of a text, all tokens of each, with the tags that the fixed patterns (or the given spans) give."""
    secret = _overlapping(_values(text) if values is None else values)
    out, marks, start = [], file_marks(text), 0
    for line in text.split("\n"):
        found = list(_TOKEN.finditer(line))
        tokens, tags, inside = [m[0] for m in found], [], None
        for m in found:
            hit = secret(start + m.start(), start + m.end())
            tags.append(OUT if hit is None else INSIDE if hit == inside and tags and tags[-1] != OUT else BEGIN)
            inside = hit
        if found:
            out.append(([features(tokens, i, marks) for i in range(len(tokens))], tags))
        start += len(line) + 1
    return out


def _bare(rows: np.ndarray) -> np.ndarray:
    """A line's features without those that tell what stands before a token."""
    bare = rows.copy()
    bare[:, _CONTEXT] = FEATURES
    return bare


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_texts: int = SAMPLE_TEXTS) -> SecretModel:
    """A model from a sample, by hash of the text, of about sample_texts texts and as many with a fixed span, so far as there are such.

    Their lines teach whole, those of more than RUN_TOKENS tokens in stretches; of more than SAMPLE_RUNS * sample_texts a hash of
    what they hold picks, those with a secret first. These teach once more with made-up keys of other shapes, and once more without
    what stands before their tokens, so that a key is known by its shape as well. Without lines in the sample all weights are zero but for a bias towards outside.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    marked = F.coalesce(F.col("text").rlike(_MARKED), F.lit(False))
    counts = texts.agg(F.count("*").alias("n"), F.count_if(marked).alias("marked")).first()
    draw = F.pmod(F.xxhash64("text", F.lit("crf")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    below = lambda n: draw < F.lit(min(1.0, sample_texts / max(n, 1)))
    sample = texts.where("text is not null").where(below(counts["n"]) | below(counts["marked"]) & marked).distinct().repartition(32)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                other, keys = planted(text)
                lines = marked_runs(text) + [line for line in marked_runs(other, keys) if any(line[1])] if keys else marked_runs(text)
                made = [
                    (np.array(rows[i : i + RUN_TOKENS], dtype="<i2").tobytes(), bytes(tags[i : i + RUN_TOKENS]), any(tags[i : i + RUN_TOKENS]))
                    for rows, tags in lines for i in range(0, len(tags), RUN_TOKENS)
                ]
                yield pd.DataFrame(made, columns=["rows", "tags", "secret"])

    turn = F.pmod(F.xxhash64("rows", "tags"), F.lit(1_000_003)) * F.when(F.col("secret"), 1).otherwise(MARKED_FIRST)
    drawn = sample.mapInPandas(released(runs, _forget_places), "rows binary, tags binary, secret boolean").orderBy(turn, "rows", "tags").limit(SAMPLE_RUNS * sample_texts).collect()
    taken = sorted((bytes(r["rows"]), bytes(r["tags"])) for r in drawn)
    if not taken:
        empty = SecretModel(np.zeros((FEATURES, 3)), np.zeros((3, 3)))
        empty.emit[_place("bias"), [BEGIN, INSIDE]] = _BARRED
        empty.move[OUT, INSIDE] = _BARRED
        return empty
    lines = [(np.frombuffer(rows, dtype="<i2").reshape(len(tags), -1), list(tags)) for rows, tags in taken]
    return fit_crf(lines + [(_bare(rows), tags) for rows, tags in lines if any(tags)])


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_texts(texts: list[str], tagger: Tagger) -> Iterator[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """Of each text the fixed spans, and all spans: the fixed ones and those of the model that overlap none of them."""
    for text, tagged in zip(texts, tagger.spans(texts), strict=True):
        base = fixed_spans(text)
        taken = _overlapping(base)
        more = [s for s in tagged if taken(s[0], s[1]) is None]
        yield base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def scan_text(text: str | None, model: SecretModel) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The same for one text."""
    return next(scan_texts([text or ""], Tagger(model)))


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each span, or run of overlapping spans, replaced by the mark."""
    out, done = [], 0
    for a, b, _ in spans:
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join([*out, text[done:]])


def scan(docs: DataFrame, model: SecretModel, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans and redacted for each whole text.

    Null texts count as empty; their redacted text is null again. Offsets are code points, ends exclusive.
    Each row is judged by its text alone. Columns of docs with the names of the new ones are replaced;
    prefix is put before the new names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"]

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value)
        for batch in texts:
            for a in range(0, len(batch), LOT_ROWS):
                lot, rows = batch.iloc[a : a + LOT_ROWS], []
                for t, (base, every) in zip(lot, scan_texts([t or "" for t in lot], tagger), strict=True):
                    kinds = [s[2] for s in base]
                    rows.append(
                        (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every),
                         t if t is None or not every else redacted(t, every))
                    )
                yield pd.DataFrame(rows, columns=new)

    kind = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"
    rest = [c for c in docs.columns if c not in {prefix + n for n in new}]
    out = docs.select(*rest, F.pandas_udf(released(judge, _forget_places), kind)(F.col(text_col)).alias("__judged"))
    return out.select(*rest, *[F.col(f"__judged.{n}").alias(prefix + n) for n in new])
