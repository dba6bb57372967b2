"""Toxicity: a linear-chain conditional random field tags toxic spans, and its marginals score whole documents.

Labels are given for documents, so tokens are labelled first: words and beginnings of words that stand in far more of
the toxic than of the clean sample texts (a likelihood ratio) are cues; in toxic texts the first cue of a run begins a
span and the next ones lie inside it, every other token and every token of a clean text is outside. The field is fitted
to these labelled tokens. It has features of the word, its beginnings, end and shape, and of the words on both
sides. Forward and backward sums over all words of a text give each word's probability of being part of a span;
their sum, maximum and density enter a logistic regression that is fitted on sample texts which the field has not seen
and weighted back to the shares of the classes. Words that are likelier inside than outside are the offending spans.

The sums over a chain are products of 3 x 3 matrices. They are taken for blocks of a chain side by side, then over the
blocks, then replayed inside them, so a chain of any length is exact; its memory is about 300 bytes a word.

At most SAMPLE_ROWS labelled texts of each class teach, drawn by a hash of their ids. Null and empty texts and texts
without words score as texts without a toxic word. Repeated rows are judged each; a labelled id with several rows is
toxic if one of them says so; null labels teach nothing. Without both classes, or without a cue, the score is the share
of toxic rows for every text, 0 if there are none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import free_name, only_ids, written

OUT, BEGIN, INSIDE = range(3)
FEATURES = 1 << 17
SAMPLE_ROWS = 3000
WINDOW = 16
MOST_WINDOWS = 30_000
MOST_CUES = 20_000
PREFIXES = (3, 4, 5, 6, 7)
_WORD = re.compile(r"\w{1,64}")
#: So many texts are cut into words at a time; their chains are summed for about so many words at a time.
_TEXTS = 64
_GROUP = 100_000
_CACHE = 400_000


def words_of(text: str | None) -> list[str]:
    """The words of a whole text; one of more than 64 characters counts as several."""
    return _WORD.findall(text or "")


def beginnings(word: str) -> list[str]:
    """What can be a cue: the lower-cased word and its beginnings."""
    w = word.lower()
    return ["=" + w, *("^" + w[:k] for k in PREFIXES if len(w) >= k)]


_DIGIT = re.compile(r"\d")
#: The first places are for what has few values: bias, case, length, digits.
_FEW = 64


def features(word: str) -> list[int]:
    """The active features of a word by itself; the last is the one that its neighbours see.

    Beginnings of two to seven bytes, ends of three and four and the lower-cased word are hashed, each kind from another start.
    """
    w = word.lower()
    case = 1 if word == w else 2 if word.isupper() else 3 if word[1:] == w[1:] else 4
    made = [0, case, 5 + min(len(w), 15)]
    if _DIGIT.search(w):
        made.append(21)
    data = w.encode("utf-8", "surrogatepass")
    size = len(data)
    crc = crc32(data[:2], 1)
    crcs = [crc]
    for k in range(2, min(size, PREFIXES[-1])):
        crc = crc32(data[k : k + 1], crc)
        crcs.append(crc)
    if size >= 3:
        crcs.append(crc32(data[-3:], 2))
        if size >= 4:
            crcs.append(crc32(data[-4:], 3))
    crcs.append(crc32(data, 4))
    made += [_FEW + c % (FEATURES - _FEW) for c in crcs]
    return made


class WordTable(dict):
    """Row numbers of words in an array of nine scores: of the word, for the word after it and for the one before it.

    It starts afresh when it has grown to _CACHE words, so its memory has a bound.
    """

    def __init__(self, model: ToxicModel) -> None:
        self.model, self.scores = model, np.zeros((0, 9), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self)
        if new:
            if len(self) + len(new) > _CACHE and len(self):
                self.clear()
                self.scores, new = self.scores[:0], set(words)
            made = [features(w) for w in new]
            flat, ends = np.fromiter((x for f in made for x in f), np.int64), np.cumsum([len(f) for f in made])
            own = np.add.reduceat(self.model.own[flat], np.concatenate([[0], ends[:-1]]), axis=0)
            near = flat[ends - 1]
            self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
            self.scores = np.vstack([self.scores, np.hstack([own, self.model.left[near], self.model.right[near]]).astype(np.float32)])
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _unit(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return x / x.max(axis=axes, keepdims=True)


def marginals(emit: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Tag probabilities of each word of chains laid end to end; first marks where a chain begins.

    A chain's first word is reached from OUT whatever lies before it, so its matrix has equal rows: no chain touches another.
    """
    n = len(emit)
    if not n:
        return np.zeros((0, 3))
    step, e = np.exp(move), np.exp(emit - emit.max(axis=1, keepdims=True))
    length = int(np.sqrt(n)) + 1
    blocks = -(-n // length)
    m = np.broadcast_to(np.eye(3), (blocks * length, 3, 3)).copy()
    m[:n] = step[None] * e[:, None, :]
    m[:n][first] = (step[OUT] * e[first])[:, None, :]
    m = m.reshape(blocks, length, 3, 3)
    whole = np.broadcast_to(np.eye(3), (blocks, 3, 3))
    for j in range(length):
        whole = _unit(whole @ m[:, j], (1, 2))
    before, after = np.ones((blocks, 3)), np.ones((blocks, 3))
    for k in range(1, blocks):
        before[k] = _unit(before[k - 1] @ whole[k - 1], (0,))
        after[-k - 1] = _unit(whole[-k] @ after[-k], (0,))
    forward, backward = np.empty((blocks, length, 3)), np.empty((blocks, length, 3))
    at = before[:, None, :]
    for j in range(length):
        at = _unit(at @ m[:, j], (2,))
        forward[:, j] = at[:, 0]
    at = after[:, :, None]
    for j in range(length - 1, -1, -1):
        backward[:, j] = at[:, :, 0]
        at = _unit(m[:, j] @ at, (1,))
    out = (forward * backward).reshape(-1, 3)[:n]
    return out / out.sum(axis=1, keepdims=True)


_BARRED = -30.0


@dataclass
class ToxicModel:
    """own, left and right: features x 3 tags; move: from row to column, INSIDE never follows OUT."""

    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    move: np.ndarray
    regression: np.ndarray = field(default_factory=lambda: np.zeros(4))
    constant: float | None = None

    def tagged(self, texts: list[list[str]], table: WordTable) -> Iterator[np.ndarray]:
        """For each text the probability of each of its words to be part of a span."""
        group: list[list[str]] = []
        for i, t in enumerate(texts):
            group.append(t)
            if i + 1 == len(texts) or sum(map(len, group)) >= _GROUP:
                yield from self._chains(group, table)
                group = []

    def _chains(self, group: list[list[str]], table: WordTable) -> Iterator[np.ndarray]:
        flat, sizes = [w for t in group for w in t], np.array([len(t) for t in group])
        rows = table.rows(flat)
        starts = np.cumsum(sizes) - sizes
        first = np.zeros(len(flat), bool)
        first[starts[sizes > 0]] = True
        p = 1 - marginals(emissions(table.scores[rows], first), first, self.move)[:, OUT]
        for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            yield p[a : a + n]

    def score(self, p: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(aggregates(p) @ self.regression, -30, 30))))


def emissions(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Scores of the three tags of each word: its own, and what the words before and after it add."""
    emit = scores[:, :3].astype(np.float64)
    inner = ~first[1:]
    emit[1:][inner] += scores[:-1, 3:6][inner]
    emit[:-1][inner] += scores[1:, 6:9][inner]
    return emit


#: Less likely words are left out of a text's sum: else a long clean text would add up to a toxic one.
LEAST_LIKELY = 0.1


def aggregates(p: np.ndarray) -> np.ndarray:
    total = float(p[p >= LEAST_LIKELY].sum())
    return np.array([1.0, np.log1p(total), float(p.max(initial=0.0)), np.sqrt(total / max(len(p), 1))])


def spans(text: str, p: np.ndarray) -> str:
    """start:end of the runs of words that are likelier in a span than not, in code points, comma-joined."""
    if not len(p) or p.max() < 0.5:
        return ""
    out: list[list[int]] = []
    running = False
    for m, x in zip(_WORD.finditer(text), p, strict=True):
        if x >= 0.5 and running:
            out[-1][1] = m.end()
        elif x >= 0.5:
            out.append([m.start(), m.end()])
        running = x >= 0.5
    return ",".join(f"{a}:{b}" for a, b in out)


def find_cues(sample: DataFrame, least: int = 3, ratio: float = 4.0, evidence: float = 15.0) -> set[str]:
    """Words and beginnings that stand in at least so many toxic texts, ratio times as often as in clean ones, with that much
    evidence (twice the logarithm of the likelihood ratio); at most MOST_CUES, the best first."""

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return set()

    def counts(label: int, asked: set[str] | None) -> dict[str, int]:
        """In how many texts of the class a beginning stands: those asked for, or those in at least texts."""
        shared = sample.sparkSession.sparkContext.broadcast(asked)

        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: Counter[str] = Counter()
            for batch in batches:
                for t in batch["text"]:
                    own = {b for w in set(words_of(t)) for b in beginnings(w)}
                    found.update(own if shared.value is None else own & shared.value)
            items = list(found.items())
            for i in range(0, len(items), 20_000):
                yield pd.DataFrame(items[i : i + 20_000], columns=["cue", "n"])

        rows = sample.where(F.col("label") == label).select("text").mapInPandas(counted, "cue string, n long")
        return {r["cue"]: r["n"] for r in rows.groupBy("cue").agg(F.sum("n").alias("n")).where(F.col("n") >= (least if asked is None else 1)).collect()}

    toxic = counts(1, None)
    clean = counts(0, set(toxic))
    share = lambda k, n: (k * log(k / n) if k else 0.0) + ((n - k) * log((n - k) / n) if n - k else 0.0)
    found = []
    for cue, t in toxic.items():
        c = clean.get(cue, 0)
        if t / n1 >= ratio * (c + 0.5) / (n0 + 1):
            g = 2 * (share(t, n1) + share(c, n0) - share(t + c, n0 + n1))
            if g >= evidence:
                found.append((-g, cue))
    return {cue for _, cue in sorted(found)[:MOST_CUES]}


def labelled_windows(text: str | None, toxic: int, cues: set[str]) -> Iterator[tuple[list[str], list[int]]]:
    """The text's words in windows, with tags; windows without a cue are taken where a hash says so, one in twenty."""
    words = words_of(text)
    known: dict[str, bool] = {}
    for a in range(0, len(words), WINDOW):
        own, tags, running = words[a : a + WINDOW], [], OUT
        hit = False
        for w in own:
            if w not in known:
                known[w] = not cues.isdisjoint(beginnings(w))
            hit |= known[w]
            running = OUT if not (toxic and known[w]) else INSIDE if running != OUT else BEGIN
            tags.append(running)
        if hit or crc32(" ".join(own).encode("utf-8", "surrogatepass")) % 20 == 0:
            yield own, tags


def fit_field(windows: list[tuple[list[str], list[int]]], rounds: int = 60, rate: float = 0.4, l2: float = 1e-5) -> ToxicModel:
    """Maximum likelihood by AdaGrad over all windows at once."""
    number = {w: i for i, w in enumerate(sorted({w for own, _ in windows for w in own}))}
    made = [features(w) for w in number]
    flat, owner = np.array([x for f in made for x in f]), np.repeat(np.arange(len(made)), [len(f) for f in made])
    near = np.array([f[-1] for f in made])
    ids = np.zeros((len(windows), WINDOW), np.int64)
    tags, real = np.zeros_like(ids), np.zeros((len(windows), WINDOW), bool)
    for r, (own, t) in enumerate(windows):
        ids[r, : len(own)], tags[r, : len(own)], real[r, : len(own)] = [number[w] for w in own], t, True
    both = real[:, 1:] & real[:, :-1]
    weights = [np.zeros((FEATURES, 3)) for _ in range(3)]
    squares = [np.full((FEATURES, 3), 1e-4) for _ in range(3)]
    move, move_sq, barred = np.zeros((3, 3)), np.full((3, 3), 1e-4), np.zeros((3, 3))
    barred[OUT, INSIDE] = _BARRED
    gold = np.eye(3)[tags] * real[:, :, None]
    n = real.sum()

    def spread(g: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(at, weights=g[:, c], minlength=size) for c in range(3)], axis=1)

    for _ in range(rounds):
        word = spread(weights[0][flat], owner, len(made))
        emit = word[ids]
        emit[:, 1:] += np.where(both[:, :, None], weights[1][near][ids[:, :-1]], 0)
        emit[:, :-1] += np.where(both[:, :, None], weights[2][near][ids[:, 1:]], 0)
        emit = np.where(real[:, :, None], emit, [0, _BARRED, _BARRED])
        m, e = np.exp(move + barred), np.exp(emit - emit.max(axis=2, keepdims=True))
        forward, backward = np.empty_like(e), np.ones_like(e)
        forward[:, 0] = _unit(m[OUT] * e[:, 0], (1,))
        for i in range(1, WINDOW):
            forward[:, i] = _unit((forward[:, i - 1] @ m) * e[:, i], (1,))
        for i in range(WINDOW - 2, -1, -1):
            backward[:, i] = _unit((e[:, i + 1] * backward[:, i + 1]) @ m.T, (1,))
        p = forward * backward
        p /= p.sum(axis=2, keepdims=True)
        g = np.where(real[:, :, None], p - gold, 0)
        pair = forward[:, :-1, :, None] * m * (e[:, 1:] * backward[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        g_move = (pair * both[:, :, None, None]).sum(axis=(0, 1)) - np.einsum("rip,riq->pq", gold[:, :-1] * both[:, :, None], gold[:, 1:] * both[:, :, None])
        g_move[OUT] += g[:, 0].sum(axis=0)
        by_word = spread(g.reshape(-1, 3), ids.ravel(), len(made))
        to_left = spread(np.where(both[:, :, None], g[:, 1:], 0).reshape(-1, 3), ids[:, :-1].ravel(), len(made))
        to_right = spread(np.where(both[:, :, None], g[:, :-1], 0).reshape(-1, 3), ids[:, 1:].ravel(), len(made))
        for k, gradient in enumerate((spread(by_word[owner], flat, FEATURES), spread(to_left, near, FEATURES), spread(to_right, near, FEATURES))):
            gradient = gradient / n + l2 * weights[k]
            squares[k] += gradient * gradient * n
            weights[k] -= rate * gradient * np.sqrt(n) / np.sqrt(squares[k])
        g_move = g_move / n
        move_sq += g_move * g_move * n
        move -= rate * g_move * np.sqrt(n) / np.sqrt(move_sq)
    return ToxicModel(*[w.astype(np.float32) for w in weights], move + barred)


def fit_regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps, each halved until the loss falls."""
    w = np.zeros(x.shape[1])
    loss = lambda v: float((weight * np.logaddexp(0, -(2 * y - 1) * (x @ v))).sum() / weight.sum() + ridge * (v[1:] @ v[1:]))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        keep = np.diag([0.0, *[2 * ridge] * (len(w) - 1)])
        g = x.T @ (weight * (p - y)) / weight.sum() + keep @ w
        h = (x * (weight * p * (1 - p) / weight.sum())[:, None]).T @ x + keep + 1e-9 * np.eye(len(w))
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicModel:
    """A model from docs whose ids have a label 0 or 1 in labels (with id_col and label_col)."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    marked = marked.groupBy("id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    none = np.zeros((FEATURES, 3), np.float32)
    constant = ToxicModel(none, none, none, np.zeros((3, 3)), constant=n1 / (n0 + n1) if n0 + n1 else 0.0)
    if not n0 or not n1:
        return constant
    draw = F.pmod(F.xxhash64("id", F.lit("toxic")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = F.when(F.col("label") == 1, min(1.0, sample_rows / n1)).otherwise(min(1.0, sample_rows / n0))
    drawn = marked.where(draw < share).select("id", "label", (F.pmod(F.xxhash64("id", F.lit("part")), F.lit(3)) == 2).alias("second"))
    # drawn holds about 2 * sample_rows rows, so it goes to the texts and no text is shuffled
    name = free_name("__id", docs.columns)
    texts = docs.select(F.col(id_col).alias(name), F.col(text_col).alias("text"))
    texts = only_ids(texts, drawn, name, "left_semi")
    sample = written(texts.join(F.broadcast(drawn), F.col(name) == F.col("id")).select("id", "text", "label", "second"), "toxic-sample", "zstd")
    cues = find_cues(sample.where("not second"))
    if not cues:
        return constant
    shared = docs.sparkSession.sparkContext.broadcast(cues)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [x for t, y in zip(batch["text"], batch["label"], strict=True) for x in labelled_windows(t, y, shared.value)]
            yield pd.DataFrame({"words": [w for w, _ in made], "tags": [t for _, t in made]})

    made = sample.where("not second").select("text", "label").mapInPandas(windows, "words array<string>, tags array<int>")
    taken = made.orderBy(F.xxhash64("words", "tags"), "words").limit(MOST_WINDOWS).collect()
    model = fit_field([(list(r["words"]), list(r["tags"])) for r in taken])
    known = judged(sample.where("second"), model, keep=["label"]).select("label", "aggregates").collect()
    y = np.array([r["label"] for r in known], float)
    if not 0 < y.sum() < len(y):
        return constant
    weight = np.where(y == 1, n1 / y.sum(), n0 / (len(y) - y.sum()))
    model.regression = fit_regression(np.array([r["aggregates"] for r in known]), y, weight)
    return model


def judged(docs: DataFrame, model: ToxicModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep of docs with score, spans (start:end in code points, ends exclusive) and aggregates of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = WordTable(shared.value)
        for texts in batches:
            out = []
            for i in range(0, len(texts), _TEXTS):
                group = texts.iloc[i : i + _TEXTS].tolist()
                for t, p in zip(group, shared.value.tagged([words_of(t) for t in group], table), strict=True):
                    out.append((shared.value.score(p), spans(t or "", p), aggregates(p).tolist()))
            yield pd.DataFrame(out, columns=["score", "spans", "aggregates"])

    name = free_name("__toxic", docs.columns)
    kind = "score double, spans string, aggregates array<double>"
    out = docs.select(*keep, F.pandas_udf(judge, kind)(F.col(text_col)).alias(name))
    return out.select(*keep, *[F.col(f"{name}.{c}").alias(c) for c in ("score", "spans", "aggregates")])
