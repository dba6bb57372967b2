"""Phrase collocations: merged count-min sketches, then exact counts of what may be frequent.

Every task adds the hashes of its word sequences to a count-min sketch of its own; sketches are merged by adding their
counters. A counter is never smaller than the count of any sequence that falls on it, so a sequence with one counter
below the least count is infrequent for sure and everything frequent survives. The second pass counts the survivors
exactly, by their texts: what the sketch lets through wrongly is dropped there. So the sketch's width decides how much
is counted, never the result.

Counters stop at the least count (all that is asked is whether it is reached), so they take four bits each where it is
at most 15. The width grows with the input, to MOST_BITS; merged sketches are a bit a counter, 2 * 2**27 bits or
32 MB at most, and only these reach the driver and go to all tasks. Beyond about 4 GB of text more and more infrequent
sequences are counted exactly, a cost in shuffled rows but not in results.

Texts are lower-cased (A-Z), split at ``. , ; : ! ?`` and line breaks into pieces, and those at blanks and tabs into
words. Null and empty texts have no words; a null language counts as und; repeated rows count each. Ties in the ranks are
settled by counts, then by the phrase's bytes. A task's memory follows its longest piece, not its longest text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import joined_by, written

ROWS = 2
LEAST_BITS, MOST_BITS = 16, 27
#: Phrases are counted in so many buckets at least, one for each 32 MB of text.
LEAST_BUCKETS = 48
SLICE = 1 << 16
_CUT = 1 << 19
#: So many stretches are counted together before their phrases leave a task.
_TOGETHER = 8
_BREAK = re.compile(rb"[.,;:!?\n-\r]")
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b" \t")] = 1
_KINDS[list(b".,;:!?\n\x0b\x0c\r")] = 2
_STEP = 0x9E3779B97F4A7C15
_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    up = np.full(size, _STEP, np.uint64)
    down = np.full(size, pow(_STEP, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=4096)
def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Words:
    """The words of a stretch of bytes that begins and ends at the bounds of pieces, with their hashes."""

    def __init__(self, data: bytes, seeds: np.ndarray, bounds: np.ndarray, offset: int, first: int) -> None:
        """seeds: a number for each text; bounds: the byte after which each text ends, counted from offset before data;
        first: the number of the first text."""
        self.data = data
        codes = np.frombuffer(data, np.uint8)
        kinds = _KINDS[codes]
        inside = np.zeros(len(codes) + 2, np.int8)
        inside[1:-1] = kinds == 0
        turns = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = turns[0::2], turns[1::2]
        size = 1 << max(12, (len(codes) - 1).bit_length())
        up, down = _powers(size)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_byte_values()[codes] * up[: len(codes)], out=sums[1:])
        own = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        text = np.searchsorted(bounds, self.starts + offset, side="right")
        self.text = text + first
        self.piece = np.cumsum(kinds == 2, dtype=np.int32)[self.starts]
        self.hashes = _mixed(own ^ seeds[text])

    def sequences(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each number of words up to most: the first words of the sequences within pieces, and their hashes."""
        at, h = np.arange(len(self.hashes)), self.hashes
        yield 1, at, h
        for m in range(2, most + 1):
            whole = at + m - 1 < len(self.hashes)
            at, h = at[whole], h[whole]
            whole = self.piece[at] == self.piece[at + m - 1]
            at = at[whole]
            h = _mixed(h[whole] * np.uint64(_STEP) + self.hashes[at + m - 1])
            yield m, at, h

    def phrase(self, first: int, words: int) -> bytes:
        return b" ".join(self.data[self.starts[i] : self.ends[i]] for i in range(first, first + words))


def stretches(texts: list[str | None], langs: list[str]) -> Iterator[Words]:
    """The words of whole texts in stretches of about _CUT bytes: short texts together, long ones cut at the bounds of pieces."""
    own: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        own.append((t or "").encode("utf-8", "surrogatepass").lower())
        size += len(own[-1]) + 1
        if size >= _CUT or i + 1 == len(texts):
            data, done = b"\n".join(own), 0
            bounds = np.cumsum([len(p) + 1 for p in own])
            seeds = np.array([_seed(x) for x in langs[first : i + 1]], np.uint64)
            while done < len(data):
                found = _BREAK.search(data, min(done + 2 * _CUT, len(data)))
                end = found.end() if found else len(data)
                yield Words(data[done:end], seeds, bounds, done, first)
                done = end
            own, first, size = [], i + 1, 0


def places(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes * _ODD[row]) >> np.uint64(64 - bits)).astype(np.uint32)


class Sketch:
    """A count-min sketch whose counters stop at cap."""

    def __init__(self, bits: int, cap: int) -> None:
        self.bits, self.cap = bits, cap
        self.counters = np.zeros((ROWS, 1 << bits), np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for row in range(ROWS):
            at = np.sort(places(hashes, row, self.bits))
            if len(at):
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                n = np.diff(np.append(first, len(at)))
                own = at[first]
                self.counters[row, own] = np.minimum(self.counters[row, own] + n, self.cap)

    def slices(self) -> pd.DataFrame:
        """row, slice and counters of each slice that is not empty."""
        size = min(SLICE, 1 << self.bits)
        out = []
        for row in range(ROWS):
            for i, x in enumerate(self.counters[row].reshape(-1, size)):
                if x.any():
                    out.append((row, i, zlib.compress((x[0::2] | x[1::2] << 4 if self.cap < 16 else x).tobytes(), 1)))
        return pd.DataFrame(out, columns=["row", "slice", "counters"])


def _unpacked(counters: bytes, cap: int) -> np.ndarray:
    x = np.frombuffer(zlib.decompress(counters), np.uint8)
    return np.stack([x & 15, x >> 4], axis=1).ravel() if cap < 16 else x


def merged(sketches: DataFrame, cap: int) -> DataFrame:
    """row, slice and bits: which counters reach cap in the sum of all sketches.

    A slice's parts arrive in a row and are added one by one, so a task holds one slice, however many there are.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        done = lambda: pd.DataFrame([(*key, np.packbits(total >= cap).tobytes())], columns=["row", "slice", "bits"])
        for batch in batches:
            for row, number, counters in batch.itertuples(index=False):
                x = _unpacked(counters, cap)
                if key == (row, number):
                    total = np.minimum(total + x.astype(np.int16), cap)
                else:
                    if key is not None:
                        yield done()
                    key, total = (row, number), x.astype(np.int16)
        if key is not None:
            yield done()

    return sketches.repartition("row", "slice").sortWithinPartitions("row", "slice").mapInPandas(add, "row int, slice int, bits binary")


def frequent_bits(docs: DataFrame, max_words: int, least: int, bits: int) -> np.ndarray:
    """The merged sketch of all word sequences: for each row and counter a bit that says whether it reaches least."""
    cap = min(least, 255)

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = Sketch(bits, cap)
        for batch in batches:
            for words in stretches(batch["text"].tolist(), batch["lang"].tolist()):
                for _, _, h in words.sequences(max_words):
                    sketch.add(h)
        yield sketch.slices()

    found = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    size = min(SLICE, 1 << bits) // 8
    for r in merged(docs.mapInPandas(sketched, "row int, slice int, counters binary"), cap).toLocalIterator():
        found[r["row"], r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return found


def survivors(words: Words, max_words: int, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Like sequences, without those that the sketch shows to be infrequent or that hold a shorter one of that kind."""
    width = (bits.shape[1] * 8 - 1).bit_length()
    alive = np.ones(len(words.hashes) + 1, bool)
    for m, at, h in words.sequences(max_words):
        kept = alive[at] & alive[at + (m > 1)]
        at, h = at[kept], h[kept]
        for row in range(ROWS):
            p = places(h, row, width)
            kept = (bits[row][p >> 3] << (p & 7).astype(np.uint8)) & 128 != 0
            at, h = at[kept], h[kept]
        yield m, at, h
        alive[:] = False
        alive[at] = True


def packed(group: list[Words], langs: np.ndarray, max_words: int, bits: np.ndarray, buckets: int) -> pd.DataFrame:
    """bucket, lang, phrases and counts: the survivors of some stretches, summed, sorted and packed by bucket and language."""
    found: dict[tuple[int, str], dict[bytes, int]] = {}
    for lang, n in pd.Series(langs[np.concatenate([w.text for w in group])]).value_counts().items():
        found[0, lang] = {b"": n}  # all words of the language
    for same in zip(*[survivors(w, max_words, bits) for w in group], strict=True):
        m, at, h = same[0][0], np.concatenate([x[1] for x in same]), np.concatenate([x[2] for x in same])
        owner = np.repeat(np.arange(len(group)), [len(x[1]) for x in same])
        _, first, n = np.unique(h, return_index=True, return_counts=True)
        rows = zip(owner[first].tolist(), at[first].tolist(), n.tolist(), (h[first] % np.uint64(buckets)).tolist(), strict=True)
        for g, i, k, bucket in rows:
            w = group[g]
            own = found.setdefault((bucket, langs[w.text[i]]), {})
            phrase = w.phrase(i, m)
            own[phrase] = own.get(phrase, 0) + k
    out = []
    for (bucket, lang), own in found.items():
        phrases = sorted(own)
        counts = np.array([own[x] for x in phrases], "<u8").tobytes()
        out.append((bucket, lang, zlib.compress(b"\n".join(phrases), 6), zlib.compress(counts, 1)))
    return pd.DataFrame(out, columns=["bucket", "lang", "phrases", "counts"])


def phrase_counts(docs: DataFrame, max_words: int, least: int, bits: np.ndarray, buckets: int = LEAST_BUCKETS) -> DataFrame:
    """lang, words, phrase and n of every sequence of up to max_words words that occurs least times or more, exactly;
    and for each language a row of no words with the number of all words.

    Phrases are dealt to buckets by their hash. They travel in sorted packs, a few bytes each; a task adds up the packs of one
    bucket and language after another. A frequent phrase is in as many packs as there are tasks, at most one of each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, group = batch["lang"].to_numpy(object), []
            for words in stretches(batch["text"].tolist(), langs.tolist()):
                group.append(words)
                if len(group) == _TOGETHER:
                    yield packed(group, langs, max_words, shared.value, buckets)
                    group = []
            if group:
                yield packed(group, langs, max_words, shared.value, buckets)

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple[int, str] | None = None
        total: dict[bytes, int] = {}

        def done() -> pd.DataFrame:
            rows = [(key[1], x.count(b" ") + 1 if x else 0, x.decode("utf-8", "surrogatepass"), n) for x, n in total.items() if n >= least or not x]
            return pd.DataFrame(rows, columns=["lang", "words", "phrase", "n"])

        for batch in batches:
            for bucket, lang, phrases, counts in batch.itertuples(index=False):
                if key != (bucket, lang):
                    if key is not None:
                        yield done()
                    key, total = (bucket, lang), {}
                own = np.frombuffer(zlib.decompress(counts), "<u8").tolist()
                for x, n in zip(zlib.decompress(phrases).split(b"\n"), own, strict=True):
                    total[x] = total.get(x, 0) + n
        if key is not None:
            yield done()

    packs = docs.mapInPandas(sent, "bucket int, lang string, phrases binary, counts binary")
    return packs.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInPandas(added, "lang string, words int, phrase string, n long")


def _with_count(rows: DataFrame, part: str, out: str, hot: DataFrame, cold: DataFrame) -> DataFrame:
    """rows with the count of their part. Parts that are hot meet a broadcast; each of their rows goes through the
    shuffled join by a key of its own that meets nothing, so tasks share them."""
    hot = hot.select(F.col("lang").alias("hot_lang"), F.col("phrase").alias("hot_part"), F.col("n").alias("hot_n"))
    rows = rows.join(F.broadcast(hot), (F.col("lang") == F.col("hot_lang")) & (F.col(part) == F.col("hot_part")), "left")
    # no part begins with a blank
    key = F.when(F.col("hot_n").isNull(), F.col(part)).otherwise(F.concat(F.lit(" "), "phrase"))
    cold = cold.select("lang", F.col("phrase").alias("key"), F.col("n").alias("cold_n"))
    joined = rows.withColumn("key", key).join(cold, ["lang", "key"], "left")
    return joined.withColumn(out, F.coalesce("hot_n", "cold_n")).drop("hot_lang", "hot_part", "hot_n", "key", "cold_n")


#: The parts that are broadcast hold at least one in so many of all counted occurrences, so there are as many at most.
MOST_HOT = 10_000


def _joined_words(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, words, phrase, a, k, l, r and score of each phrase of two words or more, by its lowest-scoring cut.

    A part of a candidate occurs at least as often, so its count is among counts. Scores are exact: decimals of 38 digits.
    """
    total = counts.where("words > 0").agg(F.sum("n")).first()[0] or 0
    least_hot = max(1000, -(-total // MOST_HOT))
    parts = counts.where("words > 0")
    hot, cold = parts.where(F.col("n") >= least_hot), parts.where(F.col("n") < least_hot)
    cuts = counts.where("words > 1").withColumn("ws", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select(
        "lang", "words", "phrase", F.col("n").alias("a"), "k",
        _joined_words(F.col("ws"), F.lit(1), F.col("k")).alias("left"),
        _joined_words(F.col("ws"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"),
    )
    cuts = _with_count(_with_count(cuts, "left", "l", hot, cold), "right", "r", hot, cold)
    a, b, c = (F.col(x).cast("decimal(19,0)") for x in ("a", "l", "r"))
    score = F.expr("{0} div {1}".format("a2", "lr"))
    cuts = cuts.withColumns({"a2": a * a * F.lit(1_000_000).cast("decimal(7,0)"), "lr": b * c}).withColumn("score", score.cast("long"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "words", "phrase", "a").agg(lowest).select("lang", "words", "phrase", "a", "cut.k", "cut.l", "cut.r", "cut.score")


def not_inside(phrases: DataFrame, percent: int = 50) -> DataFrame:
    """phrases without those that lie in a longer one which occurs in at least so many percent of their places."""
    longer = phrases.where("words > 2").withColumn("ws", F.split("phrase", " "))
    longer = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = longer.select("lang", _joined_words(F.col("ws"), F.col("at"), F.col("size")).alias("phrase"), F.col("a").alias("within"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("within").alias("within"))
    kept = phrases.join(inner, ["lang", "phrase"], "left")
    return kept.where(F.col("within").isNull() | (100 * F.col("within") < percent * F.col("a"))).drop("within")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_words: int = 3,
    least: int = 10,
    top: int = 2000,
    percent: int = 50,
    bits: int | None = None,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's best phrases of two to max_words words.

    bits: the sketch has 2**bits counters a row; by default one for each 32 bytes of text, within bounds.
    """
    plain = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if bits is None:
        bits = min(max((size // 32).bit_length(), LEAST_BITS), MOST_BITS)
    buckets = max(LEAST_BUCKETS, size >> 25)
    counts = written(phrase_counts(plain, max_words, least, frequent_bits(plain, max_words, least, bits), buckets), "phrase-counts")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = not_inside(scored(counts), percent).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    words = counts.where("words = 0").select("lang", "n")
    return joined_by(ranked, words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
