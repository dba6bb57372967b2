"""Benchmark decontamination: a BM25 index of test items, asked by every passage of the corpus.

The inverted index holds the test items' words with BM25 impacts, scaled so that an item's own text scores 1.
Items are numbered in blocks; every word keeps, for each block in which it occurs, the largest impact there.
A passage (a window of words, half overlapping the next, at least twice as long as the longest item)
is a query. As in block-max WAND a passage without any essential word is passed over, a block is scored only
if the sum of its maxima reaches the threshold, and all items above the threshold are retrieved. Retrieved
items are then verified: enough of the word 5-grams of both the question (all but the last sentence) and the
answer (the last sentence) must stand in the passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import released

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.6
GRAM = 5
BLOCK_ITEMS = 8
#: One index holds so many items at most, and is broadcast; more items make more indexes and more passes.
ITEMS_PER_INDEX = 20_000
#: Indexes are built on the driver: test sets of more text than this are refused, not cut.
MOST_TEST_CHARS = 100_000_000
LEAST_STRIDE = 32
_SLICE = 64  # passages that are scored at once

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str], n: int = GRAM) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return set(zip(*[words[i:] for i in range(n)])) if n else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer; a single sentence is cut at two thirds of its words."""
    sentences = [w for s in _SENTENCE.split(text.strip()) if (w := words_of(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = math.ceil(len(words) * 2 / 3)
    return words[:cut], words[cut:] or words[-1:]


def overlap(part: list[str], there: list[str]) -> float:
    """The share of the part's word n-grams that stand in a passage."""
    own = grams(part)
    return len(own & grams(there, min(GRAM, len(part)))) / len(own) if own else 0.0


class ItemIndex:
    """Inverted index of test items with block maxima."""

    def __init__(self, items: list[tuple[int, str]], item_frequency: Counter, n_items: int, mean_words: float, threshold: float):
        self.threshold = threshold
        self.items = sorted((i, t) for i, t in items if words_of(t))
        self.parts = [question_and_answer(t) for _, t in self.items]
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        longest = 1
        for number, (_, text) in enumerate(self.items):
            tf = Counter(words_of(text))
            length = sum(tf.values())
            longest = max(longest, length)
            norm = K1 * (1 - B + B * length / mean_words)
            impact = {
                w: math.log(1 + (n_items - item_frequency[w] + 0.5) / (item_frequency[w] + 0.5)) * k * (K1 + 1) / (k + norm)
                for w, k in tf.items()
            }
            whole = sum(impact.values())
            for w, x in impact.items():
                postings[w].append((number, x / whole))
        self.stride = max(LEAST_STRIDE, longest)
        self.terms = {w: t for t, w in enumerate(sorted(postings))}
        self.blocks = (len(self.items) + BLOCK_ITEMS - 1) // BLOCK_ITEMS
        item_of, weight, block_of, maxima, starts = [], [], [], [], []
        item_ptr, block_ptr = [0], [0]
        for w in self.terms:
            last = -1
            for number, x in postings[w]:
                if number // BLOCK_ITEMS != last:
                    last = number // BLOCK_ITEMS
                    block_of.append(last)
                    maxima.append(0.0)
                    starts.append(len(item_of))
                maxima[-1] = max(maxima[-1], x)
                item_of.append(number)
                weight.append(x)
            item_ptr.append(len(item_of))
            block_ptr.append(len(block_of))
        self.item_of, self.weight = np.array(item_of, np.int64), np.array(weight)
        self.block_of, self.maxima = np.array(block_of, np.int64), np.array(maxima)
        self.starts = np.array([*starts, len(item_of)], np.int64)
        self.block_ptr = np.array(block_ptr, np.int64)
        # essential words: without any of them the others' maxima can't reach the threshold
        top = np.maximum.reduceat(self.maxima, self.block_ptr[:-1]) if len(self.terms) else np.zeros(0)
        order = np.argsort(top, kind="stable")
        self.essential = np.ones(len(top), bool)
        self.essential[order[np.cumsum(top[order]) < threshold]] = False

    def _spread(self, terms: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry of the terms' lists: the term's place in terms, and the entry's place."""
        size = ptr[terms + 1] - ptr[terms]
        owner = np.repeat(np.arange(len(terms)), size)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        return owner, ptr[terms][owner] + within

    def retrieve(self, terms: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, item number, score) of all that reach the threshold; terms: number or -1 of each word."""
        found: list[tuple[int, int, float]] = []
        at = np.flatnonzero(terms >= 0)
        if not len(at) or not self.blocks:
            return found
        size, known = len(self.terms), terms[at].astype(np.int64)
        own = at // self.stride
        # passage p holds the words of strides p and p + 1
        passage = np.concatenate((own, own - 1))
        known = np.concatenate((known, known))
        key = np.unique(passage[passage >= 0] * size + known[passage >= 0])
        passage, known = key // size, key % size
        wanted = np.unique(passage[self.essential[known]])
        items = len(self.items)
        for a in range(0, len(wanted), _SLICE):
            some = wanted[a : a + _SLICE]
            keep = slice(np.searchsorted(passage, some[0]), np.searchsorted(passage, some[-1], "right")) if len(wanted) > _SLICE else slice(None)
            row = np.searchsorted(some, passage[keep])
            asked = some[np.minimum(row, len(some) - 1)] == passage[keep]
            row, t = row[asked], known[keep][asked]
            owner, entry = self._spread(t, self.block_ptr)
            cell = row[owner] * self.blocks + self.block_of[entry]
            bound = np.bincount(cell, self.maxima[entry], len(some) * self.blocks)
            # only the blocks whose maxima can reach the threshold are scored
            hit = bound[cell] >= self.threshold - 1e-9
            owner, at = self._spread(entry[hit], self.starts)
            pair, place = np.unique((cell[hit] // self.blocks)[owner] * items + self.item_of[at], return_inverse=True)
            scores = np.bincount(place, self.weight[at], len(pair))
            for k in np.flatnonzero(scores >= self.threshold - 1e-9).tolist():
                found.append((int(some[pair[k] // items]), int(pair[k] % items), float(scores[k])))
        return found

    def leaks(self, text: str | None, least: float = OVERLAP) -> list[tuple[int, float, float, float]]:
        """(item id, score, question overlap, answer overlap) of the verified items in a whole text."""
        words = words_of(text) if text else []
        if not words or not self.items:
            return []
        terms = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        best: dict[int, tuple[int, float, float, float]] = {}
        for passage, number, score in self.retrieve(terms):
            there = words[passage * self.stride : (passage + 2) * self.stride]
            question, answer = self.parts[number]
            q, a = overlap(question, there), overlap(answer, there)
            item = self.items[number][0]
            if q >= least and a >= least and (score, q, a) > best.get(item, (item, 0.0, 0.0, 0.0))[1:]:
                best[item] = (item, score, q, a)
        return sorted(best.values())


def build_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD) -> list[ItemIndex]:
    """Indexes of all items, ITEMS_PER_INDEX in each; statistics cover all items.

    Items with a null id, a null text or no word are left out; items with equal ids count separately. More
    than MOST_TEST_CHARS characters of items end the call.
    """
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).dropna()
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if size > MOST_TEST_CHARS:
        raise ValueError(f"{size} characters of test items; the indexes are built for {MOST_TEST_CHARS} at most")
    frequency, n, total, items = Counter(), 0, 0, []
    for r in rows.orderBy("i", "t").toLocalIterator():  # test items, not the corpus
        words = words_of(r["t"])
        if words:
            frequency.update(set(words))
            n, total = n + 1, total + len(words)
            items.append((r["i"], r["t"]))
    return [
        ItemIndex(items[a : a + ITEMS_PER_INDEX], frequency, n, total / n, threshold) for a in range(0, len(items), ITEMS_PER_INDEX)
    ]


def _judge(shared):
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("item_id", "score", "question", "answer")
        for batch in texts:
            yield pd.Series([[dict(zip(names, x)) for x in shared.value.leaks(t)] for t in batch])

    return released(judge)


def with_leaks(docs: DataFrame, indexes: list[ItemIndex], text_col: str = "text", out_col: str = "leaks") -> DataFrame:
    """docs and the test items that stand in each whole text: array of item_id, score, question, answer.

    Null and empty texts have none. Each row is judged by its text alone; a column named out_col is replaced.
    """
    kind = "array<struct<item_id: bigint, score: double, question: double, answer: double>>"
    found = F.array().cast(kind)
    for index in indexes:
        found = F.concat(found, F.pandas_udf(_judge(docs.sparkSession.sparkContext.broadcast(index)), kind)(F.col(text_col)))
    return docs.select(*[c for c in docs.columns if c != out_col], found.alias(out_col))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row for each document and test item in it: id, item_id, score, question, answer. Clean documents have none."""
    found = with_leaks(docs.select(id_col, text_col), build_indexes(benchmark, threshold=threshold), text_col)
    return found.select(id_col, F.inline("leaks"))
