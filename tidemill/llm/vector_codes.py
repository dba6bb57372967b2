"""Vector code compression: product codes from a Lloyd iteration that is kept up by deltas.

Vectors are cut into equal consecutive parts; each part position has a codebook of its own, and a vector becomes one entry
number a part. The table of vectors carries the numbers of the round before, and the sums and counts behind the codebooks
run on from round to round: a round sends plus and minus contributions of those parts alone whose number has changed,
summed in each task before they are shuffled. Every round's table is written in the shared folder, so a lost executor
costs no round that is done.

All arithmetic is on whole numbers. What reaches the driver are the codebooks and their sums (parts * entries * width
numbers, whatever the number of vectors).

Rows whose vector is null or holds a null, NaN or infinite component are left out. Repeated rows count each; rows
without an id are coded like others and come last in the order from which the codebooks start; equal ids are ordered by
their components. With fewer vectors than entries the codebooks are smaller. An empty table gives an empty result.
Vectors of differing lengths, of a length that the parts do not divide, or with components beyond 2**26 / scale
are refused with an error: they have no parts to compare, or no exact 64-bit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import joined_by, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 26


@dataclass
class Codebooks:
    """entries[p][e]: entry e of part p, whole numbers."""

    entries: np.ndarray

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry numbers (rows x parts; the lower of equally near ones) and squared distances summed over parts."""
        parts, _, width = self.entries.shape
        numbers, errors = np.zeros((len(vectors), parts), np.uint8), np.zeros(len(vectors), np.int64)
        # products and sums of whole numbers are exact in doubles below 2**53, and BLAS multiplies them
        top = max(int(np.abs(vectors).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        kind = np.float64 if 4 * top * top * width < 1 << 53 else np.int64
        for p in range(parts):
            x, c = vectors[:, p * width : (p + 1) * width].astype(kind), self.entries[p].astype(kind)
            far = (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
            best = far.argmin(axis=1)
            numbers[:, p] = best
            errors += (far[np.arange(len(x)), best] + (x * x).sum(axis=1)).astype(np.int64)
        return numbers, errors

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """id, label and whole (floor(scale * component)) of the rows that have a whole vector."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    number = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    small = lambda x: F.when(F.abs(number(x)) <= LARGEST, number(x)).otherwise(F.raise_error(F.lit("a component is too large to be coded")))
    return vectors.where(v.isNotNull() & fine).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(v, small).alias("whole"))


def _stacked(column: pd.Series, dims: int) -> np.ndarray:
    if any(len(x) != dims for x in column):
        raise ValueError(f"vectors of different lengths: {dims} and others")
    return np.vstack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, dims), np.int64)


def assigned(state: DataFrame, books: Codebooks) -> DataFrame:
    """state with each vector's entry numbers in now, those of the round before in before, and its error."""
    shared = state.sparkSession.sparkContext.broadcast(books)
    dims = books.entries.shape[0] * books.entries.shape[2]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers, errors = shared.value.nearest(_stacked(batch["whole"], dims))
            yield batch.assign(before=batch["now"], now=[n.tobytes() for n in numbers], error=errors)

    return state.mapInPandas(assign, state.schema)


def contributions(state: DataFrame, books: Codebooks) -> DataFrame:
    """part, entry, place and value: what entries gain and lose by the parts whose number has changed.

    Place -1 is the count, the others are components. Each task sends a row for each place of a changed entry at most.
    """
    parts, entries, width = books.entries.shape

    def changed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            x, now = _stacked(batch["whole"], parts * width), np.array([list(b) for b in batch["now"]], np.int64).reshape(-1, parts)
            new = batch["before"].isna().to_numpy()
            before = np.array([[-1] * parts if b is None else list(b) for b in batch["before"]], np.int64).reshape(-1, parts)
            for p in range(parts):
                own = np.hstack([np.ones((len(x), 1), np.int64), x[:, p * width : (p + 1) * width]])
                moved = now[:, p] != before[:, p]
                np.add.at(sums[p], now[moved, p], own[moved])
                gone = moved & ~new
                np.subtract.at(sums[p], before[gone, p], own[gone])
        p, e, i = np.nonzero(sums)
        yield pd.DataFrame({"part": p, "entry": e, "place": i - 1, "value": sums[p, e, i]})

    sent = state.select("whole", "before", "now").mapInPandas(changed, "part int, entry int, place int, value long")
    return sent.groupBy("part", "entry", "place").agg(F.sum("value").alias("value"))


def _start(whole: DataFrame, parts: int, entries: int) -> Codebooks | None:
    first = whole.orderBy(F.col("id").asc_nulls_last(), "whole").limit(entries).collect()
    if not first:
        return None
    dims = len(first[0]["whole"])
    if dims % parts or not dims:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    rows = _stacked(pd.Series([r["whole"] for r in first]), dims)
    return Codebooks(rows.reshape(len(rows), parts, dims // parts).transpose(1, 0, 2).copy())


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """id, label, code (two hexadecimal digits a part) and error of each whole vector; and the codebooks.

    The codebooks start as the parts of the vectors with the smallest ids. Each round assigns every part to its nearest
    entry and moves every entry that is used to the componentwise floor of its parts' mean; then all are assigned again.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries: from 1 to 256")
    state = whole_vectors(vectors, id_col, vector_col, label_col, scale)
    state = state.select("*", *[F.lit(None).cast("binary").alias(c) for c in ("before", "now")], F.lit(0).cast("long").alias("error"))
    state = written(state, "vectors")
    books = _start(state, parts, entries)
    if books is None:
        return state.select("id", "label", F.lit("").alias("code"), "error"), None
    sums = np.zeros((*books.entries.shape[:2], books.entries.shape[2] + 1), np.int64)
    for n in range(rounds):
        state = written(assigned(state, books), f"vectors-{n}")
        for r in contributions(state, books).collect():
            sums[r["part"], r["entry"], r["place"] + 1] += r["value"]
        used = sums[:, :, :1] > 0
        books = Codebooks(np.where(used, sums[:, :, 1:] // np.maximum(sums[:, :, :1], 1), books.entries))
    final = assigned(state, books).select("id", "label", F.lower(F.hex("now")).alias("code"), "error")
    return written(final, "vector-codes"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the errors summed over the rows of equal labels; rows without a label count together."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    return joined_by(codes, sums, "label")
