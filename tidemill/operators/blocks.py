"""A key's rows in order, cut into blocks of a fixed number of rows.

A window over a key's whole history is one task for each key. Here each row gets its place in the order from counts of
buckets of time, and places are dealt to blocks. A block is a window of its own; the rows before and after it that a
frame may look at come along as guests. Recursions carry their state from block to block by composing the blocks' maps.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemill.functions import clock

#: Rows of a block.
SIZE = 4096


def numbered(rows: DataFrame, by: list[str], ts: str, tie: list[str] | None = None, bucket_seconds: int = 86_400) -> DataFrame:
    """rows with ``pos``, the place of each in its key's order by ts (then tie), from 0.

    Rows are ordered within buckets of time; only the buckets' counts meet in one window for each key.
    """
    order = [ts, *(tie or [])]
    own = rows.withColumn("__bucket", F.floor(clock.epoch(F.col(ts)) / bucket_seconds))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    offsets = counts.select(*by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inner = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(*order))
    return own.withColumn("__k", inner).join(offsets, [*by, "__bucket"]).withColumn("pos", F.col("__offset") + F.col("__k") - 1).drop("__bucket", "__k", "__offset")


def dealt(placed: DataFrame, before: int, after: int, size: int | None = None) -> DataFrame:
    """Numbered rows with ``block`` and ``guest``: each row in its own block, and as a guest in the next or the last one if it
    lies within so many rows of the bound."""
    size = size or SIZE
    if before > size or after > size:
        raise ValueError("a frame may not be longer than a block")
    own, at = F.floor(F.col("pos") / size), F.col("pos") % size
    to = F.array_compact(F.array(own, F.when(at >= size - before, own + 1), F.when((at < after) & (own > 0), own - 1)))
    return placed.withColumn("block", F.explode(to)).withColumn("guest", F.col("block") != own)


def within(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by, "block").orderBy("pos")


def framed(rows: DataFrame, by: list[str], ts: str, before: int, after: int, made: dict[str, Column], size: int | None = None) -> DataFrame:
    """rows with ``pos`` and the columns of made: window expressions over within(by) that look at most so many rows back and on."""
    spread = dealt(numbered(rows, by, ts), before, after, size)
    return spread.withColumns(made).where(~F.col("guest")).drop("block", "guest")


def recursive_mean(rows: DataFrame, by: list[str], ts: str, value: str, n: int, weight: float, out: str, warm: str, size: int | None = None) -> DataFrame:
    """The keys, ts and out: x + weight * (value - x), started from the mean of the first n values.

    warm: what stands before the n-th value, ``null`` or ``mean`` (the running mean). A block's steps compose to one map
    x -> a * x + b; the maps of a key, one row for each block, are folded in order, and each block is replayed from the
    value that reaches it.
    """
    q, size = 1 - weight, size or SIZE
    if 0 < q < 1:
        size = min(size, int(400 / -log(q)))  # powers of q stay within a double
    if n > size:
        raise ValueError("the mean of the start must lie within a block")
    placed = numbered(rows.select(*by, ts, F.col(value).cast("double").alias("__v")), by, ts)
    placed = placed.withColumn("block", F.floor(F.col("pos") / size)).withColumn("__i", (F.col("pos") % size).cast("double"))
    past = within(by).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("__head", F.avg("__v").over(past))  # the running mean, as far as the first block goes
    step = F.when(F.col("pos") < n - 1, 0.0).when(F.col("pos") == n - 1, F.col("__head")).otherwise(F.lit(weight) * F.col("__v"))
    power = lambda e: F.pow(F.lit(q), e)
    local = power(F.col("__i")) * F.sum(step * power(-F.col("__i"))).over(past) if q > 0 else step
    placed = placed.withColumn("__local", local)
    maps = placed.groupBy(*by, "block").agg(power(F.count("*").cast("double")).alias("a"), F.max_by("__local", "pos").alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "a", "b")))
    start = F.struct(F.lit(0.0).alias("x"), F.array().cast("array<struct<block:bigint,carry:double>>").alias("made"))
    carried = F.aggregate(
        ordered, start,
        lambda s, m: F.struct((m["a"] * s["x"] + m["b"]).alias("x"), F.concat(s["made"], F.array(F.struct(m["block"].alias("block"), s["x"].alias("carry")))).alias("made")),
        lambda s: s["made"],
    )
    carries = maps.groupBy(*by).agg(carried.alias("c")).select(*by, F.inline("c"))
    met = placed.join(carries, [*by, "block"])
    x = F.col("__local") + power(F.col("__i") + 1) * F.col("carry")
    early = F.lit(None).cast("double") if warm == "null" else F.col("__head")
    return met.select(*by, ts, F.when(F.col("pos") < n - 1, early).otherwise(x).alias(out))
