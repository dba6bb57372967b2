"""As-of and range lookups on time.

Windows never span a key's whole history: rows are cut into buckets of time, each bucket is a window of its
own, and what lies before a bucket arrives as one carried row. A busy symbol is thereby spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.clock import epoch_micros

DAY = 86_400_000_000


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_ts: str,
    right_ts: str,
    take: list[str],
    tie: list[str] | None = None,
    bucket_micros: int = DAY,
) -> DataFrame:
    """left with ``take`` of the last right row of the same key at or before left_ts (nulls if none).

    Of several right rows at one moment the last by ``tie`` counts.
    """
    tie = tie or []
    bucket = lambda ts: F.floor(epoch_micros(F.col(ts)) / bucket_micros)
    picked = F.struct(F.col(right_ts).alias("__at"), *[F.col(c).alias(c) for c in tie if c not in take], *take)
    rows = right.where(F.col(right_ts).isNotNull()).select(*by, bucket(right_ts).alias("__b"), F.col(right_ts).alias("__t"), picked.alias("__r"), *[F.col(c).alias(f"__tie{i}") for i, c in enumerate(tie)])
    asked = left.withColumn("__b", bucket(left_ts))

    order = [F.col("__t"), *[F.col(f"__tie{i}") for i in range(len(tie))]]
    ends = rows.groupBy(*by, "__b").agg(F.max_by("__r", F.struct(*order)).alias("__end"))
    # one row for each key and bucket: the last right row before the bucket
    grid = ends.unionByName(asked.select(*by, "__b").distinct().withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType)))
    grid = grid.groupBy(*by, "__b").agg(F.first("__end", ignorenulls=True).alias("__end"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.withColumn("__carry", F.last("__end", ignorenulls=True).over(before)).select(*by, "__b", "__carry")

    columns = left.columns
    mixed = asked.select(
        *by, "__b", F.col(left_ts).alias("__t"), F.lit(1).alias("__side"),
        F.struct(*columns).alias("__l"), F.lit(None).cast(rows.schema["__r"].dataType).alias("__r"),
        *[F.lit(None).cast(rows.schema[f"__tie{i}"].dataType).alias(f"__tie{i}") for i in range(len(tie))],
    ).unionByName(
        rows.withColumn("__side", F.lit(0)).withColumn("__l", F.lit(None).cast(left.select(F.struct(*columns).alias("l")).schema["l"].dataType))
    )
    w = Window.partitionBy(*by, "__b").orderBy("__t", "__side", *order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    met = mixed.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    met = met.join(carried, [*by, "__b"], "left").withColumn("__m", F.coalesce("__m", "__carry"))
    return met.select("__l.*", *[F.col(f"__m.{c}").alias(f"asof_{c}" if c in columns else c) for c in take], F.col("__m.__at").alias("asof_ts"))


def asof_within(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, take: list[str], most_seconds: int, **more) -> DataFrame:
    """asof_backward whose matches count only if they are at most most_seconds old."""
    met = asof_backward(left, right, by, left_ts, right_ts, take, **more)
    fresh = epoch_micros(F.col(left_ts)) - epoch_micros(F.col("asof_ts")) <= most_seconds * 1_000_000
    found = [c for c in met.columns if c not in left.columns]
    return met.select(*left.columns, *[F.when(fresh, F.col(c)).alias(c) for c in found])


def count_between(times: DataFrame, asked: DataFrame, by: list[str], ts: str, start: Column, end: Column, closed: bool = True) -> DataFrame:
    """asked with ``n``: how many times of the key lie from start to end, through running counts.

    Two as-of lookups and a subtraction take the place of a range join.
    """
    w = Window.partitionBy(*by).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    steps = times.groupBy(*by, F.col(ts).alias("__at")).agg(F.count("*").alias("__k")).withColumn("__upto", F.sum("__k").over(w))
    marked = asked.withColumn("__id", F.monotonically_increasing_id()).withColumn("__start", start - F.expr("INTERVAL '0.000001' SECOND"))
    marked = marked.withColumn("__end", end if closed else end - F.expr("INTERVAL '0.000001' SECOND"))
    low = asof_backward(marked, steps, by, "__start", "__at", ["__upto"]).withColumnRenamed("__upto", "__low").drop("asof_ts")
    both = asof_backward(low, steps, by, "__end", "__at", ["__upto"])
    n = F.greatest(F.lit(0), F.coalesce("__upto", F.lit(0)) - F.coalesce("__low", F.lit(0)))
    return both.select(*asked.columns, n.alias("n"))
