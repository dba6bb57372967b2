"""Small tables of literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str], types: list[str]) -> DataFrame:
    """A few rows as a native table."""
    made = [F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(r, names, types, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*made)))
