"""What a calendar's reader asks for: named conditions, search, and rows as they stood at a moment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import is_provisional

#: Named conditions on releases with release_ts, scheduled_ts, reference_period, cross_source,
#: forecast_provenance, actual, mapping_status, vol_check and confounded.
CONDITIONS = {
    "anchorable": lambda: F.coalesce("release_ts", "scheduled_ts").isNotNull(),
    "period_only": lambda: F.coalesce("release_ts", "scheduled_ts").isNull(),
    "provisional": lambda: is_provisional(F.col("reference_period")),
    "disagree": lambda: F.col("cross_source") == "disagree",
    "point_in_time": lambda: F.col("forecast_provenance") == "point_in_time",
    "has_actual": lambda: F.col("actual").isNotNull(),
    "no_actual": lambda: F.col("actual").isNull(),
    "unmapped": lambda: F.col("mapping_status") == "unmapped",
    "unchecked": lambda: F.col("vol_check").isNull() | (F.col("vol_check") == "unchecked"),
    "confounded": lambda: F.col("vol_check") == "confounded",
}


def search(releases: DataFrame, words: str | None = None, fields: tuple[str, ...] = ("name",), quality: str | None = None, **equal) -> DataFrame:
    """Rows that hold the words in any of the fields, case aside, meet the condition and the equalities."""
    out = releases
    if words:
        out = out.where(reduce(Column.__or__, [F.lower(F.col(c)).contains(words.lower()) for c in fields]))
    if quality:
        out = out.where(CONDITIONS[quality]())
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out


def page(rows: DataFrame, order: str, key: str, number: int, size: int = 50, descending: bool = True, sorts: tuple[str, ...] = ()) -> DataFrame:
    """One page of rows in a stable order, nulls last either way. sorts: the columns that may be asked for; any other orders by the first."""
    order = order if not sorts or order in sorts else sorts[0]
    by = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    return rows.orderBy(by, key).offset(size * (number - 1)).limit(size)


def visible_at(releases: DataFrame, clock: str) -> DataFrame:
    """Rows as a replay may show them at a moment: the actual is hidden until its release."""
    seen = F.col("ts") <= F.lit(clock).cast("timestamp_ntz")
    surprise = F.col("actual").cast("double") - F.col("forecast")
    word = F.when(surprise > 0, "above").when(surprise < 0, "below").when(surprise == 0, "as forecast")
    return releases.select("indicator", "ts", "forecast", "previous", F.when(seen, F.col("actual")).alias("actual"), F.when(seen, surprise).alias("surprise"), F.when(seen, word).alias("reading"))


def with_history(releases: DataFrame, n: int = 8) -> DataFrame:
    """Each release with how many others share its moment, and the n values before it, newest first."""
    together = releases.groupBy("ts").agg((F.count("*") - 1).alias("siblings"))
    before = Window.partitionBy("indicator").orderBy("ts").rowsBetween(-n, -1)
    past = F.reverse(F.collect_list(F.round("actual", 0).cast("long").cast("string")).over(before))
    return releases.withColumn("last_values", F.array_join(past, ",")).join(together, "ts").select("indicator", "ts", "siblings", "last_values")
