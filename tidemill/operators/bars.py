"""Ticks to bars, coarser bars, cleaning and coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import clock
from tidemill.operators import blocks

STALE_SECONDS = 5
# The flags of stored ticks.
FLAG_OK, FLAG_WIDE, FLAG_BAD, FLAG_GAP, FLAG_JUMP = range(5)


def bucket(ts: Column, seconds: int) -> Column:
    return clock.at_seconds(F.floor(clock.epoch(ts) / seconds) * seconds)


def ticks_to_bars(ticks: DataFrame, seconds: int, tie: str = "id") -> DataFrame:
    """Bid open, high, low, close, mean and last spread and number of ticks of every bucket that has ticks."""
    first, last = F.struct("ts", tie), F.struct("ts", tie)
    return (
        ticks.groupBy("symbol", bucket(F.col("ts"), seconds).alias("bar_ts"))
        .agg(
            F.min_by("bid", first).alias("open"),
            F.max("bid").alias("high"),
            F.min("bid").alias("low"),
            F.max_by("bid", last).alias("close"),
            F.avg(F.col("ask") - F.col("bid")).alias("spread_mean"),
            F.max_by(F.col("ask") - F.col("bid"), last).alias("spread_last"),
            F.count("*").alias("tick_count"),
        )
    )


def deals_to_bars(deals: DataFrame) -> DataFrame:
    """Day bars of deals: open, high, low, close, volume and number of deals."""
    return deals.groupBy("symbol", F.col("ts").alias("bar_ts")).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("volume").alias("volume"),
        F.count("*").alias("tick_count"),
    )


def resample(bars: DataFrame, label: Column, volume: str = "tick_count") -> DataFrame:
    """Coarser bars by a label of time; buckets without bars do not appear."""
    return bars.groupBy("symbol", label.alias("bucket_ts")).agg(
        F.min_by("open", "bar_ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "bar_ts").alias("close"),
        F.sum(volume).alias("volume"),
        F.count("*").alias("n_bars"),
    )


def week_label(ts: Column) -> Column:
    """Weeks from Monday to Sunday, named by that Sunday."""
    return F.next_day(F.date_sub(F.to_date(ts), 1), "Sun").cast("timestamp_ntz")


def bar_spacing(bars: DataFrame) -> DataFrame:
    """The most frequent distance of neighbouring bars in seconds; the smallest of equally frequent ones."""
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    gaps = bars.select("symbol", (clock.epoch(F.col("bar_ts")) - clock.epoch(F.lag("bar_ts").over(w))).alias("gap"))
    counted = gaps.where("gap > 0").groupBy("symbol", "gap").agg(F.count("*").alias("n"))
    return counted.groupBy("symbol").agg(F.min_by("gap", F.struct(-F.col("n"), "gap")).alias("spacing"))


def coverage(bars: DataFrame, minutes_per_bar: int) -> DataFrame:
    """Per symbol and month: bars, expected bars of open market, missing ones, first and last."""
    month = F.trunc(F.to_date("bar_ts"), "month")
    found = bars.groupBy("symbol", month.alias("month")).agg(
        F.count("*").alias("bar_count"), F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts")
    )
    found = found.withColumn("expected", F.floor(clock.expected_minutes(F.col("month")) / minutes_per_bar).cast("long"))
    return found.withColumn("gap_count", F.greatest(F.lit(0), F.col("expected") - F.col("bar_count")))


def missing_days(bars: DataFrame) -> DataFrame:
    """Days other than Saturdays between a symbol's first and last bar that have none."""
    span = bars.groupBy("symbol").agg(F.min(F.to_date("bar_ts")).alias("a"), F.max(F.to_date("bar_ts")).alias("b"))
    days = span.select("symbol", F.explode(F.sequence("a", "b")).alias("day")).where(F.weekday("day") != 5)
    return days.join(bars.select("symbol", F.to_date("bar_ts").alias("day")).distinct(), ["symbol", "day"], "left_anti")


def canonical(bars: DataFrame, by: list[str], ts: str, arrival: str) -> DataFrame:
    """One row per key and time: the one that arrived last."""
    w = Window.partitionBy(*by, ts).orderBy(F.col(arrival).desc())
    return bars.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


# The ticks before and behind one that its surroundings hold.
BEFORE, BEHIND = 500, 499


def surroundings(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and sample deviation of the BEFORE values before each, itself and the BEHIND values behind it; NaN values do not count."""
    middle = pd.Series(values).rolling(BEFORE + BEHIND + 1, center=True, min_periods=1).median().to_numpy()
    known = np.isfinite(values)
    shifted = np.where(known, values - (np.median(values[known]) if known.any() else 0.0), 0.0).astype(np.longdouble)
    at = np.arange(len(values))
    first, last = np.maximum(at - BEFORE, 0), np.minimum(at + BEHIND + 1, len(values))
    within = lambda x: (lambda c: c[last] - c[first])(np.concatenate([[0], np.cumsum(x)]))
    n, total, squares = within(known.astype(np.int64)), within(shifted), within(shifted * shifted)
    variance = np.maximum(squares - total * total / np.maximum(n, 1), 0) / np.maximum(n - 1, 1)
    return middle, np.where(n > 1, np.sqrt(variance.astype(float)), np.nan)


def _surrounded(block: pa.Table) -> pa.Table:
    """The own rows of a block with micros since the tick before, and the median and deviation of the mids around them."""
    block = block.sort_by("pos")
    middle, deviation = surroundings(block["mid"].to_numpy(zero_copy_only=False).astype(float))
    t = block["t"].to_numpy()
    gap = np.concatenate([[np.nan], np.diff(t).astype(float)]) if len(t) else t.astype(float)
    own = pa.array(~block["guest"].to_numpy(zero_copy_only=False))
    for name, made in (("gap", gap), ("middle", middle), ("deviation", deviation)):
        block = block.append_column(name, pa.array(made, from_pandas=True, type=pa.float64()))
    return block.drop_columns(["pos", "t", "block", "guest"]).filter(own)


def clean_ticks(ticks: DataFrame, wide: float = 10.0, sigmas: float = 5.0, tie: str = "id") -> DataFrame:
    """Flags per tick of a UTC day: a bad price; else a spread above ``wide`` times the median of the day's
    ticks that are not bad; else a gap of more than five seconds outside the weekend (Friday 22:00 to Sunday);
    else a mid further than ``sigmas`` deviations from the centred median of a thousand.

    Of ticks at one moment the last stays, after the median is taken. A symbol's day is cut into blocks of rows with
    guests on either side; a block's medians slide over its ordered array.
    """
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    bad = ~(finite("bid") & finite("ask") & (F.col("ask") >= F.col("bid")) & (F.col("ask") > 0) & (F.col("bid") > 0))
    spread = F.col("ask") - F.col("bid")
    told = ticks.withColumn("day", F.to_date("ts")).withColumn("bad", bad)
    middle = told.groupBy("symbol", "day").agg(F.percentile(F.when(~F.col("bad"), spread), 0.5).alias("mid_spread"))
    w_same = Window.partitionBy("symbol", "ts").orderBy(F.col(tie).desc())
    kept = told.withColumn("__n", F.row_number().over(w_same)).where("__n = 1").drop("__n")
    mid = (F.col("ask") + F.col("bid")) / 2
    kept = kept.select("id", "symbol", "day", "ts", "bid", "ask", "bad", F.when(finite("ask") & finite("bid"), mid).alias("mid"), clock.epoch_micros(F.col("ts")).alias("t"))
    spread_out = blocks.dealt(blocks.numbered(kept, ["symbol", "day"], "ts", bucket_seconds=3600), BEFORE, BEHIND)
    key, n = ["symbol", "day", "block"], int(ticks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = kept.drop("t").schema.add("gap", "double").add("middle", "double").add("deviation", "double")
    around = spread_out.repartition(n, *key).groupBy(*key).applyInArrow(_surrounded, made).join(middle, ["symbol", "day"])
    weekend = (F.weekday("ts") >= 5) | ((F.weekday("ts") == 4) & (F.hour("ts") >= 22))
    flag = (
        F.when(F.col("bad"), FLAG_BAD)
        .when(spread > wide * F.col("mid_spread"), FLAG_WIDE)
        .when((F.col("gap") > STALE_SECONDS * 1_000_000) & ~weekend, FLAG_GAP)
        .when(F.abs(F.col("mid") - F.col("middle")) > sigmas * F.col("deviation"), FLAG_JUMP)
        .otherwise(FLAG_OK)
    )
    return around.select("id", "symbol", "day", "ts", "bid", "ask", flag.alias("flag"))


def flag_counts(flagged: DataFrame) -> DataFrame:
    """Ticks of each flag per symbol and day, in one pass."""
    return flagged.groupBy("symbol", "day").agg(*[F.count_if(F.col("flag") == f).alias(f"flag_{f}") for f in range(5)], F.count("*").alias("n"))
