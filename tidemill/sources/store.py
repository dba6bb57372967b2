"""Bar and tick stores: Parquet by symbol, source, timeframe and month, written so that a repeat changes nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR = "symbol string, source string, timeframe string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double, spread_mean double, tick_count long"
PARTS = ["symbol", "source", "timeframe", "month"]
KEPT_FLAGS = (0, 3)


def canonical_bars(frame: DataFrame) -> DataFrame:
    """The store's columns in order; missing ones are null; of equal keys the last arrival (``arrival``) stays."""
    fields = [c.split() for c in BAR.split(", ")]
    full = frame.select(*[(F.col(n) if n in frame.columns else F.lit(None)).cast(t).alias(n) for n, t in fields], (F.col("arrival") if "arrival" in frame.columns else F.lit(0)).alias("arrival"))
    w = Window.partitionBy("symbol", "source", "timeframe", "bar_ts").orderBy(F.col("arrival").desc())
    return full.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "arrival").withColumn("month", F.date_format("bar_ts", "yyyy-MM"))


def upsert_months(spark: SparkSession, path: str, frame: DataFrame) -> None:
    """Merges bars into their months, the new ones winning, and replaces those months alone."""
    new = canonical_bars(frame).withColumn("arrival", F.lit(1))
    touched = new.select(*PARTS).distinct()
    try:
        old = spark.read.schema(new.drop("arrival").schema).parquet(path).withColumn("arrival", F.lit(0)).join(F.broadcast(touched), PARTS, "left_semi")
        merged = canonical_bars(old.unionByName(new))
    except Exception as e:  # the first write finds no store
        if "PATH_NOT_FOUND" not in str(e):
            raise
        merged = canonical_bars(new)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"  # a folder of its own: writers do not meet
    merged.write.mode("overwrite").parquet(staged)  # a store cannot be read and replaced in one job
    again = spark.read.schema(merged.schema).parquet(staged)
    again.repartition(*PARTS).sortWithinPartitions("bar_ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*PARTS).parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_range(spark: SparkSession, path: str, symbol: str, source: str, timeframe: str, start: str, end: str) -> DataFrame:
    """Bars from start to end, both included; months outside are not opened."""
    schema = BAR + ", month string"
    months = (F.col("month") >= start[:7]) & (F.col("month") <= end[:7])
    own = (F.col("symbol") == symbol) & (F.col("source") == source) & (F.col("timeframe") == timeframe)
    at = F.col("bar_ts")
    return spark.read.schema(schema).parquet(path).where(own & months & (at >= F.lit(start).cast("timestamp_ntz")) & (at <= F.lit(end).cast("timestamp_ntz")))


def compact_ticks(ticks: DataFrame, scale: float) -> DataFrame:
    """Ticks as whole points, which pack well: ms, bid and spread in points, flag; partitioned by day."""
    return ticks.select(
        "symbol", F.to_date("ts").alias("day"), F.unix_millis(F.to_timestamp_ltz("ts")).alias("ms"), F.round(F.col("bid") * scale).cast("int").alias("bid_pts"),
        F.round((F.col("ask") - F.col("bid")) * scale).cast("int").alias("spr"), F.col("flag").cast("byte").alias("flag"),
    )


def expand_ticks(stored: DataFrame, scale: float) -> DataFrame:
    """Ticks of the flags that are kept, as prices again."""
    kept = stored.where(F.col("flag").isin(*KEPT_FLAGS))
    return kept.select("symbol", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), (F.col("bid_pts") / scale).alias("bid"), ((F.col("bid_pts") + F.col("spr")) / scale).alias("ask"), "flag")


def stale_days(ticks: DataFrame, minutes: DataFrame) -> DataFrame:
    """Days on which the ticks counted in minute bars differ from the ticks kept, either side missing too."""
    a = ticks.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("ticks"))
    b = minutes.groupBy("symbol", F.to_date("bar_ts").alias("day")).agg(F.sum("tick_count").alias("counted"))
    return a.join(b, ["symbol", "day"], "full").where(~F.col("ticks").eqNullSafe(F.col("counted")))


def months_to_fetch(wanted: DataFrame, ledger: DataFrame, share: float = 0.9) -> DataFrame:
    """Wanted months without those that are complete enough."""
    done = ledger.where(F.col("bar_count") >= share * F.col("expected"))
    return wanted.join(done.select("symbol", "month"), ["symbol", "month"], "left_anti")


def keep_latest(runs: DataFrame, by: str, started: str, n: int) -> DataFrame:
    """Payloads beyond the latest n of each source, which may be deleted."""
    w = Window.partitionBy(by).orderBy(F.col(started).desc())
    return runs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") > n).drop("__n")


def replace_parts(frame: DataFrame, path: str, parts: list[str]) -> None:
    """Writes the frame in place of those partitions that it has rows of, such as a version and an indicator, or a
    day of candles; others stay. The frame must not be read from the same path."""
    frame.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def append_log(frame: DataFrame, path: str) -> None:
    """Adds rows to a log that is never rewritten (observations, revisions), by the day of writing."""
    frame.withColumn("logged_on", F.current_date()).write.mode("append").partitionBy("logged_on").parquet(path)


def preview(frame: DataFrame, order: list[str], rows: int = 25) -> DataFrame:
    """The first rows in order, each as one JSON text; the limit is what a preview is for."""
    return frame.orderBy(*order).limit(rows).select(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("sample"))
