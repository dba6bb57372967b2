"""Candles that follow late ticks: each batch of a stream replaces the days it touches, and says which candles changed.

Ticks are kept by batch, so a batch that is replayed after a failure overwrites itself and changes nothing. The days of a batch
are derived again from all ticks kept of them, whatever order they came in, and candles that differ from those that stood
there leave as a frame. Frames, the last of each candle, add up to the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.operators.bars import ticks_to_bars
from tidemill.sources.store import replace_parts

CANDLE = ["symbol", "bar_ts", "open", "high", "low", "close", "tick_count"]


def _table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at path, empty where nothing has been written."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def whole(ticks: DataFrame) -> DataFrame:
    """Ticks without the records that a cut line or a broken write leaves: a symbol, a time and two ordered prices above zero."""
    good = F.col("symbol").isNotNull() & F.col("ts").isNotNull() & (F.col("bid") > 0) & (F.col("ask") >= F.col("bid"))
    return ticks.where(F.coalesce(good & ~F.isnan("bid") & ~F.isnan("ask"), F.lit(False)))


class Days:
    """Ticks, candles and frames in a folder; call apply as a stream's foreachBatch."""

    def __init__(self, spark: SparkSession, folder: str, seconds: int) -> None:
        self.spark, self.folder, self.seconds = spark, folder.rstrip("/"), seconds
        self.tick_schema = StructType.fromDDL("id long, symbol string, ts timestamp_ntz, bid double, ask double, day date, batch long")
        self.candle_schema = StructType.fromDDL("symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, tick_count long, day date")
        self.frame_schema = StructType.fromDDL("symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, tick_count long, batch long")

    def ticks(self) -> DataFrame:
        return _table(self.spark, f"{self.folder}/ticks", self.tick_schema)

    def candles(self) -> DataFrame:
        return _table(self.spark, f"{self.folder}/candles", self.candle_schema)

    def frames(self) -> DataFrame:
        return _table(self.spark, f"{self.folder}/frames", self.frame_schema)

    def apply(self, batch: DataFrame, number: int) -> None:
        new = whole(batch).select("id", "symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "bid", "ask")
        new = new.withColumn("day", F.to_date("ts")).withColumn("batch", F.lit(number).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(f"{self.folder}/ticks")
        kept = self.ticks()
        # a replayed batch may have held other rows the first time: the days of what it kept are its days
        days = kept.where(F.col("batch") == number).select("day").distinct()
        now = ticks_to_bars(kept.join(days, "day", "left_semi"), self.seconds).select(*CANDLE).withColumn("day", F.to_date("bar_ts"))
        # against the frames of earlier batches, which a replay of this one leaves as they were
        last = self.frames().where(F.col("batch") < number).groupBy("symbol", "bar_ts").agg(F.max_by(F.struct(*CANDLE[2:]), "batch").alias("was"))
        met = now.join(last, ["symbol", "bar_ts"], "left")
        changed = met.where(F.col("was").isNull() | ~F.struct(*CANDLE[2:]).eqNullSafe(F.col("was")))
        frame = changed.select(*CANDLE, F.lit(number).cast("long").alias("batch"))
        replace_parts(frame, f"{self.folder}/frames", ["batch"])
        replace_parts(now, f"{self.folder}/candles", ["day"])


def added_up(frames: DataFrame) -> DataFrame:
    """The candles as the frames leave them: the last of each."""
    last = frames.groupBy("symbol", "bar_ts").agg(F.max_by(F.struct(*CANDLE[2:]), "batch").alias("c"))
    return last.select("symbol", "bar_ts", "c.*")
