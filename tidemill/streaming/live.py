"""Live forms of the time-based operators: candles, silence gaps, restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import clock

#: How long a live feed waits for late ticks.
LAG = "2 seconds"


def tick_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Ticks that arrive as files, with event times that a watermark accepts.

    path may be a folder or one file: it is given as a pattern, as streams otherwise take folders alone.
    """
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def closed_candles(ticks: DataFrame, width: str, lag: str = LAG, tie: str = "id") -> DataFrame:
    """Candles of a stream of ticks (symbol, ts as timestamp, bid, ask); each leaves once, when it is closed."""
    at = F.struct("ts", tie)
    candles = (
        ticks.withWatermark("ts", lag)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("bid", at).alias("open"),
            F.max("bid").alias("high"),
            F.min("bid").alias("low"),
            F.max_by("bid", at).alias("close"),
            F.count("*").alias("tick_count"),
        )
    )
    return candles.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("bar_ts"), "open", "high", "low", "close", "tick_count")


def sessions(ticks: DataFrame, silence: str = "3 minutes", lag: str = LAG) -> DataFrame:
    """Stretches of ticks of a symbol that no silence of the given length breaks."""
    found = ticks.withWatermark("ts", lag).groupBy("symbol", F.session_window("ts", silence).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return found.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there, exactly once, and reads what it has written."""
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def after_restart(incoming: DataFrame, recorded: DataFrame, tie: str = "id") -> DataFrame:
    """The incoming ticks that are not recorded yet: of ticks of one symbol and millisecond as many are passed
    over as were written. A plain distinct would lose ticks that are truly equal. Times go to the nearest millisecond
    (halves away from 1970), as DuckDB's ``epoch_ms`` counts them; ticks without tie come last."""
    us = clock.epoch_micros(F.col("ts"))
    ms = F.when(us < 0, F.ceil((us - 500) / F.lit(1000))).otherwise(F.floor((us + 500) / F.lit(1000)))
    order = Window.partitionBy("symbol", "ms").orderBy(F.asc_nulls_last(tie))
    numbered = lambda df: df.withColumn("ms", ms).withColumn("seq", F.row_number().over(order))
    return numbered(incoming).join(numbered(recorded).select("symbol", "ms", "seq"), ["symbol", "ms", "seq"], "left_anti").drop("ms", "seq")


def forming(ticks: DataFrame, clock: str, seconds: int) -> DataFrame:
    """Candles as they stand at a moment: ticks up to it alone, with whether the candle is complete."""
    from tidemill.operators.bars import ticks_to_bars

    now = F.lit(clock).cast("timestamp_ntz")
    bars = ticks_to_bars(ticks.where(F.col("ts") <= now), seconds)
    return bars.withColumn("complete", F.col("bar_ts") + F.make_dt_interval(secs=F.lit(seconds)) <= now)
