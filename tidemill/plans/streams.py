"""Streaming queries, run over all that is there; their SQL is the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.bars import ticks_to_bars
from tidemill.operators.shared import new_folder
from tidemill.plans.registry import H1, TICKS, query, rounded
from tidemill.sources import tables
from tidemill.streaming import live
from tidemill.streaming.days import Days, added_up
from tidemill.streaming.tail import GrowingCsv


#: When the tick comes that closes all windows before it.
CLOSING_TS = "2200-01-01 00:00:00"


def _stream(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The ticks as a stream, with one far later tick of a symbol of its own; it moves the watermark past all others."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    last = {"event_type": F.lit("closing"), "ts": F.lit(CLOSING_TS), "value": F.lit(0), "props": F.lit("{}")}
    spark.range(1).select(*[last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{folder}/closing")
    raw = live.tick_stream(spark, path, schema).unionByName(spark.readStream.schema(schema).parquet(f"{folder}/closing"))
    k = F.get_json_object("props", "$.k").cast("int")
    bid = F.lit(100.0) + F.col("value")
    return raw.select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), bid.alias("bid"), (bid + (k + 1) / F.lit(1000.0)).alias("ask"))


@query(f"WITH {H1} SELECT symbol, bar_ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, tick_count FROM h1")
def stream_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles, from the stream alone."""
    folder = new_folder(spark, "stream")
    closed = live.run_available(live.closed_candles(_stream(spark, sf_dir, folder), "1 hour"), f"{folder}/out", f"{folder}/state")
    return rounded(closed, 6, "open", "high", "low", "close")


_SESSIONS = f"""WITH {TICKS}, m AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 180000000, true)::INT AS new FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, id)),
c AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS chain FROM m)
SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM c GROUP BY symbol, chain"""


@query(_SESSIONS)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches without three minutes of silence, from the stream alone."""
    folder = new_folder(spark, "stream")
    return live.run_available(live.sessions(_stream(spark, sf_dir, folder)), f"{folder}/out", f"{folder}/state")


@query(f"""WITH {TICKS}, i AS (SELECT *, epoch_ms(ts) // 3600000 AS ms FROM ticks), n AS (SELECT id, symbol, ts, row_number() OVER (PARTITION BY symbol, epoch_ms(ts) ORDER BY id) AS seq FROM i),
r AS (SELECT symbol, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY symbol, epoch_ms(ts) ORDER BY id) AS seq FROM i WHERE id % 3 <> 0)
SELECT id, symbol, ts FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.symbol = n.symbol AND r.ms = epoch_ms(n.ts) AND r.seq = n.seq)""")
def restart_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.ticks(spark, sf_dir)
    return live.after_restart(t, t.where("id % 3 <> 0")).select("id", "symbol", "ts")


@query(f"""WITH {TICKS} SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS bar_ts, round(last(bid ORDER BY ts, id), 6) AS close, count(*) AS tick_count,
 date_trunc('hour', ts) + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-15 12:30:00' AS complete FROM ticks WHERE ts <= TIMESTAMP '2024-01-15 12:30:00' GROUP BY ALL""")
def candles_at_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replay shows at a moment."""
    shown = live.forming(tables.ticks(spark, sf_dir), "2024-01-15 12:30:00", 3600)
    return rounded(shown.select("symbol", "bar_ts", "close", "tick_count", "complete"), 6, "close")


_H1_ROWS = f"WITH {H1} SELECT symbol, bar_ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, tick_count FROM h1"


@query(_H1_ROWS)
def stream_growing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles from lines that a feed appends: half a month's files, a run of the stream, the rest, and the stream again."""
    folder = new_folder(spark, "growing")
    spark.dataSource.register(GrowingCsv)
    ticks = tables.ticks(spark, sf_dir).select("id", "symbol", F.unix_micros(F.to_timestamp_ltz("ts")).alias("ts_us"), "bid", "ask")
    middle = ticks.agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("z")).select(((F.col("a") + F.col("z")) / 2).cast("long").alias("m")).first()["m"]
    schema = "id long, symbol string, ts_us long, bid double, ask double"
    for half in (F.col("ts_us") < middle, F.col("ts_us") >= middle):
        ticks.where(half).write.mode("append").option("header", True).csv(f"{folder}/live")
        lines = spark.readStream.format("growing_csv").schema(schema).load(f"{folder}/live")
        read = live.run_available(lines, f"{folder}/out", f"{folder}/state")
    seen = read.withColumn("ts", F.timestamp_micros("ts_us").cast("timestamp_ntz"))
    candles = ticks_to_bars(seen, 3600).select("symbol", "bar_ts", "open", "high", "low", "close", "tick_count")
    return rounded(candles, 6, "open", "high", "low", "close")


def _late_days(spark: SparkSession, sf_dir: str) -> Days:
    """The ticks in an order that has nothing to do with time, in four files, one a batch."""
    folder = new_folder(spark, "days")
    ticks = tables.ticks(spark, sf_dir)
    ticks.repartition(4, F.xxhash64("id")).write.parquet(f"{folder}/in")
    table = Days(spark, f"{folder}/days", 3600)
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    writer = stream.writeStream.foreachBatch(table.apply).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return table


@query(_H1_ROWS)
def stream_late_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles, each day replaced by every batch that brings ticks of it."""
    candles = _late_days(spark, sf_dir).candles()
    return rounded(candles.drop("day"), 6, "open", "high", "low", "close")


@query(_H1_ROWS)
def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the frames: only candles that a batch has changed leave it, and the last of each is the table."""
    return rounded(added_up(_late_days(spark, sf_dir).frames()), 6, "open", "high", "low", "close")
