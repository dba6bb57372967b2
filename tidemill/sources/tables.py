"""The driver's tables as ticks, bars, releases and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The instruments of the day bars and the two indicators that concern each, as base and quote currency would.
PAIRINGS = [
    ("AF", "1-URGENT"), ("AF", "2-HIGH"), ("AO", "2-HIGH"), ("AO", "3-MEDIUM"), ("NF", "3-MEDIUM"), ("NF", "4-NOT SPECIFIED"),
    ("NO", "4-NOT SPECIFIED"), ("NO", "5-LOW"), ("RF", "5-LOW"), ("RF", "1-URGENT"), ("RO", "1-URGENT"), ("RO", "3-MEDIUM"),
]
#: Known shocks: moment, label.
SHOCKS = [("1997-03-17 00:00:00", "floor removed"), ("1999-08-02 00:00:00", "flash crash")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, symbol, ts, bid, ask."""
    k = F.get_json_object("props", "$.k").cast("int")
    bid = F.lit(100.0) + F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), "ts", bid.alias("bid"), (bid + (k + 1) / F.lit(1000.0)).alias("ask")
    )


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, price, volume and the order of deals within a day."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("seq"),
    )


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One release per indicator and day: indicator, ts, importance, actual, forecast (the mean of the last
    three) and previous."""
    days = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("indicator"), F.col("o_orderdate").alias("ts"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(24,6)").alias("actual"))
    )
    w = Window.partitionBy("indicator").orderBy("ts")
    return days.select(
        "indicator",
        "ts",
        F.substring("indicator", 1, 1).cast("int").alias("importance"),
        "actual",
        F.avg(F.col("actual").cast("double")).over(w.rowsBetween(-3, -1)).alias("forecast"),
        F.lag("actual").over(w).alias("previous"),
    )


#: Order status as the source of a claim.
SOURCES = [("F", "agency_schedule"), ("O", "mt5_calendar"), ("P", "forexfactory_pages")]


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several sources' claims about one figure: identity, field, source, seq, value."""
    o = table(spark, sf_dir, "orders")
    source = F.lit(None).cast("string")
    for status, name in SOURCES:
        source = F.when(F.col("o_orderstatus") == status, name).otherwise(source)
    return o.select(
        F.concat_ws("|", F.substring("o_orderpriority", 1, 1), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("identity"),
        F.lit("actual_first_print").alias("field"),
        source.alias("source"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").cast("decimal(24,6)").alias("value"),
    )
