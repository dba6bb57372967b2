"""Stores and readers over files that the queries write from the given tables, and what a calendar's keeper asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import bars, browser, consolidation
from tidemill.operators.shared import new_folder
from tidemill.plans.markets import h1
from tidemill.plans.registry import H1, TICKS, query, rounded
from tidemill.sources import feeds, store, tables


@query(f"""WITH {H1} SELECT symbol, bar_ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, tick_count FROM h1
WHERE symbol IN ('view', 'click') AND bar_ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""")
def bar_store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of two symbols and a range, from month files written twice: first with wrong closes, then right."""
    path = new_folder(spark, "bars")
    full = h1(spark, sf_dir).select("symbol", F.lit("feed").alias("source"), F.lit("h1").alias("timeframe"), "bar_ts", "open", "high", "low", "close", "tick_count")
    store.upsert_months(spark, path, full.withColumn("close", F.lit(0.0)))
    store.upsert_months(spark, path, full)
    parts = [store.read_range(spark, path, s, "feed", "h1", "2024-01-05 06:00:00", "2024-01-20 12:00:00") for s in ("view", "click")]
    return rounded(parts[0].union(parts[1]).select("symbol", "bar_ts", "open", "high", "low", "close", "tick_count"), 6, "open", "high", "low", "close")


@query(f"""WITH {TICKS} SELECT symbol, date_trunc('millisecond', ts)::TIMESTAMP AS ts, round(bid, 3) AS bid, round(ask, 3) AS ask, (id % 5)::TINYINT AS flag FROM ticks WHERE id % 5 IN (0, 3)""")
def tick_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as whole points in files by day, read back with the flags that are kept. Flags are the ids' remainders by five here."""
    path = new_folder(spark, "ticks")
    flagged = tables.ticks(spark, sf_dir).withColumn("flag", (F.col("id") % 5).cast("byte"))
    compact = store.compact_ticks(flagged, 1000.0)
    compact.repartition("day").sortWithinPartitions("symbol", "ms").write.option("compression", "zstd").partitionBy("day").parquet(path)
    back = store.expand_ticks(spark.read.schema(compact.schema).parquet(path), 1000.0)
    return rounded(back, 3, "bid", "ask").select("symbol", "ts", "bid", "ask", "flag")


@query(f"""WITH {H1} SELECT symbol, bar_ts, CASE WHEN bar_ts::DATE = DATE '2024-01-10' THEN tick_count + 1 ELSE tick_count END AS tick_count FROM h1""")
def days_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles by day, of which one day is written again; the others stay."""
    path = new_folder(spark, "candles")
    candles = h1(spark, sf_dir).select("symbol", "bar_ts", "tick_count", F.to_date("bar_ts").alias("day"))
    store.replace_parts(candles, path, ["day"])
    store.replace_parts(candles.where("day = DATE '2024-01-10'").withColumn("tick_count", F.col("tick_count") + 1), path, ["day"])
    return spark.read.schema(candles.schema).parquet(path).select("symbol", "bar_ts", "tick_count")


@query(f"""WITH {TICKS}, a AS (SELECT symbol, ts::DATE AS day, count(*) AS ticks FROM ticks WHERE id % 50 <> 0 GROUP BY ALL), b AS (SELECT symbol, ts::DATE AS day, count(*)::BIGINT AS counted FROM ticks GROUP BY ALL)
SELECT symbol, day, ticks, counted FROM a FULL JOIN b USING (symbol, day) WHERE ticks IS DISTINCT FROM counted""")
def stale_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose minute bars count other ticks than are kept, where every fiftieth tick is lost."""
    t = tables.ticks(spark, sf_dir)
    return store.stale_days(t.where("id % 50 <> 0"), bars.ticks_to_bars(t, 60))


@query("""WITH o AS (SELECT o_orderstatus AS source, o_orderkey AS run, o_orderdate AS started, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT source, run FROM o WHERE n > 100""")
def pruned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs beyond the latest hundred of each source, which may be deleted."""
    runs = tables.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("run"), F.struct("o_orderdate", "o_orderkey").alias("started"))
    return store.keep_latest(runs, "source", "started", 100).select("source", "run")


@query("""WITH o AS (SELECT o_orderkey, count(*) FILTER (l_returnflag = 'R') AS own, count(*) FILTER (l_returnflag <> 'R') AS other FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey AS release_id FROM o WHERE NOT (own > 0 AND other = 0)""")
def source_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases that stay when a source is purged: all but those that it alone has observed."""
    releases = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("release_id"))
    observed = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("release_id"), F.col("l_returnflag").alias("source"))
    return consolidation.purge_source(releases, observed, "R")


@query("""WITH n AS (SELECT c_custkey AS key, c_mktsegment AS g, c_acctbal > 4000 AS mapped, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT key, first_value(key) OVER (PARTITION BY g ORDER BY mapped DESC, n DESC, key) AS survivor FROM n""")
def series_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group of duplicates the member under which the others are folded: mapped, then with the most releases, then the first."""
    n = tables.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n_releases"))
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("g"), (F.col("c_acctbal") > 4000).alias("is_mapped"))
    return consolidation.survivors(c.join(n, "key", "left").fillna(0, ["n_releases"]), ["g"])


@query("""WITH s AS (SELECT p_partkey AS indicator, p_brand AS currency, lower(p_type) AS t, p_size AS last_release FROM part),
b AS (SELECT currency, t, indicator FROM s QUALIFY row_number() OVER (PARTITION BY currency, t ORDER BY last_release DESC, indicator) = 1)
SELECT p_partkey AS source_key, p_brand AS currency, upper(p_type) AS title, b.indicator FROM part LEFT JOIN b ON b.currency = p_brand AND b.t = lower(p_type)""")
def titles_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every source title the series of its currency with that title, case aside, the one released last."""
    p = tables.table(spark, sf_dir, "part")
    series = p.select(F.col("p_partkey").alias("indicator"), F.col("p_brand").alias("currency"), F.col("p_type").alias("name"), F.col("p_size").alias("last_release"))
    aliases = p.select(F.col("p_partkey").alias("source_key"), F.col("p_brand").alias("currency"), F.upper("p_type").alias("title"))
    return consolidation.title_twins(aliases, series).select("source_key", "currency", "title", "indicator")


#: What the orders are as releases: figures and grades by their status, priority and price.
_AS_RELEASES = {
    "release_ts": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END", "scheduled_ts": "CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE o_orderdate END",
    "reference_period": "CASE WHEN o_orderstatus = 'F' THEN 'release:2024-09-06T12:30' ELSE '2024-08' END", "cross_source": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'disagree' END",
    "forecast_provenance": "CASE WHEN o_orderpriority = '2-HIGH' THEN 'point_in_time' END", "actual": "CASE WHEN o_totalprice > 200000 THEN o_totalprice END",
    "mapping_status": "CASE WHEN o_orderpriority = '5-LOW' THEN 'unmapped' ELSE 'mapped' END", "vol_check": "CASE o_orderstatus WHEN 'O' THEN 'confounded' WHEN 'P' THEN 'unchecked' END",
}


@query("WITH r AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _AS_RELEASES.items()) + """ FROM orders) SELECT count_if(coalesce(release_ts, scheduled_ts) IS NOT NULL)::BIGINT AS anchorable,
 count_if(coalesce(release_ts, scheduled_ts) IS NULL)::BIGINT AS period_only, count_if(starts_with(reference_period, 'release:'))::BIGINT AS provisional, count_if(cross_source = 'disagree')::BIGINT AS disagree,
 count_if(forecast_provenance = 'point_in_time')::BIGINT AS point_in_time, count_if(actual IS NOT NULL)::BIGINT AS has_actual, count_if(actual IS NULL)::BIGINT AS no_actual, count_if(mapping_status = 'unmapped')::BIGINT AS unmapped,
 count_if(vol_check IS NULL OR vol_check = 'unchecked')::BIGINT AS unchecked, count_if(vol_check = 'confounded')::BIGINT AS confounded FROM r""")
def condition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many releases meet each of the named conditions, in one scan."""
    r = tables.table(spark, sf_dir, "orders").select(*[F.expr(v).alias(k) for k, v in _AS_RELEASES.items()])
    return r.agg(*[F.count_if(test()).alias(name) for name, test in browser.CONDITIONS.items()])


@query("""SELECT p_partkey, p_name, p_retailprice FROM part WHERE contains(lower(p_name), 'al') OR contains(lower(p_type), 'al') ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 50 OFFSET 50""")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of fifty rows that hold a word in either of two fields, the dearest first."""
    found = browser.search(tables.table(spark, sf_dir, "part"), "AL", ("p_name", "p_type"))
    return browser.page(found, "p_retailprice", "p_partkey", 2, sorts=("p_retailprice", "p_name")).select("p_partkey", "p_name", "p_retailprice")


@query("""SELECT 'USD|' || o_orderpriority AS event_key, o_orderdate::TIMESTAMP + INTERVAL 12 HOUR + INTERVAL 30 MINUTE AS scheduled_ts, 'release:' || strftime(o_orderdate, '%Y-%m-%d') || 'T12:30' AS reference_period,
 round(o_totalprice, 2) AS forecast, CASE WHEN o_orderkey % 2 = 0 THEN 'forecast_point_in_time' ELSE 'forecast_stored' END AS forecast_target, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS importance FROM orders""")
def weekly_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims from JSON payloads, one a month and capture, which hold the orders as releases and entries that are refused."""
    path = new_folder(spark, "payloads")
    o = tables.table(spark, sf_dir, "orders")
    impact = F.when(F.col("o_orderstatus") == "F", "High").when(F.col("o_orderstatus") == "O", "medium").otherwise(" Low ")
    early = F.col("o_orderkey") % 2 == 0
    text = F.format_string("%.2f", F.col("o_totalprice"))
    entry = lambda country, stamp: F.struct(F.col("o_orderpriority").alias("title"), F.lit(country).alias("country"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(stamp)).alias("date"), impact.alias("impact"), text.alias("forecast"))
    entries = o.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), early.alias("early"), F.explode(F.array(entry("usd", "T08:30:00-04:00"), entry("XXX", "T08:30:00-04:00"), entry("USD", "T08:30:00"))).alias("e"))
    payloads = entries.groupBy("month", "early", F.pmod(F.xxhash64("e"), F.lit(16)).alias("part")).agg(F.to_json(F.collect_list("e")).alias("payload"))
    captured = F.when(F.col("early"), F.lit("1990-01-01")).otherwise("2030-01-01").cast("timestamp")
    payloads.select("payload", captured.alias("captured_at")).write.json(path)
    claims = feeds.weekly_feed(spark.read.schema("payload string, captured_at timestamp").json(path))
    return rounded(claims.select("event_key", "scheduled_ts", "reference_period", "forecast", "forecast_target", "importance"), 2, "forecast")
