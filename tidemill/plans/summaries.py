"""Summaries of the kind that screens show: coverage, codes, feeds, sources, sessions, the open book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import bars, summaries
from tidemill.plans.registry import CLAIMS, FROM_NY, H1, NY, PAIRS, RELEASES, TICKS, query, rounded
from tidemill.sources import tables

CLOCK = "2024-01-15 12:30:00"
#: Names as calendars print them, for the rules of concepts and codes; chosen by key.
NAMES = [
    "Fed Chair speaks", "Federal election", "Official Bank Rate", "Non-Farm Payrolls", "CPI y/y", "Retail Sales m/m", "Building Permits", "(ISM) Services PMI",
    "Final GDP q/q", "Trade Balance", "Crude Oil Inventories", "Public Sector Net Borrowing", "Index of the Rate", "Flash something, other",
]
_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


@query(f"""WITH {RELEASES} SELECT year(ts) AS year, count(*) AS n, count(forecast) AS with_forecast, count_if(importance <= 2)::BIGINT AS high,
round(count(forecast) * 100.0::DOUBLE / count(*), 4) AS share FROM releases GROUP BY 1""")
def coverage_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return tables.releases(spark, sf_dir).groupBy(F.year("ts").alias("year")).agg(
        n.alias("n"), F.count("forecast").alias("with_forecast"), F.count_if(F.col("importance") <= 2).alias("high"), F.round(F.count("forecast") * 100.0 / n, 4).alias("share")
    )


@query(f"""WITH {RELEASES}, n AS (SELECT indicator, count(*) AS n FROM releases WHERE importance <= 3 GROUP BY 1 HAVING count(*) >= 10)
SELECT indicator, n, row_number() OVER (ORDER BY n DESC, indicator) AS place FROM n""")
def checkable_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators with at least ten releases, the most frequent first. One row an indicator is ordered."""
    n = tables.releases(spark, sf_dir).where("importance <= 3").groupBy("indicator").agg(F.count("*").alias("n")).where("n >= 10")
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "indicator")))


@query(f"""WITH {RELEASES}, p AS (SELECT a.indicator, b.indicator AS neighbour, count(*) AS n FROM releases a JOIN releases b ON a.ts = b.ts AND a.indicator <> b.indicator GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY n DESC, neighbour) AS place FROM p QUALIFY place <= 6""")
def co_timed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.co_timed(tables.releases(spark, sf_dir))


_FEEDS = f"""{TICKS}, f AS (SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS bar_ts, id % 2 AS feed, max(bid) AS high, min(bid) AS low, last(bid ORDER BY ts, id) AS close FROM ticks GROUP BY ALL)"""


@query(f"""WITH {_FEEDS}, j AS (SELECT a.symbol, a.high AS ha, a.low AS la, b.high AS hb, b.low AS lb, (a.close - b.close) / 0.01::DOUBLE AS d FROM f a JOIN f b ON a.symbol = b.symbol AND a.bar_ts = b.bar_ts WHERE a.feed = 0 AND b.feed = 1)
SELECT symbol, count(*) AS shared, round(avg(d), 4) AS mean, round(median(d), 4) AS median, round(stddev_samp(d), 4) AS sd, round(max(abs(d)), 4) AS largest, round((max(ha) - min(la)) / 0.01::DOUBLE, 4) AS range_a,
round((max(hb) - min(lb)) / 0.01::DOUBLE, 4) AS range_b FROM j GROUP BY symbol""")
def feed_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds, of even and of odd ticks."""
    t = tables.ticks(spark, sf_dir)
    even, odd = (bars.ticks_to_bars(t.where(F.col("id") % 2 == k), 3600) for k in (0, 1))
    return rounded(summaries.feed_difference(even, odd, F.lit(0.01)), 4, "mean", "median", "sd", "largest", "range_a", "range_b")


@query(f"""WITH {TICKS}, d AS (SELECT symbol, ts::DATE AS day, max(ts) FILTER (id % 3 = 0) AS a, max(ts) FILTER (id % 3 = 1) AS b, max(ts) FILTER (id % 3 = 2) AS c FROM ticks GROUP BY ALL),
x AS (SELECT *, CASE WHEN a IS NULL OR b > a + INTERVAL 5 MINUTE THEN b ELSE a END AS m, CASE WHEN a IS NULL OR b > a + INTERVAL 5 MINUTE THEN 'second' ELSE 'first' END AS s FROM d)
SELECT symbol, day, CASE WHEN m IS NULL OR c > m + INTERVAL 5 MINUTE THEN 'third' ELSE s END AS source, CASE WHEN m IS NULL OR c > m + INTERVAL 5 MINUTE THEN c ELSE m END AS last_ts FROM x""")
def best_source_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.lit("first"), F.lit("second"), F.lit("third"))
    t = tables.ticks(spark, sf_dir).withColumn("source", F.get(names, (F.col("id") % 3).cast("int")))
    days = t.groupBy("symbol", F.to_date("ts").alias("day"), "source").agg(F.max("ts").alias("last_ts"))
    return summaries.best_source(days, ["symbol", "day"], ["first", "second", "third"])


@query(f"""WITH {TICKS}, ck AS (SELECT DISTINCT symbol, ts::DATE + INTERVAL 15 HOUR AS clock_ts FROM ticks),
l AS (SELECT ck.symbol, clock_ts, max(ts) FILTER (id % 3 = 0) AS a, max(ts) FILTER (id % 3 = 1) AS b, max(ts) FILTER (id % 3 = 2) AS c FROM ck JOIN ticks ON ticks.symbol = ck.symbol AND ts <= clock_ts GROUP BY ALL),
o AS (SELECT *, {FROM_NY.format("(date_trunc('day', " + NY.format("clock_ts") + " - INTERVAL 17 HOUR) + INTERVAL 17 HOUR)")}::TIMESTAMP AS opened FROM l),
x AS (SELECT *, a IS NULL OR (a < opened AND b > a + INTERVAL 5 MINUTE) AS two FROM o),
y AS (SELECT *, CASE WHEN two AND b IS NOT NULL THEN b ELSE a END AS m, CASE WHEN two AND b IS NOT NULL THEN 'second' ELSE 'first' END AS s FROM x),
z AS (SELECT *, m IS NULL OR (m < opened AND c > m + INTERVAL 5 MINUTE) AS three FROM y)
SELECT symbol, clock_ts, CASE WHEN three AND c IS NOT NULL THEN 'third' ELSE s END AS source, CASE WHEN three AND c IS NOT NULL THEN c ELSE m END AS last_ts FROM z""")
def source_at_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed that a replay would follow at 15:00 of each day, in listed order, with a stop at the first that is in the current market day."""
    names = F.array(F.lit("first"), F.lit("second"), F.lit("third"))
    t = tables.ticks(spark, sf_dir).withColumn("source", F.get(names, (F.col("id") % 3).cast("int")))
    clocks = t.select("symbol", F.timestamp_add("HOUR", F.lit(15), F.date_trunc("day", "ts").cast("timestamp_ntz")).alias("clock_ts")).distinct()
    clocks = clocks.withColumn("clock_id", F.concat_ws("@", "symbol", F.col("clock_ts").cast("string")))
    return summaries.source_at(t, clocks, ["first", "second", "third"]).drop("clock_id")


@query("""SELECT c_custkey AS session, count(o_orderkey) AS trades, coalesce(sum(o_totalprice::DECIMAL(18,2)), 0)::DOUBLE AS profit, max(o_orderdate) AS newest
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their trades, those without any too. Trades are summed before they are joined."""
    o = tables.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("session"))
    o = o.agg(F.count("o_orderkey").alias("trades"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("profit"), F.max("o_orderdate").alias("newest"))
    return tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session")).join(o, "session", "left").fillna(0, ["trades", "profit"])


@query(f"""WITH {RELEASES} SELECT 'indicators' AS name, count(DISTINCT indicator) AS n FROM releases UNION ALL SELECT 'releases', count(*) FROM releases UNION ALL SELECT 'unforecast', count_if(forecast IS NULL)::BIGINT FROM releases
UNION ALL SELECT 'high', count_if(importance = 1)::BIGINT FROM releases UNION ALL SELECT 'claims', count(*) FROM orders UNION ALL SELECT 'open claims', count_if(o_orderstatus = 'O')::BIGINT FROM orders
UNION ALL SELECT 'ticks', count(*) FROM events UNION ALL SELECT 'symbols', count(DISTINCT event_type) FROM events""")
def sidebar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight counters, one scan a table."""
    one = lambda df, **counts: df.agg(*[c.alias(k) for k, c in counts.items()]).unpivot([], list(counts), "name", "n")
    r = one(
        tables.releases(spark, sf_dir), indicators=F.count_distinct("indicator"), releases=F.count("*"), unforecast=F.count_if(F.col("forecast").isNull()), high=F.count_if(F.col("importance") == 1)
    )
    o = one(tables.table(spark, sf_dir, "orders"), **{"claims": F.count("*"), "open claims": F.count_if(F.col("o_orderstatus") == "O")})
    return r.unionByName(o).unionByName(one(tables.table(spark, sf_dir, "events"), ticks=F.count("*"), symbols=F.count_distinct("event_type")))


@query(f"""WITH {TICKS}, p AS (SELECT id, symbol, CASE WHEN id % 20 = 0 THEN 1 ELSE -1 END AS side, (1 + id % 5) / 10.0::DOUBLE AS lots, CASE WHEN id % 20 = 0 THEN ask ELSE bid END AS entry FROM ticks WHERE id % 10 = 0 AND ts <= TIMESTAMP '{CLOCK}'),
q AS (SELECT symbol, last(bid ORDER BY ts, id) AS bid, last(ask ORDER BY ts, id) AS ask FROM ticks WHERE ts <= TIMESTAMP '{CLOCK}' GROUP BY symbol),
v AS (SELECT p.*, CASE WHEN side > 0 THEN bid ELSE ask END AS mark FROM p LEFT JOIN q USING (symbol))
SELECT id, symbol, side, lots, round(mark, 6) AS mark, round(side * (mark - entry) / 0.01::DOUBLE, 4) AS pips, round(side * (mark - entry) * lots * 1000, 4) AS profit FROM v""")
def open_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.ticks(spark, sf_dir)
    long = F.col("id") % 20 == 0
    held = t.where((F.col("id") % 10 == 0) & (F.col("ts") <= F.lit(CLOCK).cast("timestamp_ntz"))).select(
        "id", "symbol", F.when(long, 1).otherwise(-1).alias("side"), ((1 + F.col("id") % 5) / 10.0).alias("lots"), F.when(long, F.col("ask")).otherwise(F.col("bid")).alias("entry")
    )
    book = summaries.open_book(held, t, CLOCK, 0.01, 1000)
    return rounded(rounded(book.drop("entry"), 4, "pips", "profit"), 6, "mark")


@query(f"WITH {TICKS} SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS unit_ts, last(id ORDER BY ts, id) AS id, round(last(bid ORDER BY ts, id), 6) AS bid FROM ticks GROUP BY ALL")
def last_of_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.last_of(tables.ticks(spark, sf_dir), ["symbol"], "hour", "ts", "id", ["id", "bid"]), 6, "bid")


@query("WITH d AS (SELECT o_orderpriority AS indicator, o_orderdate, count(*) - 1 AS n FROM orders GROUP BY ALL) SELECT indicator, sum(n)::BIGINT AS most FROM d GROUP BY 1")
def duplicate_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most so many rows can be duplicates: all but one of each indicator and day."""
    d = tables.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("indicator"), "o_orderdate").agg((F.count("*") - 1).alias("n"))
    return d.groupBy("indicator").agg(F.sum("n").alias("most"))


@query(f"SELECT p_partkey, CASE {' '.join(f'''WHEN regexp_matches(lower(name), '{p}') THEN '{c}' ''' for c, p in text.CONCEPTS)} ELSE 'unclassified' END AS concept FROM (SELECT p_partkey, {_NAMES_SQL}[p_partkey % 14 + 1] AS name FROM part)")
def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("p_partkey") % 14).cast("int"))
    return tables.table(spark, sf_dir, "part").select("p_partkey", text.concept(name).alias("concept"))


@query(f"""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE {_NAMES_SQL}[p_partkey % 14 + 1] END AS name FROM part),
w AS (SELECT p_partkey, name, [regexp_replace(x, '^[(),-]+|[(),-]+$', '', 'g') FOR x IN string_split_regex(name, '\\s+') IF x <> ''] AS words FROM n),
c AS (SELECT p_partkey, name, [x FOR x IN words IF regexp_full_match(x, '[A-Z]{{3,}}')][1] AS acronym, upper(array_to_string([x[1] FOR x IN ([y FOR y IN words IF lower(y) NOT IN ('the','of','and','index','rate','change','final','flash')])[1:3]], '')) AS initials FROM w)
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'CANON' || (p_partkey * 1000003)::VARCHAR END AS canonical, CASE WHEN p_partkey % 7 = 0 THEN left('CANON' || (p_partkey * 1000003)::VARCHAR, 12) ELSE 'EUR ' || coalesce(acronym, nullif(initials, ''), upper(left(name, 3))) END AS code FROM c""")
def short_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.when(key % 3 == 0, F.col("p_type")).otherwise(F.get(F.array(*[F.lit(n) for n in NAMES]), (key % 14).cast("int")))
    canonical = F.when(key % 7 == 0, F.concat(F.lit("CANON"), (key.cast("long") * 1000003).cast("string")))
    return tables.table(spark, sf_dir, "part").select("p_partkey", canonical.alias("canonical"), text.short_code(F.lit("EUR"), name, canonical).alias("code"))


@query("""WITH v AS (SELECT o_orderkey, (o_totalprice::DECIMAL(12,2) * (CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 10000 WHEN 2 THEN 0.01 ELSE -0.0001 END)::DECIMAL(10,4))::DECIMAL(24,6) AS v FROM orders)
SELECT o_orderkey, CASE WHEN abs(v) >= 1000000000 THEN regexp_replace((v * 0.000000001::DECIMAL(10,9))::DECIMAL(24,1)::VARCHAR, '\\.?0+$', '') || 'B' WHEN abs(v) >= 1000000 THEN regexp_replace((v * 0.000001::DECIMAL(7,6))::DECIMAL(24,1)::VARCHAR, '\\.?0+$', '') || 'M'
 WHEN abs(v) >= 1000 THEN regexp_replace((v * 0.001::DECIMAL(4,3))::DECIMAL(24,1)::VARCHAR, '\\.?0+$', '') || 'K' WHEN abs(v) >= 100 THEN v::DECIMAL(24,0)::VARCHAR ELSE regexp_replace(v::DECIMAL(24,2)::VARCHAR, '\\.?0+$', '') END AS label FROM v""")
def compact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 4
    by = F.when(kind == 0, F.lit("1")).when(kind == 1, F.lit("10000")).when(kind == 2, F.lit("0.01")).otherwise(F.lit("-0.0001")).cast("decimal(10,4)")
    value = (F.col("o_totalprice").cast("decimal(12,2)") * by).cast("decimal(24,6)")
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", text.compact(value).alias("label"))


_FIGURES = f"""{CLAIMS}, g AS (SELECT identity, last(value ORDER BY seq) FILTER (source = 'agency_schedule') AS first_print, last(value ORDER BY seq) FILTER (source = 'mt5_calendar') AS current FROM claims GROUP BY identity)"""


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.claims(spark, sf_dir)
    last = lambda source: F.max_by("value", F.when(F.col("source") == source, F.col("seq")))
    return c.groupBy("identity").agg(last("agency_schedule").alias("first_print"), last("mt5_calendar").alias("current"))


@query(f"WITH {_FIGURES} SELECT identity, coalesce(first_print, current)::DOUBLE AS preferred, first_print > current AS beat FROM g")
def preferred_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first print where there is one, else the current figure; beat is null unless both are there."""
    f = _figures(spark, sf_dir)
    return f.select("identity", F.coalesce("first_print", "current").cast("double").alias("preferred"), (F.col("first_print") > F.col("current")).alias("beat"))


@query(f"""WITH {_FIGURES} SELECT substr(identity, 3, 4)::INT AS year, count(*) AS n, count_if(first_print IS NOT NULL AND current IS NOT NULL)::BIGINT AS both_there, count_if(abs(first_print - current) <= 1000)::BIGINT AS agreed,
min(identity) AS first_identity FROM g GROUP BY 1""")
def agreement_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two sources reach in each year, and how often they agree within a tolerance."""
    a, b = F.col("first_print"), F.col("current")
    return _figures(spark, sf_dir).groupBy(F.substring("identity", 3, 4).cast("int").alias("year")).agg(
        F.count("*").alias("n"), F.count_if(a.isNotNull() & b.isNotNull()).alias("both_there"), F.count_if(F.abs(a - b) <= 1000).alias("agreed"), F.min("identity").alias("first_identity")
    )


@query(f"WITH {H1}, m AS (SELECT symbol, max(date_trunc('month', bar_ts)) AS m FROM h1 GROUP BY 1) SELECT symbol, round(0.01::DOUBLE / median(close), 9) AS pip_value FROM h1 JOIN m USING (symbol) WHERE date_trunc('month', bar_ts) = m GROUP BY symbol")
def pip_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pip as a fraction of the median close of a symbol's latest month."""
    h1 = bars.ticks_to_bars(tables.ticks(spark, sf_dir), 3600).withColumn("m", F.date_trunc("month", "bar_ts"))
    by_month = h1.groupBy("symbol", "m").agg(F.percentile("close", F.lit(0.5)).alias("mid"))
    return by_month.groupBy("symbol").agg(F.round(0.01 / F.max_by("mid", "m"), 9).alias("pip_value"))


@query(f"WITH {PAIRS}, {RELEASES} SELECT symbol, indicator FROM pairs EXCEPT SELECT symbol, indicator FROM pairs JOIN releases USING (indicator) WHERE importance <= 2")
def pairings_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairings of which nothing is measured; measured are those of important indicators."""
    pairs = spark.createDataFrame(tables.PAIRINGS, "symbol string, indicator string")
    measured = tables.releases(spark, sf_dir).where("importance <= 2").select("indicator").distinct()
    return pairs.exceptAll(pairs.join(measured, "indicator", "left_semi").select("symbol", "indicator"))


@query(f"WITH {PAIRS}, {RELEASES} SELECT indicator, ts, importance FROM releases WHERE indicator IN (SELECT indicator FROM pairs WHERE symbol = 'AO') QUALIFY row_number() OVER (PARTITION BY indicator ORDER BY ts DESC) <= 8")
def relevant_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight releases of each indicator that concerns an instrument."""
    names = [i for s, i in tables.PAIRINGS if s == "AO"]
    r = tables.releases(spark, sf_dir).where(F.col("indicator").isin(names))
    return r.withColumn("k", F.row_number().over(Window.partitionBy("indicator").orderBy(F.col("ts").desc()))).where("k <= 8").select("indicator", "ts", "importance")


@query(f"""WITH {H1}, c AS (SELECT symbol, count(*) AS bars, min(bar_ts) AS first_ts, max(bar_ts) AS last_ts, epoch(max(bar_ts) - min(bar_ts))::BIGINT // 3600 + 1 AS expected FROM h1 GROUP BY symbol)
SELECT *, round(bars * 100.0::DOUBLE / expected, 4) AS completeness, row_number() OVER (ORDER BY bars, symbol) AS thinnest FROM c QUALIFY thinnest <= 10""")
def thinnest_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten symbols with the fewest hourly bars. One row a symbol is ordered."""
    h1 = bars.ticks_to_bars(tables.ticks(spark, sf_dir), 3600)
    seconds = lambda c: F.unix_seconds(F.to_timestamp_ltz(c))
    c = h1.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts"))
    c = c.withColumn("expected", F.floor((seconds(F.col("last_ts")) - seconds(F.col("first_ts"))) / 3600) + 1)
    c = c.withColumn("completeness", F.round(F.col("bars") * 100.0 / F.col("expected"), 4))
    return c.withColumn("thinnest", F.row_number().over(Window.orderBy("bars", "symbol"))).where("thinnest <= 10")


@query(f"""WITH {RELEASES} SELECT count(*) AS releases, count(DISTINCT indicator) AS indicators, count(forecast) AS with_forecast, count_if(importance <= 2)::BIGINT AS high, min(ts) AS earliest, max(ts) AS latest,
CASE WHEN count(*) > 0 THEN round(count_if(importance <= 2) * 100.0::DOUBLE / count(*), 4) END AS high_share FROM releases""")
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the whole calendar; shares are null where there is nothing to divide by."""
    high, n = F.count_if(F.col("importance") <= 2), F.count("*")
    return tables.releases(spark, sf_dir).agg(
        n.alias("releases"), F.count_distinct("indicator").alias("indicators"), F.count("forecast").alias("with_forecast"), high.alias("high"),
        F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.round(F.try_divide(high * 100.0, n), 4).alias("high_share"),
    )


@query("""SELECT o_orderkey AS trade, c_mktsegment AS session, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS snapshots,
(SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders JOIN customer ON o_custkey = c_custkey""")
def trades_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with two counts of what belongs to them, counted once for all before they are joined."""
    n = tables.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trade"))
    n = n.agg(F.count("*").alias("snapshots"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    c = tables.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("session"))
    o = tables.table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("trade"), "session")
    return o.join(n, "trade", "left").fillna(0, ["snapshots", "returned"])


@query("""WITH s AS (SELECT DISTINCT event_type AS symbol, 'h1' AS timeframe, 1 AS rank FROM events UNION ALL SELECT DISTINCT event_type, 'd1', 2 FROM events UNION ALL SELECT DISTINCT l_returnflag || l_linestatus, 'd1', 2 FROM lineitem)
SELECT symbol, arg_min(timeframe, rank) AS finest FROM s GROUP BY symbol""")
def finest_timeframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finest bars that are stored for each symbol."""
    events = tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.explode(F.array(F.lit("h1"), F.lit("d1"))).alias("timeframe"))
    stored = events.unionByName(tables.deals(spark, sf_dir).select("symbol", F.lit("d1").alias("timeframe")))
    rank = F.array_position(F.array(*[F.lit(t) for t in ("m1", "m15", "h1", "d1")]), F.col("timeframe"))
    return stored.groupBy("symbol").agg(F.min_by("timeframe", rank).alias("finest"))
