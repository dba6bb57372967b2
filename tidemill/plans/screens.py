"""What screens and stores ask for: findings in order, names and numbers as text, windows, money, look-ups with bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import clock, text
from tidemill.functions.literals import literal_table
from tidemill.operators import bars, consolidation, execution, market, study, summaries
from tidemill.plans.markets import _CUR, _FX_DAY, CURRENCIES, h1
from tidemill.plans.registry import ORACLES, TICKS, query, rounded
from tidemill.plans.summaries import _NAMES_SQL, CLOCK, NAMES
from tidemill.sources import store, tables

_M1 = TICKS + """, m1 AS (SELECT symbol, date_trunc('minute', ts)::TIMESTAMP AS bar_ts, first(bid ORDER BY ts, id) AS open, max(bid) AS high, min(bid) AS low, last(bid ORDER BY ts, id) AS close FROM ticks GROUP BY ALL)"""


def _m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.ticks_to_bars(tables.ticks(spark, sf_dir), 60)


def _names(key: str):
    return F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col(key) % len(NAMES)).cast("int"))


# Orders as the releases of a catalogue, nations as its indicators, suppliers as aliases
_CATALOGUE = """rel AS (SELECT o_orderkey AS id, (o_custkey % 20)::INT AS indicator, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::TIMESTAMP END AS release_ts, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::TIMESTAMP END AS scheduled_ts,
  o_orderkey % 5 = 0 AS provisional, ['', 'offset', 'uncheckable', 'no_spike'][(o_orderkey % 4 + 1)::INT] AS vol_check FROM orders)"""


def _catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    broken = F.when(key % 97 == 0, F.lit("-9223372036854.775808")).when(key % 89 == 0, F.lit("200000000000000000"))
    grades = F.array(*[F.lit(g) for g in ("", "offset", "uncheckable", "no_spike")])
    releases = tables.table(spark, sf_dir, "orders").select(
        key.alias("id"), (F.col("o_custkey") % 20).cast("int").alias("indicator"), F.when(key % 7 != 0, day).alias("release_ts"), F.when(key % 3 == 0, day).alias("scheduled_ts"),
        F.when(key % 5 == 0, text.provisional_key(day)).otherwise(F.date_format(day, "yyyy-MM")).alias("reference_period"), F.when(key % 5 != 0, day).alias("period_start"),
        F.when(key % 11 == 0, "disagree").otherwise("single").alias("cross_source"), F.get(grades, (key % 4).cast("int")).alias("vol_check"),
        F.coalesce(broken.cast("decimal(24,6)"), F.col("o_totalprice").cast("decimal(24,6)")).alias("actual_current"), F.lit(None).cast("decimal(24,6)").alias("previous"),
    )
    n = F.col("n_nationkey")
    indicators = tables.table(spark, sf_dir, "nation").select(
        n.cast("int").alias("indicator"), F.lit("USD").alias("currency"), F.concat(F.lit("Index "), (n % 20).cast("string")).alias("name"),
        F.when(n % 3 != 0, "CODE").alias("canonical_code"), F.when(n % 6 == 0, "ignored").otherwise("mapped").alias("mapping_status"),
    )
    aliases = tables.table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 9 != 0, F.col("s_nationkey") % 22).cast("int").alias("indicator"))
    return releases, indicators, aliases


@query(f"""WITH {_CATALOGUE}, t AS (SELECT count(*) AS t FROM rel), f(code, weight, n, total) AS (
SELECT 'no_timestamp', 'warning', count_if(release_ts IS NULL AND scheduled_ts IS NULL), count(*) FROM rel UNION ALL SELECT 'provisional_period', 'warning', count_if(provisional), count(*) FROM rel
UNION ALL SELECT 'cross_source', 'info', count_if(id % 11 = 0), count(*) FROM rel UNION ALL SELECT 'long_min_sentinel', 'blocking', count_if(id % 97 = 0), count(*) FROM rel
UNION ALL SELECT 'absurd_values', 'warning', count_if(id % 97 <> 0 AND id % 89 = 0), count(*) FROM rel UNION ALL SELECT 'missing_period_start', 'info', count_if(id % 5 = 0), count(*) FROM rel
UNION ALL SELECT 'vol_check', CASE WHEN count_if(vol_check IN ('offset', 'no_spike')) = 0 THEN 'warning' ELSE 'info' END, greatest(count(release_ts) - count_if(vol_check IN ('offset', 'no_spike')) - count_if(vol_check = 'uncheckable'), 0), count(*) FROM rel
UNION ALL SELECT 'provisional_duplicates', 'warning', coalesce(sum(n), 0), 0 FROM (SELECT count(*) - 1 AS n FROM rel WHERE provisional AND coalesce(release_ts, scheduled_ts) IS NOT NULL GROUP BY indicator, coalesce(release_ts, scheduled_ts)::DATE)
UNION ALL SELECT 'duplicate_indicators', 'warning', count(*) - count(DISTINCT n_nationkey % 20), count(*) FROM nation UNION ALL SELECT 'unmapped_indicators', 'warning', count_if(n_nationkey % 3 = 0 AND n_nationkey % 6 <> 0), count(*) FROM nation
UNION ALL SELECT 'fused_releases', 'warning', (SELECT count(*) FROM ({ORACLES['fused_releases']})), t FROM t
UNION ALL SELECT 'orphans', 'info', (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT indicator FROM rel) AND n_nationkey NOT IN (SELECT s_nationkey % 22 FROM supplier WHERE s_suppkey % 9 <> 0)) + (SELECT count(*) FROM supplier WHERE s_suppkey % 9 = 0), 0 FROM t
UNION ALL SELECT 'timestamp_offsets', 'warning', count_if(n_nationkey % 8 = 0), 0 FROM nation UNION ALL SELECT 'price_gaps', 'warning', count_if(expected > 0 AND gap_count > 0), count(*) FROM ({ORACLES['coverage_ledger']})),
s AS (SELECT code, CASE WHEN n > 0 OR code = 'vol_check' THEN weight ELSE 'ok' END AS severity, n::BIGINT AS count, total::BIGINT AS total FROM f)
SELECT *, row_number() OVER (ORDER BY list_position(['blocking', 'warning', 'info', 'ok'], severity), count DESC, code) AS place FROM s""")
def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen checks, the gravest first, of equal weight the largest."""
    releases, indicators, aliases = _catalogue(spark, sf_dir)
    payload = F.struct(F.struct(F.col("o_orderpriority").alias("id"), F.col("o_orderstatus").alias("actual")).alias("payload"))
    seen = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("release_id"), F.to_json(payload).alias("raw_json"))
    verdicts = indicators.select(F.when(F.col("indicator") % 8 == 0, "offset_clock").otherwise("aligned").alias("status"))
    found = consolidation.findings(releases, indicators, aliases, seen, bars.coverage(h1(spark, sf_dir), 60), verdicts)
    return summaries.placed(found, "severity", consolidation.SEVERITIES, "count", "code")


_STATUSES = ["offset_clock", "scattered", "aligned", "silent", "insufficient"]


@query("""WITH v AS (SELECT c_nationkey AS indicator, count(*) AS checked FROM customer GROUP BY 1), s AS (SELECT indicator, ['offset_clock', 'scattered', 'aligned', 'silent', 'insufficient', 'unknown'][(indicator % 6 + 1)::INT] AS status, checked FROM v)
SELECT *, row_number() OVER (ORDER BY list_position(['offset_clock', 'scattered', 'aligned', 'silent', 'insufficient', 'unknown'], status), checked DESC, indicator) AS place FROM s""")
def verdicts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts, wrong clocks first, then those that cannot be vouched for."""
    names = F.array(*[F.lit(s) for s in (*_STATUSES, "unknown")])
    v = tables.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("indicator")).agg(F.count("*").alias("checked"))
    return summaries.placed(v.withColumn("status", F.get(names, (F.col("indicator") % 6).cast("int"))), "status", _STATUSES, "checked", "indicator")


@query("""WITH s AS (SELECT DISTINCT o_custkey AS pairing, substr(o_orderpriority, 1, 1) AS version, year(o_orderdate) AS year FROM orders),
b AS (SELECT pairing, CASE WHEN bool_or(version = '3') THEN '3' ELSE max(version) END AS version FROM s GROUP BY 1) SELECT s.* FROM s JOIN b USING (pairing, version)""")
def newest_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of the current version, else of the newest there is."""
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pairing"), F.substring("o_orderpriority", 1, 1).alias("version"), F.year("o_orderdate").alias("year"))
    return summaries.newest_version(o.distinct(), ["pairing"], "version", "3")


@query(f"""WITH {_M1}, c AS (SELECT bar_ts + INTERVAL 1 MINUTE AS done, close FROM m1 WHERE symbol = 'click'), a AS (SELECT id, ts FROM ticks WHERE symbol = 'view')
SELECT id, round(1 / coalesce(close, (SELECT arg_min(close, done) FROM c)), 8) AS rate FROM a ASOF LEFT JOIN c ON a.ts >= c.done""")
def conversion_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of one instrument's last complete minute at each tick of another."""
    t = tables.ticks(spark, sf_dir)
    asked = t.where("symbol = 'view'").select("id", "ts")
    return rounded(summaries.conversion_rate(asked, _m1(spark, sf_dir).where("symbol = 'click'"), "ts", invert=True).select("id", "rate"), 8, "rate")


@query(f"""WITH {_M1}, {_CUR}, m AS (SELECT symbol, bar_ts, (close / first_value(open) OVER (PARTITION BY symbol, {_FX_DAY} ORDER BY bar_ts) - 1) * 100 AS move FROM m1),
s0 AS (SELECT bar_ts, base AS currency, move AS x FROM m JOIN cur USING (symbol) UNION ALL SELECT bar_ts, quote, -move FROM m JOIN cur USING (symbol)),
s AS (SELECT bar_ts, currency, count_if(x > 0)::BIGINT AS won, count(*) AS played, avg(x) AS strength FROM s0 GROUP BY ALL),
c AS (SELECT DISTINCT symbol, date_trunc('hour', bar_ts)::TIMESTAMP AS bar_ts FROM m1),
q AS (SELECT c.symbol, c.bar_ts, k.currency, least(c.bar_ts + INTERVAL 1 HOUR, TIMESTAMP '{CLOCK}') - INTERVAL 1 MINUTE AS at FROM c CROSS JOIN (SELECT DISTINCT currency FROM s) k WHERE c.bar_ts < TIMESTAMP '{CLOCK}'),
j AS (SELECT q.*, s.bar_ts AS found, won, played, strength FROM q ASOF LEFT JOIN s ON s.currency = q.currency AND q.at >= s.bar_ts)
SELECT symbol, bar_ts, currency, CASE WHEN found >= bar_ts THEN won END AS won, CASE WHEN found >= bar_ts THEN played END AS played, CASE WHEN found >= bar_ts THEN round(strength, 6) END AS strength FROM j""")
def candles_with_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles with the strength of their last complete minute, as far as the clock has come."""
    m1 = _m1(spark, sf_dir)
    now = F.lit(CLOCK).cast("timestamp_ntz")
    pairs = literal_table(spark, CURRENCIES, ["symbol", "base", "quote"], ["string"] * 3)
    rows = market.strength(market.period_moves(m1, clock.fx_day_start(F.col("bar_ts"))), pairs)
    candles = m1.select("symbol", F.date_trunc("hour", "bar_ts").cast("timestamp_ntz").alias("bar_ts")).distinct().where(F.col("bar_ts") < now)
    # each currency of the handful gets a row of its own
    names = literal_table(spark, [(c,) for c in sorted({x for _, a, b in CURRENCIES for x in (a, b)})], ["currency"], ["string"])
    asked = candles.crossJoin(F.broadcast(names)).withColumn("cutoff", F.least(F.col("bar_ts") + F.expr("INTERVAL 1 HOUR"), now))
    return rounded(summaries.last_closed(asked, rows, ["currency"], "cutoff", "bar_ts", ["won", "played", "strength"]).drop("cutoff"), 6, "strength")


@query(f"""WITH {TICKS}, a AS (SELECT id, symbol, ts + INTERVAL 10 MINUTE AS a, ts + INTERVAL 40 MINUTE AS b FROM ticks WHERE id % 5 = 0)
SELECT a.id, t.ts AS first_ts, t.id AS tick FROM a LEFT JOIN ticks t ON t.symbol = a.symbol AND t.ts BETWEEN a.a AND a.b QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY t.ts NULLS LAST, t.id) = 1""")
def first_tick_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tick from ten to forty minutes after every fifth tick."""
    t = tables.ticks(spark, sf_dir)
    later = lambda n: F.col("ts") + F.expr(f"INTERVAL {n} MINUTES")
    asked = t.where("id % 5 = 0").select("id", "symbol", later(10).alias("a"), later(40).alias("b"))
    rows = t.select("symbol", "ts", F.col("id").alias("tick"))
    return summaries.first_between(asked, rows, ["symbol"], "ts", "a", "b", ["tick"]).select("id", "first_ts", "tick")


@query("""SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END) AS t, n_name AS currency, substr(o_orderpriority, 1, 1)::INT AS importance, c_name AS name, r_name AS group_name
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND n_regionkey <> 0
WHERE n_nationkey IN (1, 2, 3, 5, 8) AND t IS NOT NULL AND o_orderstatus <> 'P' AND substr(o_orderpriority, 1, 1)::INT IN (1, 2, 3) AND c_mktsegment <> 'BUILDING'""".replace("AND t IS NOT NULL", "AND (o_orderkey % 7 <> 0 OR o_orderkey % 3 = 0)"))
def calendar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases of some currencies with their indicator and, where there is one, their group."""
    key = F.col("o_orderkey")
    t = F.coalesce(F.when(key % 7 != 0, F.col("o_orderdate")), F.when(key % 3 == 0, F.col("o_orderdate")))
    o = tables.table(spark, sf_dir, "orders").select(key.alias("id"), t.alias("t"), F.substring("o_orderpriority", 1, 1).cast("int").alias("importance"), "o_custkey", "o_orderstatus")
    i = tables.table(spark, sf_dir, "customer").where("c_nationkey in (1, 2, 3, 5, 8) and c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey"))
    n = tables.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("currency"), F.when(F.col("n_regionkey") != 0, F.col("n_regionkey")).alias("r_regionkey"))
    g = tables.table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("group_name"))
    met = o.where("t is not null and o_orderstatus <> 'P' and importance in (1, 2, 3)").join(i, "o_custkey").join(n, "n_nationkey").join(g, "r_regionkey", "left")
    return met.select("id", "t", "currency", "importance", "name", "group_name")


@query(f"WITH {_CATALOGUE} SELECT id, coalesce(release_ts, scheduled_ts) AS anchor FROM rel WHERE coalesce(release_ts, scheduled_ts) BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1996-05-31'")
def rows_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched rows whose release, or else whose schedule, lies in the window asked for."""
    anchor = F.coalesce("release_ts", "scheduled_ts")
    inside = anchor.between(F.lit("1995-03-01").cast("timestamp_ntz"), F.lit("1996-05-31").cast("timestamp_ntz"))
    return _catalogue(spark, sf_dir)[0].where(inside).select("id", anchor.alias("anchor"))


@query(f"""WITH {_M1}, n AS (SELECT symbol, count(*) AS n, count(DISTINCT date_trunc('hour', bar_ts)) AS a, count(DISTINCT (bar_ts::DATE, hour(bar_ts) // 4)) AS b, count(DISTINCT bar_ts::DATE) AS c, count(DISTINCT date_trunc('week', bar_ts)) AS d FROM m1 GROUP BY 1)
SELECT symbol, CASE WHEN n <= 100 THEN 'as stored' WHEN a <= 100 THEN '1h' WHEN b <= 100 THEN '4h' WHEN c <= 100 THEN '1D' ELSE '1W' END AS size, CASE WHEN n <= 100 THEN n WHEN a <= 100 THEN a WHEN b <= 100 THEN b WHEN c <= 100 THEN c ELSE d END AS candles FROM n""")
def drawn_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finest size at which at most a hundred candles are drawn."""
    return summaries.drawn_size(_m1(spark, sf_dir), 100)


@query("SELECT step::INT AS step, horizon FROM (VALUES (60), (900), (3600), (86400)) s(step), (VALUES " + ", ".join(f"('{n}', {s})" for n, s in study.LADDER.items()) + ") l(horizon, seconds) WHERE abs(seconds) >= step")
def supported_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rungs of the ladder bars of each size can answer."""
    return literal_table(spark, [(step, n) for step in (60, 900, 3600, 86400) for n in study.supported(step)], ["step", "horizon"], ["int", "string"])


@query(f"""WITH {TICKS}, s AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM ticks GROUP BY 1) SELECT symbol, kind, CASE kind WHEN 'all' THEN a WHEN 'span' THEN b - INTERVAL 90 DAY WHEN 'before' THEN greatest(a, TIMESTAMP '{CLOCK}' - INTERVAL 7 DAY) ELSE TIMESTAMP '{CLOCK}' - INTERVAL 5 DAY END AS window_start,
CASE kind WHEN 'before' THEN TIMESTAMP '{CLOCK}' WHEN 'focus' THEN TIMESTAMP '{CLOCK}' + INTERVAL 5 DAY ELSE b END AS window_end FROM s CROSS JOIN (VALUES ('all'), ('span'), ('before'), ('focus')) k(kind)""")
def chart_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window that a chart of each symbol shows: all, the last ninety days, a page before a moment, around a release."""
    s = tables.ticks(spark, sf_dir).groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    at = F.lit(CLOCK).cast("timestamp_ntz")
    days = lambda n: F.expr(f"INTERVAL {n} DAYS")
    kinds = [("all", F.col("a"), F.col("b")), ("span", F.col("b") - days(90), F.col("b")), ("before", F.greatest(F.col("a"), at - days(7)), at), ("focus", at - days(5), at + days(5))]
    return s.select("symbol", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("window_start"), y.alias("window_end")) for k, x, y in kinds])))


_CUT = "regexp_replace(round({0}, {1})::DECIMAL(30,{1})::VARCHAR, '\\.?0+$', '')"


def _powers_sql(places: int, cond: str, rest: str) -> str:
    # decimals on both sides: a quotient of doubles lies to either side of a tie
    cut = lambda power: _CUT.format(f"(v * 0.{'0' * (power - 1)}1::DECIMAL({power + 1},{power}))", places)
    return f"CASE WHEN {cond} abs(v) >= 1000000 THEN {cut(6)} || 'M' WHEN {cond} abs(v) >= 1000 THEN {cut(3)} || 'K' ELSE {rest} END"


@query(f"""WITH x AS (SELECT o_orderkey, (CASE o_orderkey % 3 WHEN 0 THEN -1 WHEN 1 THEN 100 ELSE 0.001 END * CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) ELSE o_totalprice END)::DECIMAL(18,6) AS v, {_NAMES_SQL}[o_orderkey % 14 + 1] AS name FROM orders)
SELECT o_orderkey, {_powers_sql(2, '', "CASE WHEN abs(v) >= 100 THEN " + _CUT.format('v', 3) + " WHEN abs(v) >= 10 THEN " + _CUT.format('v', 4) + " WHEN abs(v) >= 1 THEN " + _CUT.format('v', 5) + " ELSE " + _CUT.format('v', 6) + " END")} AS marker_text,
{_powers_sql(3, 'v = floor(v) AND', _CUT.format('v', 4) + " || CASE WHEN regexp_matches(lower(name), '\\b[mqy]/[mqy]\\b|\\brate\\b') THEN '%' ELSE '' END")} AS calendar_text FROM x""")
def numbers_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures as they stand beside a marker and in a calendar."""
    key = F.col("o_orderkey")
    price = F.when(key % 2 == 0, F.floor("o_totalprice")).otherwise(F.col("o_totalprice")).cast("decimal(18,6)")
    scale = F.when(key % 3 == 0, F.lit("-1")).when(key % 3 == 1, F.lit("100")).otherwise(F.lit("0.001")).cast("decimal(6,3)")
    x = tables.table(spark, sf_dir, "orders").select("o_orderkey", (price * scale).cast("decimal(18,6)").alias("v"), _names("o_orderkey").alias("name"))
    return x.select("o_orderkey", text.marker_number(F.col("v")).alias("marker_text"), text.calendar_number(F.col("v"), F.col("name")).alias("calendar_text"))


@query(f"""WITH x AS (SELECT p_size AS grp, p_partkey, {_NAMES_SQL}[p_partkey % 14 + 1] || ' of ' || p_size || ' m/m Survey' AS label FROM part),
g AS (SELECT grp, list(label ORDER BY p_partkey) AS labels FROM x GROUP BY 1), w AS (SELECT *, regexp_extract_all(labels[1], '[A-Za-z]+') AS first, list_transform(labels, lambda l: regexp_extract_all(lower(l), '[a-z]+')) AS every FROM g),
k AS (SELECT *, list_filter(first, lambda w, i: lower(w) NOT IN ('m', 'y', 'q') AND list_position(list_transform(first, lambda f: lower(f)), lower(w)) = i AND len(list_filter(every, lambda e: NOT list_contains(e, lower(w)))) = 0) AS kept FROM w),
n AS (SELECT grp, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') || ' release' ELSE array_to_string(labels, ' + ') END AS name FROM k)
SELECT grp, name, substr('usd_' || regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 100) AS key FROM n""")
def group_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of groups of releases by the words that their members share."""
    label = F.concat(_names("p_partkey"), F.lit(" of "), F.col("p_size").cast("string"), F.lit(" m/m Survey"))
    x = tables.table(spark, sf_dir, "part").select(F.col("p_size").alias("grp"), F.lit("USD").alias("currency"), label.alias("label"), "p_partkey")
    return summaries.group_names(x, "grp", "currency", "label", "p_partkey")


_REQUESTS = f"""{TICKS}, q AS (SELECT id, bid, ask, CASE id % 11 WHEN 0 THEN 0 ELSE CASE id % 2 WHEN 0 THEN 1 ELSE -1 END END AS side, ['market', 'limit', 'stop', 'other'][(id % 4 + 1)::INT] AS kind,
  CASE WHEN id % 13 <> 0 THEN bid + (id % 7 - 3) * 0.5::DOUBLE END AS price, CASE WHEN id % 3 <> 0 THEN bid + (id % 9 - 4)::DOUBLE END AS stop, CASE WHEN id % 5 <> 0 THEN bid + (id % 10 - 4) * 1.5::DOUBLE END AS target,
  CASE WHEN id % 17 <> 0 THEN (id % 121) * 0.9::DOUBLE END AS lots FROM ticks)"""


@query(f"""WITH {_REQUESTS}, r AS (SELECT *, lots * 1000 * ask / 50 AS needed, 100000::DOUBLE AS free, kind <> 'market' AS waits, side > 0 AS buys, CASE WHEN kind <> 'market' THEN price WHEN side > 0 THEN ask ELSE bid END AS entry,
 CASE WHEN kind <> 'market' THEN price WHEN side > 0 THEN bid ELSE ask END AS leave, CASE WHEN side > 0 THEN ask ELSE bid END AS mk, (side > 0) = (kind = 'limit') AS below FROM q)
SELECT id, round(needed, 4) AS needed, round(abs(ask - stop) / 0.01::DOUBLE, 1) AS pips, round(side * (bid - ask) * lots * 1000, 4) AS gain, CASE WHEN side = 0 THEN 'side' WHEN kind = 'other' THEN 'type' WHEN waits AND price IS NULL THEN 'needs a price'
WHEN waits AND below AND NOT price < mk THEN 'must be below the market' WHEN waits AND NOT below AND NOT price > mk THEN 'must be above the market' WHEN stop IS NOT NULL AND NOT CASE WHEN buys THEN stop < leave ELSE stop > leave END THEN 'stop loss on the wrong side'
WHEN target IS NOT NULL AND NOT CASE WHEN buys THEN target > entry ELSE target < entry END THEN 'target on the wrong side' WHEN lots IS NULL THEN 'needs a size' WHEN round(lots, 2) < 0.01 THEN 'size too small' WHEN round(lots, 2) > 100 THEN 'size too large'
WHEN needed > free THEN 'not enough margin' END AS refused FROM r""")
def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for orders with their margin, stop distance and what crossing the spread costs, and why they are refused."""
    i, bid = F.col("id"), F.col("bid")
    some = lambda n, value: F.when(i % n != 0, value)
    kinds = F.array(*[F.lit(k) for k in ("market", "limit", "stop", "other")])
    q = tables.ticks(spark, sf_dir).select(
        "id", "bid", "ask", F.when(i % 11 == 0, 0).when(i % 2 == 0, 1).otherwise(-1).alias("side"), F.get(kinds, (i % 4).cast("int")).alias("kind"), some(13, bid + (i % 7 - 3) * 0.5).alias("price"),
        some(3, bid + (i % 9 - 4)).alias("stop"), some(5, bid + (i % 10 - 4) * 1.5).alias("target"), some(17, (i % 121) * 0.9).alias("lots"), F.lit(100000.0).alias("free"),
    )
    one, contract = F.lit(1.0), F.lit(1000)
    q = q.withColumn("needed", execution.margin(F.col("lots"), F.col("ask"), contract, one, F.lit(50), F.lit(False)))
    money = execution.gross(F.col("side"), F.col("ask"), bid, F.col("lots"), contract, one)
    out = execution.refusals(q).select("id", "needed", execution.stop_pips(F.col("ask"), F.col("stop"), F.lit(0.01)).alias("pips"), money.alias("gain"), "refused")
    return rounded(out, 4, "needed", "gain")


@query("SELECT json_object('n_nationkey', n_nationkey, 'n_name', n_name) AS sample FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 25)")
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 rows as JSON; the limit is what a preview is for."""
    return store.preview(tables.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
