"""Bars, clocks, as-of lookups and market analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import clock
from tidemill.functions.literals import literal_table
from tidemill.operators import asof, bars, execution, market
from tidemill.operators.shared import new_folder, settled
from tidemill.plans.registry import D1, FROM_NY, H1, NY, ORACLES, TICKS, query, rounded
from tidemill.sources import tables
from tidemill.sources.months import MonthStore


def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.ticks_to_bars(tables.ticks(spark, sf_dir), 3600)


def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.deals_to_bars(tables.deals(spark, sf_dir))


@query(f"WITH {H1} SELECT symbol, bar_ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, "
       "round(spread_mean, 6) AS spread_mean, round(spread_last, 6) AS spread_last, tick_count FROM h1")  # fmt: skip
def ticks_to_bars_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(h1(spark, sf_dir), 6, "open", "high", "low", "close", "spread_mean", "spread_last")


@query(f"WITH {D1} SELECT symbol, bar_ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, "
       "round(volume, 4) AS volume, tick_count FROM d1")  # fmt: skip
def deals_to_bars_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(d1(spark, sf_dir), 8, "open", "high", "low", "close"), 4, "volume")


_RESAMPLED = (
    "SELECT symbol, bucket_ts, round(first(open ORDER BY bar_ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, "
    "round(last(close ORDER BY bar_ts), 6) AS close, round(sum({v})::DOUBLE, 4) AS volume, count(*) AS n_bars FROM ({src}) GROUP BY symbol, bucket_ts"
)


@query(f"WITH {H1} " + _RESAMPLED.format(v="tick_count", src="SELECT *, date_trunc('day', bar_ts)::TIMESTAMP AS bucket_ts FROM h1"))
def resample_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bars.resample(h1(spark, sf_dir), F.date_trunc("day", "bar_ts").cast("timestamp_ntz"))
    return rounded(rounded(out, 6, "open", "high", "low", "close"), 4, "volume")


@query(f"WITH {D1} " + _RESAMPLED.format(
    v="volume", src="SELECT *, (bar_ts::DATE + ((7 - isodow(bar_ts)) % 7)::INT)::TIMESTAMP AS bucket_ts FROM d1"))
def resample_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bars.resample(d1(spark, sf_dir), bars.week_label(F.col("bar_ts")), "volume")
    return rounded(rounded(out, 6, "open", "high", "low", "close"), 4, "volume")


_FX_DAY = FROM_NY.format("(date_trunc('day', " + NY.format("bar_ts") + " - INTERVAL 17 HOUR) + INTERVAL 17 HOUR)")


@query(f"WITH {H1} " + _RESAMPLED.format(v="tick_count", src=f"SELECT *, {_FX_DAY}::TIMESTAMP AS bucket_ts FROM h1"))
def fx_day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bars.resample(h1(spark, sf_dir), clock.fx_day_start(F.col("bar_ts")))
    return rounded(rounded(out, 6, "open", "high", "low", "close"), 4, "volume")


@query(f"""WITH {D1}, g AS (SELECT symbol, (epoch(bar_ts) - epoch(lag(bar_ts) OVER (PARTITION BY symbol ORDER BY bar_ts)))::BIGINT AS gap FROM d1),
c AS (SELECT symbol, gap, count(*) AS n FROM g WHERE gap > 0 GROUP BY ALL)
SELECT symbol, first(gap ORDER BY n DESC, gap) AS spacing FROM c GROUP BY symbol""")
def bar_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.bar_spacing(d1(spark, sf_dir))


# open seconds of the market: whole weeks since a fixed Sunday, and the part of the current one
_SUNDAY = "(({ny} - INTERVAL 17 HOUR)::DATE - (isodow({ny} - INTERVAL 17 HOUR) % 7)::INT)"


def _open_seconds(ts: str) -> str:
    sunday = _SUNDAY.format(ny=NY.format(ts))
    opened = FROM_NY.format(f"({sunday}::TIMESTAMP + INTERVAL 17 HOUR)")
    return (
        f"((date_diff('day', DATE '1969-12-28', {sunday}) // 7) * 432000 + "
        f"greatest(0, least(432000, floor(epoch({ts}))::BIGINT - epoch({opened})::BIGINT)))"
    )


@query(f"""WITH {H1}, m AS (SELECT symbol, date_trunc('month', bar_ts)::DATE AS month, count(*) AS bar_count, min(bar_ts) AS first_ts, max(bar_ts) AS last_ts
  FROM h1 GROUP BY ALL), e AS (SELECT *, month::TIMESTAMP AS a, (month + INTERVAL 1 MONTH)::TIMESTAMP AS b FROM m),
f AS (SELECT *, (({_open_seconds('b')} - {_open_seconds('a')}) // 60 // 60)::BIGINT AS expected FROM e)
SELECT symbol, month, bar_count, first_ts, last_ts, expected, greatest(0, expected - bar_count)::BIGINT AS gap_count FROM f""")
def coverage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bars.coverage(h1(spark, sf_dir), 60)
    return out.withColumn("gap_count", F.col("gap_count").cast("long"))


@query(f"""WITH {D1}, s AS (SELECT symbol, min(bar_ts)::DATE AS a, max(bar_ts)::DATE AS b FROM d1 GROUP BY 1),
x AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM s)
SELECT symbol, day FROM x WHERE isodow(day) <> 6 AND NOT EXISTS (SELECT 1 FROM d1 WHERE d1.symbol = x.symbol AND d1.bar_ts::DATE = x.day)""")
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.missing_days(d1(spark, sf_dir))


_CLEAN = f"""WITH {TICKS}, s AS (SELECT symbol, ts::DATE AS day, quantile_cont(ask - bid, 0.5) FILTER (ask >= bid AND ask > 0 AND bid > 0) AS ms FROM ticks GROUP BY ALL),
k AS (SELECT *, ts::DATE AS day, (ask + bid) / 2 AS mid FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY id DESC) = 1),
w AS (SELECT k.*, ms, (epoch_us(ts) - epoch_us(lag(ts) OVER o)) AS gap, median(mid) OVER c AS mm, stddev_samp(mid) OVER c AS sd
  FROM k JOIN s USING (symbol, day) WINDOW o AS (PARTITION BY symbol, day ORDER BY ts),
  c AS (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN 500 PRECEDING AND 499 FOLLOWING)),
f AS (SELECT id, symbol, day, ts, round(bid, 6) AS bid, round(ask, 6) AS ask, CASE WHEN NOT (ask >= bid AND ask > 0 AND bid > 0) THEN 2 WHEN ask - bid > 10 * ms THEN 1
  WHEN gap > 5000000 AND NOT (isodow(ts) > 5 OR (isodow(ts) = 5 AND hour(ts) >= 22)) THEN 3 WHEN abs(mid - mm) > 5 * sd THEN 4 ELSE 0 END AS flag FROM w)"""


@query(_CLEAN + " SELECT * FROM f")
def tick_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.clean_ticks(tables.ticks(spark, sf_dir)), 6, "bid", "ask")


@query(_CLEAN + " SELECT symbol, day, " + ", ".join(f"count_if(flag = {i})::BIGINT AS flag_{i}" for i in range(5)) + ", count(*) AS n FROM f GROUP BY symbol, day")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.flag_counts(bars.clean_ticks(tables.ticks(spark, sf_dir)))


_DAY_ROLLED = "((" + NY.format("ts") + " + INTERVAL 7 HOUR)::DATE)"


@query(f"""WITH {TICKS} SELECT id, (CASE isodow(d) WHEN 6 THEN d + 2 WHEN 7 THEN d + 1 ELSE d END)::DATE AS trading_day FROM (SELECT id, {_DAY_ROLLED} AS d FROM ticks)""")
def trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ticks(spark, sf_dir).select("id", clock.trading_day(F.col("ts")).alias("trading_day"))


@query(f"""WITH {TICKS} SELECT id, (date_trunc('hour', ts) - CASE WHEN hour(ts) >= 22 THEN hour(ts) - 22 WHEN hour(ts) >= 16 THEN hour(ts) - 16
  WHEN hour(ts) >= 12 THEN hour(ts) - 12 WHEN hour(ts) >= 7 THEN hour(ts) - 7 ELSE hour(ts) + 2 END * INTERVAL 1 HOUR)::TIMESTAMP AS session_start,
  {FROM_NY.format("(" + _SUNDAY.format(ny=NY.format("ts")) + "::TIMESTAMP + INTERVAL 17 HOUR)")}::TIMESTAMP AS week_start,
  epoch({NY.format("ts")})::BIGINT - epoch(ts)::BIGINT = -14400 AS summer FROM ticks""")
def session_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return tables.ticks(spark, sf_dir).select(
        "id", clock.session_start(ts).alias("session_start"), clock.fx_week_start(ts).alias("week_start"), clock.is_summer_time(ts).alias("summer")
    )


@query(f"""SELECT o_orderkey, ({_open_seconds('b')} - {_open_seconds('a')})::BIGINT AS open_seconds
FROM (SELECT o_orderkey, o_orderdate::TIMESTAMP AS a, (o_orderdate + INTERVAL 30 HOUR)::TIMESTAMP AS b FROM orders)""")
def open_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate")
    length = clock.open_seconds_between(start, start + F.expr("INTERVAL 30 HOURS")).cast("long")
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", length.alias("open_seconds"))


_USERS = """p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
o AS (SELECT user_id, ts, event_id AS other_id, value AS other_value FROM events WHERE event_type <> 'purchase')"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = tables.table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    return left, e.where("event_type <> 'purchase'").select("user_id", "ts", F.col("event_id").alias("other_id"), F.col("value").alias("other_value"))


@query(f"WITH {_USERS} SELECT p.event_id, p.user_id, o.other_id, round(o.other_value, 6) AS other_value, o.ts AS asof_ts FROM p ASOF LEFT JOIN o ON p.user_id = o.user_id AND p.ts >= o.ts")
def asof_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    met = asof.asof_backward(left, right, ["user_id"], "ts", "ts", ["other_id", "other_value"], ["other_id"])
    return rounded(met.select("event_id", "user_id", "other_id", "other_value", "asof_ts"), 6, "other_value")


@query(f"""WITH {_USERS}, m AS (SELECT p.event_id, p.ts AS asked_ts, o.other_id, o.ts AS asof_ts FROM p ASOF LEFT JOIN o ON p.user_id = o.user_id AND p.ts >= o.ts)
SELECT event_id, CASE WHEN epoch_us(asked_ts) - epoch_us(asof_ts) <= 345600000000 THEN other_id END AS other_id,
  CASE WHEN epoch_us(asked_ts) - epoch_us(asof_ts) <= 345600000000 THEN asof_ts END AS asof_ts FROM m""")
def asof_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    met = asof.asof_within(left, right, ["user_id"], "ts", "ts", ["other_id"], 4 * 86400, tie=["other_id"])
    return met.select("event_id", "other_id", "asof_ts")


@query(f"""WITH {_USERS} SELECT p.event_id, (SELECT count(*) FROM o WHERE o.user_id = p.user_id AND o.ts >= p.ts - INTERVAL 12 HOUR AND o.ts <= p.ts + INTERVAL 12 HOUR) AS n FROM p""")
def range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    half = F.expr("INTERVAL 12 HOURS")
    return asof.count_between(right, left, ["user_id"], "ts", F.col("ts") - half, F.col("ts") + half).select("event_id", F.col("n").cast("long").alias("n"))


@query(f"""WITH {H1}, m AS (SELECT event_id, event_type AS symbol, (ts - INTERVAL 40 MINUTE)::TIMESTAMP AS marker_ts FROM events WHERE event_type = 'error'),
s AS (SELECT symbol, max(bar_ts) AS hi FROM h1 GROUP BY 1)
SELECT m.event_id, h.bar_ts, round(h.close, 6) AS close FROM m ASOF JOIN h1 h ON m.symbol = h.symbol AND m.marker_ts >= h.bar_ts JOIN s ON s.symbol = m.symbol
WHERE m.marker_ts < s.hi + INTERVAL 1 HOUR""")
def marker_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers on the bar that holds them; those outside the bars are dropped."""
    b = h1(spark, sf_dir)
    e = tables.table(spark, sf_dir, "events").where("event_type = 'error'")
    marks = e.select("event_id", F.col("event_type").alias("symbol"), (F.col("ts") - F.expr("INTERVAL 40 MINUTES")).alias("marker_ts"))
    met = asof.asof_backward(marks, b, ["symbol"], "marker_ts", "bar_ts", ["bar_ts", "close"])
    ends = b.groupBy("symbol").agg(F.max("bar_ts").alias("hi"))
    met = met.join(F.broadcast(ends), "symbol").where((F.col("marker_ts") < F.col("hi") + F.expr("INTERVAL 1 HOUR")) & F.col("asof_ts").isNotNull())
    return rounded(met.select("event_id", "bar_ts", "close"), 6, "close")


#: Symbols as pairs of currencies, for strength.
CURRENCIES = [("click", "AAA", "BBB"), ("view", "AAA", "CCC"), ("purchase", "BBB", "CCC"), ("signup", "AAA", "DDD"), ("error", "BBB", "DDD")]
_CUR = "cur(symbol, base, quote) AS (VALUES " + ", ".join(str(c) for c in CURRENCIES) + ")"


def _strength(spark: SparkSession, moves: DataFrame) -> DataFrame:
    pairs = literal_table(spark, CURRENCIES, ["symbol", "base", "quote"], ["string"] * 3)
    return rounded(market.strength(moves, pairs), 6, "strength")


def _strength_sql(moves: str) -> str:
    return f"""WITH {H1}, {_CUR}, m AS ({moves}),
s AS (SELECT bar_ts, base AS currency, move AS x FROM m JOIN cur USING (symbol) UNION ALL SELECT bar_ts, quote, -move FROM m JOIN cur USING (symbol))
SELECT bar_ts, currency, count_if(x > 0)::BIGINT AS won, count(*) AS played, round(avg(x), 6) AS strength FROM s WHERE x IS NOT NULL GROUP BY ALL"""


_MOVE = "SELECT symbol, bar_ts, (close / first_value(open) OVER (PARTITION BY symbol, {p} ORDER BY bar_ts) - 1) * 100 AS move FROM h1"


@query(_strength_sql(_MOVE.format(p=_FX_DAY)))
def strength_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strength(spark, market.period_moves(h1(spark, sf_dir), clock.fx_day_start(F.col("bar_ts"))))


@query(_strength_sql(_MOVE.format(p=FROM_NY.format("(" + _SUNDAY.format(ny=NY.format("bar_ts")) + "::TIMESTAMP + INTERVAL 17 HOUR)"))))
def strength_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strength(spark, market.period_moves(h1(spark, sf_dir), clock.fx_week_start(F.col("bar_ts"))))


@query(_strength_sql("""SELECT a.symbol, a.bar_ts, CASE WHEN a.at - h.bar_ts <= INTERVAL 4 DAY THEN (a.close / h.close - 1) * 100 END AS move
  FROM (SELECT *, bar_ts - INTERVAL 24 HOUR AS at FROM h1) a ASOF LEFT JOIN h1 h ON a.symbol = h.symbol AND a.at >= h.bar_ts"""))
def strength_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves over 24 hours, against the last close known then (at most four days old)."""
    b = h1(spark, sf_dir).select("symbol", "bar_ts", "close")
    asked = b.withColumn("at", F.col("bar_ts") - F.expr("INTERVAL 24 HOURS"))
    met = asof.asof_within(asked, b.withColumnRenamed("close", "then"), ["symbol"], "at", "bar_ts", ["then"], 4 * 86400)
    return _strength(spark, met.select("symbol", "bar_ts", ((F.col("close") / F.col("then") - 1) * 100).alias("move")))


@query(f"""WITH {H1}, s AS (SELECT symbol, bar_ts, high, low, max(high) OVER b AS hb, max(high) OVER a AS ha, min(low) OVER b AS lb, min(low) OVER a AS la,
  count(*) OVER b AS nb, count(*) OVER a AS na, lead(bar_ts, 2) OVER (PARTITION BY symbol ORDER BY bar_ts) AS known_ts FROM h1
  WINDOW b AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING),
         a AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))
SELECT symbol, bar_ts, known_ts, 'high' AS kind, round(high, 6) AS price FROM s WHERE nb = 2 AND na = 2 AND high > hb AND high >= ha
UNION ALL SELECT symbol, bar_ts, known_ts, 'low', round(low, 6) FROM s WHERE nb = 2 AND na = 2 AND low < lb AND low <= la""")
def swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.swings(h1(spark, sf_dir)), 6, "price")


_RECURSE = """, r AS (SELECT symbol, bar_ts, {v} AS v, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS k FROM {src}),
e AS (WITH RECURSIVE f AS (SELECT symbol, k, v AS x FROM r WHERE k = 1 UNION ALL
  SELECT r.symbol, r.k, CASE WHEN r.k <= {n} THEN f.x + (r.v - f.x) / r.k ELSE f.x + {w} * (r.v - f.x) END FROM f JOIN r ON r.symbol = f.symbol AND r.k = f.k + 1)
  SELECT f.symbol, r.bar_ts, f.k, f.x FROM f JOIN r USING (symbol, k))"""
_TR = """, t AS (SELECT *, coalesce(greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)), high - low) AS tr
  FROM h1 WINDOW o AS (PARTITION BY symbol ORDER BY bar_ts))"""


@query(f"WITH {H1}" + _RECURSE.format(v="close", src="h1", n=20, w="(2.0::DOUBLE / 21)") + " SELECT symbol, bar_ts, CASE WHEN k >= 20 THEN round(x, 6) END AS ema FROM e")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.ema(h1(spark, sf_dir)), 6, "ema")


@query(f"WITH {H1}{_TR}" + _RECURSE.format(v="tr", src="t", n=14, w="(1.0::DOUBLE / 14)") + " SELECT symbol, bar_ts, round(x, 6) AS atr FROM e")
def atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.atr(h1(spark, sf_dir)), 6, "atr")


@query(f"WITH {H1}{_TR}" + _RECURSE.format(v="tr", src="t", n=14, w="(1.0::DOUBLE / 14)") + """,
g AS (SELECT h.symbol, h.bar_ts, h.high, h.low, x AS atr, lag(h.high, 2) OVER o AS h2, lag(h.low, 2) OVER o AS l2
  FROM h1 h JOIN e ON e.symbol = h.symbol AND e.bar_ts = h.bar_ts WINDOW o AS (PARTITION BY h.symbol ORDER BY h.bar_ts))
SELECT symbol, bar_ts, CASE WHEN low > h2 AND low - h2 >= 0.3 * atr THEN 'up' ELSE 'down' END AS side,
  round(CASE WHEN low > h2 AND low - h2 >= 0.3 * atr THEN h2 ELSE high END, 6) AS bottom, round(CASE WHEN low > h2 AND low - h2 >= 0.3 * atr THEN low ELSE l2 END, 6) AS top
FROM g WHERE (low > h2 AND low - h2 >= 0.3 * atr) OR (l2 > high AND l2 - high >= 0.3 * atr)""")
def fair_value_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = h1(spark, sf_dir)
    return rounded(market.fair_value_gaps(b, market.atr(b)), 6, "bottom", "top")


_LEVELS = f"""dd AS (SELECT symbol, {_FX_DAY}::TIMESTAMP AS day, max(high) AS high, min(low) AS low FROM h1 GROUP BY ALL),
lv AS (SELECT symbol, day, lag(high) OVER o AS prev_high, lag(low) OVER o AS prev_low, max(high) OVER r AS range_high, min(low) OVER r AS range_low FROM dd
  WINDOW o AS (PARTITION BY symbol ORDER BY day), r AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {H1}, {_LEVELS} SELECT symbol, day, round(prev_high, 6) AS prev_high, round(prev_low, 6) AS prev_low, round(range_high, 6) AS range_high, round(range_low, 6) AS range_low FROM lv")
def previous_day_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.previous_day_levels(h1(spark, sf_dir)), 6, "prev_high", "prev_low", "range_high", "range_low")


_M15 = TICKS + """, m15 AS (SELECT symbol, to_timestamp(floor(epoch(ts) / 900) * 900)::TIMESTAMP AS bar_ts, max(bid) AS high, min(bid) AS low, last(bid ORDER BY ts, id) AS close FROM ticks GROUP BY 1, 2)"""


@query(f"""WITH {H1}, {_M15[len(TICKS) + 2:]}, {_LEVELS}, ll AS (SELECT symbol, 'sell' AS side, prev_high AS price, day AS known FROM lv WHERE prev_high IS NOT NULL
  UNION ALL SELECT symbol, 'buy', prev_low, day FROM lv WHERE prev_low IS NOT NULL),
mt AS (SELECT ll.*, bar_ts, CASE side WHEN 'sell' THEN high ELSE low END AS extreme, CASE side WHEN 'sell' THEN high > price ELSE low < price END AS through,
  CASE side WHEN 'sell' THEN close > price ELSE close < price END AS beyond FROM ll JOIN m15 ON m15.symbol = ll.symbol AND bar_ts >= known AND bar_ts < known + INTERVAL 5 DAY),
br AS (SELECT symbol, side, known, min(bar_ts) FILTER (beyond) AS b FROM mt GROUP BY ALL)
SELECT symbol, side, known AS known_ts, round(price, 6) AS price, bar_ts, round(extreme, 6) AS extreme, beyond AS broke FROM mt JOIN br USING (symbol, side, known)
WHERE (beyond OR through) AND (b IS NULL OR bar_ts <= b)""")
def sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeps and breaks of the previous market day's high and low on 15-minute bars, for five days."""
    quarter = bars.ticks_to_bars(tables.ticks(spark, sf_dir), 900)
    levels = market.day_edges(market.previous_day_levels(h1(spark, sf_dir)), days=5)
    return rounded(market.track_levels(levels, quarter).drop("expires_ts"), 6, "price", "extreme")


@query(f"""WITH {H1}, o AS (SELECT symbol, bar_ts, (epoch(bar_ts)::BIGINT // 3600) AS slot, tick_count::DOUBLE AS v FROM h1),
x AS (SELECT a.symbol, a.slot, avg(b.v) AS m, count(*) AS n FROM o a, (SELECT -24 * d + k AS s FROM range(1, 6) t(d), range(-2, 3) u(k)) st
  JOIN o b ON b.symbol = a.symbol AND b.slot = a.slot + st.s GROUP BY ALL)
SELECT o.symbol, o.bar_ts, CASE WHEN n >= 5 AND m > 0 THEN round(v / m, 6) END AS rel_volume FROM o LEFT JOIN x USING (symbol, slot)""")
def relative_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.relative_volume(h1(spark, sf_dir), 3600), 6, "rel_volume")


_PROFILE = f"""WITH {H1}, b AS (SELECT symbol, {_FX_DAY}::TIMESTAMP AS period, floor(low * 0.1::DOUBLE)::INT AS a, floor(high * 0.1::DOUBLE)::INT AS z, tick_count FROM h1),
p AS (SELECT symbol, period, bin, sum(tick_count / (z - a + 1)) AS volume FROM (SELECT *, unnest(generate_series(a, z)) AS bin FROM b) GROUP BY ALL)"""


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.volume_profile(h1(spark, sf_dir), clock.fx_day_start(F.col("bar_ts")), 0.1)


@query(_PROFILE + " SELECT symbol, period, bin::INT AS bin, round(volume, 6) AS volume FROM p")
def volume_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_profile(spark, sf_dir), 6, "volume")


@query(_PROFILE + " SELECT symbol, period, first(bin ORDER BY round(volume, 6) DESC, bin)::INT AS poc_bin, round(sum(volume), 6) AS volume, count(*) AS bins FROM p GROUP BY symbol, period")
def point_of_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.point_of_control(_profile(spark, sf_dir)), 6, "volume")


_VALUE_AREA = f"""WITH RECURSIVE {H1}, b AS (SELECT symbol, {_FX_DAY}::TIMESTAMP AS period, low, high, tick_count::DOUBLE AS v FROM h1),
s AS (SELECT symbol, period, min(low) AS lo, max(high) AS hi, greatest(1, ceil((max(high) - min(low)) / 0.01::DOUBLE / 80)) * 0.01::DOUBLE AS step FROM b GROUP BY ALL HAVING count(*) >= 5),
t AS (SELECT *, floor(lo / step + 1e-9) * step AS base FROM s), u AS (SELECT *, floor((hi - base) / step + 1e-9)::INT AS last FROM t),
e AS (SELECT symbol, period, floor((low - base) / step + 1e-9)::INT AS a, floor((high - base) / step + 1e-9)::INT AS z, v FROM b JOIN u USING (symbol, period)),
f AS (SELECT symbol, period, r, round(sum(v / (z - a + 1)), 9) AS v FROM (SELECT *, unnest(generate_series(a, z))::INT AS r FROM e) GROUP BY ALL),
g AS (SELECT symbol, period, base, step, last, unnest(generate_series(0, last))::INT AS r FROM u),
d AS (SELECT symbol, period, base, step, last, list(coalesce(v, 0) ORDER BY r) AS vol FROM g LEFT JOIN f USING (symbol, period, r) GROUP BY ALL),
p AS (SELECT *, list_position(vol, list_max(vol)) - 1 AS poc, 0.7::DOUBLE * list_sum(vol) AS want FROM d),
w AS (SELECT symbol, period, base, step, last, vol, poc, want, poc AS lo, poc AS hi, list_max(vol) AS acc FROM p UNION ALL
 SELECT symbol, period, base, step, last, vol, poc, want, CASE WHEN up >= dn THEN lo ELSE greatest(lo - 2, 0) END, CASE WHEN up >= dn THEN least(hi + 2, last) ELSE hi END, acc + greatest(up, dn) FROM
 (SELECT *, CASE WHEN hi < last THEN coalesce(list_sum(vol[hi + 2:hi + 3]), 0) ELSE -1 END AS up, CASE WHEN lo > 0 THEN coalesce(list_sum(vol[greatest(lo - 2, 0) + 1:lo]), 0) ELSE -1 END AS dn FROM w WHERE acc < want AND (lo > 0 OR hi < last)))
SELECT symbol, period, round(base + (poc + 0.5) * step, 6) AS poc, round(base + (max(hi) + 1) * step, 6) AS high_edge, round(base + min(lo) * step, 6) AS low_edge FROM w GROUP BY symbol, period, base, step, poc"""


@query(_VALUE_AREA)
def value_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.value_area(h1(spark, sf_dir), clock.fx_day_start(F.col("bar_ts")), 0.01), 6, "poc", "high_edge", "low_edge")


@query(f"""WITH {H1}, x AS (SELECT symbol, bar_ts, close - open AS body, high - low AS rng, close - low AS up, high - close AS dn, avg(abs(close - open)) OVER w AS normal FROM h1
  WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, bar_ts, round(body, 6) AS body, CASE WHEN rng > 0 AND abs(body) >= 1.2 * normal AND body > 0 AND dn <= 0.4 * rng THEN 'buy'
  WHEN rng > 0 AND abs(body) >= 1.2 * normal AND body < 0 AND up <= 0.4 * rng THEN 'sell' END AS wide_side FROM x""")
def wide_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.wide_candles(h1(spark, sf_dir)), 6, "body")


@query(f"""WITH {H1}, o AS (SELECT symbol, bar_ts, open, high, low, close, (epoch(bar_ts)::BIGINT // 3600) AS slot, tick_count::DOUBLE AS v FROM h1),
x AS (SELECT a.symbol, a.slot, avg(b.v) AS m, count(*) AS n FROM o a, (SELECT -24 * d + k AS s FROM range(1, 6) t(d), range(-2, 3) u(k)) st
  JOIN o b ON b.symbol = a.symbol AND b.slot = a.slot + st.s GROUP BY ALL)
SELECT o.symbol, o.bar_ts, coalesce(n >= 5 AND v / m >= 1.5, false) AND high > low AND abs(close - open) <= 0.35 * (high - low) AS absorbed FROM o LEFT JOIN x USING (symbol, slot)""")
def absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = h1(spark, sf_dir)
    return market.absorbing(b, market.relative_volume(b, 3600))


@query(f"""WITH {H1}, x AS (SELECT *, abs(close - open) AS body FROM h1),
y AS (SELECT symbol, bar_ts, count(*) OVER w AS k, coalesce(avg(CASE WHEN close > open THEN body END) OVER w, 0.0) AS u, coalesce(avg(CASE WHEN close < open THEN body END) OVER w, 0.0) AS d,
  count(CASE WHEN close > open AND high - close > body THEN 1 END) OVER w AS a, count(CASE WHEN close < open AND close - low > body THEN 1 END) OVER w AS b
  FROM x WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT symbol, bar_ts, k AS candles, round(u, 6) AS up_body, round(d, 6) AS down_body, a AS up_rejections, b AS down_rejections,
  CASE WHEN u < 0.5 * d AND a >= 3 THEN 'sellers stronger' WHEN d < 0.5 * u AND b >= 3 THEN 'buyers stronger' ELSE 'no clear side' END AS reading FROM y""")
def candle_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.candle_read(h1(spark, sf_dir)), 6, "up_body", "down_body")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events").where("event_type = 'purchase'")
    side = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    kind = F.when(F.col("event_id") % 5 == 1, "stop").when(F.col("event_id") % 5 == 2, "limit").otherwise("market")
    price = F.lit(100.0) + F.col("value") + (F.col("event_id") % 7 - 3) * F.lit(10.0)
    return e.select(
        F.col("event_id").alias("order_id"), F.col("event_type").alias("symbol"), side.alias("side"), F.col("ts").alias("placed_ts"),
        F.lit(20.0).alias("stop"), F.lit(30.0).alias("target"), kind.alias("kind"), price.alias("price"),
    )


_OUTCOMES = f"""WITH {TICKS}, o AS (SELECT event_id AS order_id, event_type AS symbol, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side, ts AS placed_ts,
  CASE WHEN event_id % 5 = 1 THEN 'stop' WHEN event_id % 5 = 2 THEN 'limit' ELSE 'market' END AS kind, 100.0::DOUBLE + value + (event_id % 7 - 3) * 10.0::DOUBLE AS price
  FROM events WHERE event_type = 'purchase'),
c AS (SELECT o.*, t.ts, t.id, CASE WHEN side > 0 THEN ask ELSE bid END AS px FROM o JOIN ticks t ON t.symbol = o.symbol AND t.ts > o.placed_ts),
e AS (SELECT order_id, first(ts ORDER BY ts, id) AS entry_ts, first(px ORDER BY ts, id) AS entry_price FROM c
  WHERE kind = 'market' OR CASE WHEN (side > 0) = (kind = 'stop') THEN px >= price ELSE px <= price END GROUP BY 1),
m AS (SELECT o.order_id, t.ts, t.id, CASE WHEN side > 0 THEN bid ELSE ask END AS px, CASE WHEN side > 0 THEN bid <= entry_price - 20 ELSE ask >= entry_price + 20 END AS sl,
  CASE WHEN side > 0 THEN bid >= entry_price + 30 ELSE ask <= entry_price - 30 END AS tp FROM o JOIN e USING (order_id) JOIN ticks t ON t.symbol = o.symbol AND t.ts >= entry_ts),
x AS (SELECT order_id, first(ts ORDER BY ts, id) AS exit_ts, first(px ORDER BY ts, id) AS exit_price, first(CASE WHEN sl THEN 'stop' ELSE 'target' END ORDER BY ts, id) AS reason
  FROM m WHERE sl OR tp GROUP BY 1),
r AS (SELECT o.order_id, symbol, side, entry_ts, entry_price, exit_ts, exit_price, CASE WHEN entry_ts IS NULL THEN 'pending' ELSE coalesce(reason, 'open') END AS exit_reason,
  (exit_price - entry_price) * side AS gain FROM o LEFT JOIN e USING (order_id) LEFT JOIN x USING (order_id))"""


@query(_OUTCOMES + """ SELECT order_id, symbol, side, entry_ts, round(entry_price, 6) AS entry_price, exit_ts, round(exit_price, 6) AS exit_price, exit_reason,
  round(gain, 6) AS gain, round(gain / 20, 6) AS r_multiple FROM r""")
def bracket_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = execution.bracket_outcomes(_orders(spark, sf_dir), tables.ticks(spark, sf_dir))
    return rounded(out, 6, "entry_price", "exit_price", "gain", "r_multiple")


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = execution.bracket_outcomes(_orders(spark, sf_dir), tables.ticks(spark, sf_dir)).where("exit_reason not in ('open', 'pending')")
    return done.select("order_id", "exit_ts", "exit_reason", F.weekday("entry_ts").alias("weekday"), F.col("gain").alias("net"), F.col("r_multiple").alias("r"))


@query(_OUTCOMES + """, t AS (SELECT isodow(entry_ts) - 1 AS weekday, gain AS net, gain / 20 AS r FROM r WHERE exit_reason NOT IN ('open', 'pending')),
s AS (SELECT weekday, count(*) AS n, count_if(net > 0)::BIGINT AS wins, sum(net) AS net, avg(r) AS mean_r, median(r) AS median_r,
  coalesce(sum(net) FILTER (net > 0), 0) / nullif(sum(-net) FILTER (net < 0), 0) AS pf FROM t GROUP BY 1), z AS (SELECT *, wins / n AS p, 1.959964::DOUBLE AS z FROM s)
SELECT weekday::INT AS weekday, n, wins, round(net, 4) AS net, round(mean_r, 6) AS mean_r, round(median_r, 6) AS median_r, round(pf, 6) AS profit_factor, round(p, 6) AS win_rate,
  round((p + z*z/(2*n)) / (1 + z*z/n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 6) AS win_low,
  round((p + z*z/(2*n)) / (1 + z*z/n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 6) AS win_high FROM z""")
def journal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = execution.journal_summary(_trades(spark, sf_dir), ["weekday"])
    return rounded(rounded(out, 6, "mean_r", "median_r", "profit_factor", "win_rate", "win_low", "win_high"), 4, "net")


@query(_OUTCOMES + """, t AS (SELECT exit_reason, exit_ts, order_id, gain AS net FROM r WHERE exit_reason NOT IN ('open', 'pending')),
run AS (SELECT *, sum(net) OVER w AS eq FROM t WINDOW w AS (PARTITION BY exit_reason ORDER BY exit_ts, order_id)),
d AS (SELECT *, greatest(0, max(eq) OVER (PARTITION BY exit_reason ORDER BY exit_ts, order_id)) AS pk FROM run)
SELECT exit_reason, round(last(eq ORDER BY exit_ts, order_id), 4) AS equity, round(max(pk), 4) AS peak, round(max(pk - eq), 4) AS max_drawdown,
  first(exit_ts ORDER BY round(pk - eq, 6) DESC, exit_ts, order_id) AS max_drawdown_at FROM d GROUP BY 1""")
def equity_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = execution.drawdown(_trades(spark, sf_dir), ["exit_reason"], ["exit_ts", "order_id"])
    return rounded(out, 4, "equity", "peak", "max_drawdown")




_GAPS = f"WITH {H1}{_TR}" + _RECURSE.format(v="tr", src="t", n=14, w="(1.0::DOUBLE / 14)") + """,
g AS (SELECT h.symbol, h.bar_ts, h.high, h.low, x AS atr, lag(h.high, 2) OVER o AS h2, lag(h.low, 2) OVER o AS l2
  FROM h1 h JOIN e ON e.symbol = h.symbol AND e.bar_ts = h.bar_ts WINDOW o AS (PARTITION BY h.symbol ORDER BY h.bar_ts)),
ar AS (SELECT symbol || '@' || epoch(bar_ts)::BIGINT AS area_id, symbol, CASE WHEN low > h2 AND low - h2 >= 0.3 * atr THEN 'buy' ELSE 'sell' END AS side,
  CASE WHEN low > h2 AND low - h2 >= 0.3 * atr THEN h2 ELSE high END AS bottom, CASE WHEN low > h2 AND low - h2 >= 0.3 * atr THEN low ELSE l2 END AS top, bar_ts + INTERVAL 1 HOUR AS known_ts
  FROM g WHERE (low > h2 AND low - h2 >= 0.3 * atr) OR (l2 > high AND l2 - high >= 0.3 * atr)),
st AS (SELECT area_id, h.bar_ts, CASE side WHEN 'sell' THEN h.high >= bottom ELSE h.low <= top END AS ins, CASE side WHEN 'sell' THEN h.high >= top ELSE h.low <= bottom END AS ends
  FROM ar JOIN h1 h ON h.symbol = ar.symbol AND h.bar_ts >= known_ts AND h.bar_ts < known_ts + INTERVAL 5 DAY),
en AS (SELECT *, ins AND NOT coalesce(lag(ins) OVER (PARTITION BY area_id ORDER BY bar_ts), false) AS entered FROM st),
ed AS (SELECT area_id, min(bar_ts) FILTER (ends) AS end_bar FROM st GROUP BY 1),
vs AS (SELECT area_id, count(*) AS visits FROM en JOIN ed USING (area_id) WHERE entered AND (end_bar IS NULL OR en.bar_ts < end_bar) GROUP BY 1)
SELECT area_id, side, coalesce(visits, 0) AS visits, CASE WHEN end_bar IS NULL THEN known_ts + INTERVAL 5 DAY ELSE end_bar + INTERVAL 1 HOUR END AS until,
  CASE WHEN end_bar IS NULL THEN 'expired' ELSE 'filled' END AS "end" FROM ar LEFT JOIN ed USING (area_id) LEFT JOIN vs USING (area_id)"""


@query(_GAPS)
def gap_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fair value gaps with their visits and their end."""
    b = h1(spark, sf_dir)
    gaps = market.fair_value_gaps(b, market.atr(b))
    areas = gaps.select(
        F.concat_ws("@", "symbol", clock.epoch(F.col("bar_ts")).cast("string")).alias("area_id"), "symbol",
        F.when(F.col("side") == "up", "buy").otherwise("sell").alias("side"), "bottom", "top",
        (F.col("bar_ts") + F.expr("INTERVAL 1 HOUR")).alias("known_ts"), F.lit(True).alias("fills"),
    )
    return market.track_areas(areas, b, 3600).select("area_id", "side", "visits", "until", "end")


@query(f"""WITH {H1}, n AS (SELECT symbol, bar_ts, high, low, close, max(high) OVER b AS hb, max(high) OVER a AS ha, min(low) OVER b AS lb, min(low) OVER a AS la, count(*) OVER b AS nb, count(*) OVER a AS na FROM h1
  WINDOW b AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
k AS (SELECT symbol, bar_ts, close, lag(CASE WHEN nb = 2 AND na = 2 AND high > hb AND high >= ha THEN high END, 3) OVER w AS nh, lag(CASE WHEN nb = 2 AND na = 2 AND low < lb AND low <= la THEN low END, 3) OVER w AS nl
  FROM n WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)),
g AS (SELECT symbol, bar_ts, close, last_value(nh IGNORE NULLS) OVER w AS hi, count(nh) OVER w AS hn, last_value(nl IGNORE NULLS) OVER w AS lo, count(nl) OVER w AS ln FROM k WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)),
f AS (SELECT symbol, min(bar_ts) AS bar_ts, 0 AS turn, 'buy' AS side, any_value(hi) AS level FROM g WHERE close > hi GROUP BY symbol, hn UNION ALL SELECT symbol, min(bar_ts), 1, 'sell', any_value(lo) FROM g WHERE close < lo GROUP BY symbol, ln)
SELECT symbol, bar_ts, CASE WHEN lag(side) OVER (PARTITION BY symbol ORDER BY bar_ts, turn) <> side THEN 'CHoCH' ELSE 'BOS' END AS kind, side, round(level, 6) AS level FROM f""")
def structure_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks of structure on hourly bars."""
    return rounded(market.structure(h1(spark, sf_dir)), 6, "level")


def _strength_of(spark: SparkSession, hourly: DataFrame) -> DataFrame:
    pairs = literal_table(spark, CURRENCIES, ["symbol", "base", "quote"], ["string"] * 3)
    found = market.strength(market.period_moves(hourly, clock.fx_day_start(F.col("bar_ts"))), pairs)
    return found.withColumn("month", _fx_month())


def _fx_month() -> Column:
    """The month of the market day's start: a day and its strength lie in one month."""
    return F.date_format(clock.fx_day_start(F.col("bar_ts")), "yyyy-MM")


@query(ORACLES["strength_day"])
def strength_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength over the market day, from a store that is filled up to the middle of the ticks and then brought up to date."""
    store = MonthStore(spark, new_folder(spark, "strength"))
    hourly = settled(h1(spark, sf_dir))
    middle = hourly.agg(F.min("bar_ts").alias("a"), F.max("bar_ts").alias("z")).select(F.timestamp_seconds((clock.epoch(F.col("a")) + clock.epoch(F.col("z"))) / 2).cast("timestamp_ntz").alias("m")).first()["m"]
    for rows in (hourly.where(F.col("bar_ts") < F.lit(middle)), hourly):
        store.refresh(rows, _fx_month(), lambda own: _strength_of(spark, own))
    return rounded(store.read("bar_ts timestamp_ntz, currency string, won long, played long, strength double").drop("month"), 6, "strength")
