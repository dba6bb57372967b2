"""Price areas on hourly bars: zones, equal highs and lows, order blocks, and what is alive at a clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import clock
from tidemill.operators import bars, market, setups
from tidemill.operators import zones as areas
from tidemill.operators.shared import settled
from tidemill.plans.markets import _FX_DAY, _RECURSE, _TR, h1
from tidemill.plans.registry import H1, ORACLES, query, rounded
from tidemill.sources import tables

HOUR = 3600

_B = f"WITH RECURSIVE {H1}{_TR}" + _RECURSE.format(v="tr", src="t", n=14, w="(1.0::DOUBLE / 14)") + """,
b AS (SELECT h.symbol, h.bar_ts, open, high, low, close, round(x, 9) AS atr, k - 1 AS pos FROM h1 h JOIN e ON e.symbol = h.symbol AND e.bar_ts = h.bar_ts)"""  # fmt: skip
_ZONES = _B + """,
m AS (SELECT a.symbol, a.pos, sign(a.close - a.open) AS d, p1.atr AS rg,
  (a.close - a.open) * sign(a.close - a.open) >= 0.5 * (a.high - a.low) AND a.high > a.low AND a.close <> a.open AS s0,
  (n1.close - n1.open) * sign(a.close - a.open) >= 0.5 * (n1.high - n1.low) AND n1.high > n1.low AND (n1.close - n1.open) * sign(a.close - a.open) > 0 AS s1,
  (n2.close - n2.open) * sign(a.close - a.open) >= 0.5 * (n2.high - n2.low) AND n2.high > n2.low AND (n2.close - n2.open) * sign(a.close - a.open) > 0 AS s2,
  (a.close - a.open) * sign(a.close - a.open) >= 1.5 * p1.atr AS f0, (n1.close - a.open) * sign(a.close - a.open) >= 1.5 * p1.atr AS f1,
  (n2.close - a.open) * sign(a.close - a.open) >= 1.5 * p1.atr AS f2, a.bar_ts AS t0, n1.bar_ts AS t1, n2.bar_ts AS t2,
  CASE WHEN abs(p2.close - p2.open) > 0.5 * p1.atr THEN 1 WHEN abs(p3.close - p3.open) > 0.5 * p1.atr THEN 2 ELSE 3 END AS nb,
  [p1.low, p2.low, p3.low] AS lows, [p1.high, p2.high, p3.high] AS highs, [p1.bar_ts, p2.bar_ts, p3.bar_ts] AS stamps,
  least(p1.open, p1.close) AS body_low, greatest(p1.open, p1.close) AS body_high
  FROM b a JOIN b p1 ON p1.symbol = a.symbol AND p1.pos = a.pos - 1 JOIN b p2 ON p2.symbol = a.symbol AND p2.pos = a.pos - 2
  JOIN b p3 ON p3.symbol = a.symbol AND p3.pos = a.pos - 3 LEFT JOIN b n1 ON n1.symbol = a.symbol AND n1.pos = a.pos + 1
  LEFT JOIN b n2 ON n2.symbol = a.symbol AND n2.pos = a.pos + 2),
c0 AS (SELECT symbol, pos, CASE WHEN d > 0 THEN 'demand' ELSE 'supply' END AS kind, CASE WHEN d > 0 THEN 'buy' ELSE 'sell' END AS side, rg,
  CASE WHEN d > 0 THEN list_min(lows[1:nb]) ELSE body_low END AS bottom, CASE WHEN d > 0 THEN body_high ELSE list_max(highs[1:nb]) END AS top,
  CASE WHEN s0 AND f0 THEN t0 WHEN s0 AND s1 AND f1 THEN t1 WHEN s0 AND s1 AND s2 AND f2 THEN t2 END + INTERVAL 1 HOUR AS known_ts, list_min(stamps[1:nb]) AS origin_ts
  FROM m WHERE d <> 0),
c1 AS (SELECT * FROM c0 WHERE known_ts IS NOT NULL AND top - bottom <= rg AND top > bottom),
c2 AS (SELECT c1.*, (SELECT min(b.bar_ts) + INTERVAL 1 HOUR FROM b WHERE b.symbol = c1.symbol AND b.bar_ts >= known_ts
  AND CASE side WHEN 'sell' THEN b.close > top ELSE b.close < bottom END) AS until_ts FROM c1),
c3 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY pos) AS n FROM c2),
wk(symbol, kind, n, took, acc) AS (
  SELECT symbol, kind, n, true, [{'a': bottom, 'z': top, 'k': known_ts, 'u': until_ts}] FROM c3 WHERE n = 1 UNION ALL
  SELECT symbol, kind, n, took, CASE WHEN took THEN list_append(acc, {'a': bottom, 'z': top, 'k': known_ts, 'u': until_ts}) ELSE acc END FROM (
    SELECT c.*, acc, len(list_filter(acc, lambda x: x.k <= c.known_ts AND (x.u IS NULL OR c.known_ts < x.u)
      AND least(x.z, c.top) - greatest(x.a, c.bottom) > 0.5 * (c.top - c.bottom))) = 0 AS took
    FROM wk JOIN c3 c ON c.symbol = wk.symbol AND c.kind = wk.kind AND c.n = wk.n + 1)),
zn AS (SELECT c3.* FROM c3 JOIN wk ON wk.symbol = c3.symbol AND wk.kind = c3.kind AND wk.n = c3.n WHERE took)"""  # fmt: skip


def _ranged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hourly = settled(h1(spark, sf_dir))
    return hourly, settled(market.atr(hourly).withColumn("atr", F.round("atr", 9)))


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas.zones(*_ranged(spark, sf_dir), HOUR)


@query(_ZONES + " SELECT symbol, kind, side, round(bottom, 6) AS bottom, round(top, 6) AS top, known_ts, origin_ts, until_ts FROM zn")
def supply_demand_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply and demand zones with their ends; those that a living zone of their kind covers are none."""
    return rounded(_zones(spark, sf_dir).drop("area_id"), 6, "bottom", "top")


@query(_ZONES + """,
v AS (SELECT zn.symbol, zn.kind, zn.pos, zn.known_ts, b.bar_ts, CASE side WHEN 'sell' THEN b.high >= bottom ELSE b.low <= top END AS ins FROM zn JOIN b ON b.symbol = zn.symbol AND b.bar_ts >= zn.known_ts
  AND (until_ts IS NULL OR b.bar_ts + INTERVAL 1 HOUR < until_ts)),
w AS (SELECT *, ins AND NOT coalesce(lag(ins) OVER o, false) AS came FROM v WINDOW o AS (PARTITION BY symbol, kind, pos ORDER BY bar_ts)),
x AS (SELECT symbol, kind, pos, list(bar_ts ORDER BY bar_ts) AS l FROM w WHERE came GROUP BY ALL)
SELECT zn.symbol, zn.kind, zn.known_ts, zn.until_ts, l[1] AS first_return, l[2] AS second_return FROM zn LEFT JOIN x ON x.symbol = zn.symbol AND x.kind = zn.kind AND x.pos = zn.pos""")  # fmt: skip
def zone_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two returns of price into each zone; later ones do not count for touches."""
    hourly, ranges = _ranged(spark, sf_dir)
    found = areas.returns(areas.zones(hourly, ranges, HOUR), hourly, HOUR)
    return found.select("symbol", "kind", "known_ts", "until_ts", "first_return", "second_return")


_EQUAL = _B + """,
n AS (SELECT *, max(high) OVER p AS hb, max(high) OVER f AS ha, min(low) OVER p AS lb, min(low) OVER f AS la, count(*) OVER p AS np, count(*) OVER f AS nf, lead(bar_ts, 2) OVER (PARTITION BY symbol ORDER BY pos) AS kt
  FROM b WINDOW p AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
s AS (SELECT symbol, 'high' AS kind, pos, bar_ts, kt + INTERVAL 1 HOUR AS known_ts, high AS price, greatest(0.02::DOUBLE, 0.25 * atr) AS tol FROM n WHERE np = 2 AND nf = 2 AND high > hb AND high >= ha
  UNION ALL SELECT symbol, 'low', pos, bar_ts, kt + INTERVAL 1 HOUR, low, greatest(0.02::DOUBLE, 0.25 * atr) FROM n WHERE np = 2 AND nf = 2 AND low < lb AND low <= la),
q AS (SELECT y.symbol, y.kind, y.pos, y.known_ts, y.tol, a.pos AS ap, a.bar_ts AS origin_ts, CASE y.kind WHEN 'high' THEN greatest(a.price, y.price) ELSE least(a.price, y.price) END AS price
  FROM s y JOIN s a ON a.symbol = y.symbol AND a.kind = y.kind AND a.pos < y.pos AND y.bar_ts - a.bar_ts <= INTERVAL 2 DAY AND abs(a.price - y.price) <= y.tol),
g AS (SELECT q.* FROM q WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = q.symbol AND b.pos > q.ap AND b.pos < q.pos AND CASE q.kind WHEN 'high' THEN b.high > q.price ELSE b.low < q.price END)
  QUALIFY row_number() OVER (PARTITION BY symbol, kind, pos ORDER BY ap DESC) = 1),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY pos) AS n FROM g),
wk(symbol, kind, n, took, acc) AS (
  SELECT symbol, kind, n, true, [{'p': price, 'k': known_ts}] FROM o WHERE n = 1 UNION ALL
  SELECT symbol, kind, n, took, CASE WHEN took THEN list_append(acc, {'p': price, 'k': known_ts}) ELSE acc END FROM (
    SELECT o.*, acc, len(list_filter(acc, lambda x: abs(x.p - o.price) <= o.tol AND x.k >= o.known_ts - INTERVAL 1 DAY)) = 0 AS took
    FROM wk JOIN o ON o.symbol = wk.symbol AND o.kind = wk.kind AND o.n = wk.n + 1)),
el AS (SELECT o.* FROM o JOIN wk ON wk.symbol = o.symbol AND wk.kind = o.kind AND wk.n = o.n WHERE took)"""  # fmt: skip


def _equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly, ranges = _ranged(spark, sf_dir)
    # a swing's price is compared in quarters of the average range at its bar, or two hundredths if that is less
    tolerance = ranges.select("symbol", "bar_ts", F.greatest(F.lit(0.02), 0.25 * F.col("atr")).alias("tolerance"))
    swings = market.swings(hourly).withColumn("known_ts", areas.after("known_ts", HOUR))
    return areas.equal_levels(hourly, swings, tolerance, HOUR)


@query(_EQUAL + " SELECT symbol, CASE kind WHEN 'high' THEN 'eqh' ELSE 'eql' END AS kind, CASE kind WHEN 'high' THEN 'sell' ELSE 'buy' END AS side, round(price, 6) AS price, known_ts, origin_ts, known_ts + INTERVAL 2 DAY AS expires_ts FROM el")
def equal_highs_lows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two swings at one price with nothing beyond them in between: levels for two days."""
    return rounded(_equal(spark, sf_dir).drop("area_id"), 6, "price")


@query(_EQUAL + """,
lv AS (SELECT symbol, CASE kind WHEN 'high' THEN 'sell' ELSE 'buy' END AS side, price, known_ts AS known, known_ts + INTERVAL 2 DAY AS gone FROM el),
mt AS (SELECT lv.*, bar_ts, CASE side WHEN 'sell' THEN high ELSE low END AS extreme, CASE side WHEN 'sell' THEN high > price ELSE low < price END AS through,
  CASE side WHEN 'sell' THEN close > price ELSE close < price END AS beyond FROM lv JOIN b ON b.symbol = lv.symbol AND bar_ts >= known AND bar_ts < gone),
br AS (SELECT symbol, side, price, known, min(bar_ts) FILTER (beyond) AS x FROM mt GROUP BY ALL)
SELECT symbol, side, known AS known_ts, round(price, 6) AS price, bar_ts, round(extreme, 6) AS extreme, beyond AS broke FROM mt JOIN br USING (symbol, side, price, known)
WHERE (beyond OR through) AND (x IS NULL OR bar_ts <= x)""")  # fmt: skip
def equal_level_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeps of equal highs and lows, and the close that breaks each."""
    tracked = market.track_levels(_equal(spark, sf_dir), h1(spark, sf_dir))
    return rounded(tracked.drop("expires_ts"), 6, "price", "extreme")


_BLOCKS = f"WITH br AS (SELECT * FROM ({ORACLES['structure_breaks']})), {H1}, " + """b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS pos FROM h1),
ob AS (SELECT br.symbol, br.side, j.bar_ts + INTERVAL 1 HOUR AS known_ts, o.bar_ts AS origin_ts, o.low AS bottom, o.high AS top
  FROM br JOIN b j ON j.symbol = br.symbol AND j.bar_ts = br.bar_ts JOIN b o ON o.symbol = j.symbol AND o.pos BETWEEN j.pos - 29 AND j.pos - 1
   AND CASE br.side WHEN 'buy' THEN o.close < o.open ELSE o.close > o.open END
  QUALIFY row_number() OVER (PARTITION BY br.symbol, br.side, j.pos ORDER BY o.pos DESC) = 1)"""  # fmt: skip


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks_of(h1(spark, sf_dir))


def _blocks_of(hourly: DataFrame) -> DataFrame:
    return areas.order_blocks(hourly, market.structure(hourly), HOUR)


@query(_BLOCKS + " SELECT symbol, side, round(bottom, 6) AS bottom, round(top, 6) AS top, known_ts, origin_ts, known_ts + INTERVAL 5 DAY AS expires_ts FROM ob")
def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bar the other way before each break of structure."""
    return rounded(_blocks(spark, sf_dir).drop("area_id", "kind"), 6, "bottom", "top")


@query(_ZONES + f""", ob AS (SELECT * FROM ({_BLOCKS} SELECT * FROM ob)),
x AS (SELECT ob.*, (SELECT min(bar_ts) + INTERVAL 1 HOUR FROM b WHERE b.symbol = ob.symbol AND b.bar_ts >= ob.known_ts AND b.bar_ts < ob.known_ts + INTERVAL 5 DAY
  AND CASE side WHEN 'sell' THEN b.close > top ELSE b.close < bottom END) AS ends FROM ob),
ar AS (SELECT symbol, kind, side, bottom, top, known_ts, until_ts FROM zn UNION ALL SELECT symbol, 'ob', side, bottom, top, known_ts, coalesce(ends, known_ts + INTERVAL 5 DAY) FROM x),
ck AS (SELECT DISTINCT symbol, date_trunc('day', bar_ts)::TIMESTAMP + INTERVAL 12 HOUR AS clock_ts FROM b)
SELECT ck.symbol, clock_ts, kind, side, round(bottom, 6) AS bottom, round(top, 6) AS top, known_ts FROM ck JOIN ar ON ar.symbol = ck.symbol AND known_ts <= clock_ts AND (until_ts IS NULL OR clock_ts < until_ts)""")  # fmt: skip
def areas_at_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones and order blocks that are alive at noon of each day with bars."""
    hourly, ranges = _ranged(spark, sf_dir)
    blocks = market.track_areas(_blocks_of(hourly).withColumn("fills", F.lit(False)), hourly, HOUR).withColumnRenamed("until", "until_ts")
    both = areas.zones(hourly, ranges, HOUR).unionByName(blocks.select("area_id", "symbol", "kind", "side", "bottom", "top", "known_ts", "origin_ts", "until_ts"))
    noon = F.timestamp_add("HOUR", F.lit(12), F.date_trunc("day", "bar_ts").cast("timestamp_ntz"))
    clocks = hourly.select("symbol", noon.alias("clock_ts")).distinct()
    clocks = clocks.withColumn("clock_id", F.concat_ws("@", "symbol", clock.epoch(F.col("clock_ts")).cast("string")))
    return rounded(areas.alive_at(clocks, both).drop("clock_id", "area_id"), 6, "bottom", "top")


#: Pips of the events' prices are whole units here.
_RULE = setups.Routine(pip=1.0, ema_days=10, range_days=10)


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars.resample(h1(spark, sf_dir), clock.fx_day_start(F.col("bar_ts")))
    return days.select("symbol", F.col("bucket_ts").alias("bar_ts"), "open", "high", "low", "close")


_DAYS = f"""WITH RECURSIVE {H1}, d AS (SELECT symbol, {_FX_DAY}::TIMESTAMP AS bar_ts, first(open ORDER BY bar_ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY bar_ts) AS close FROM h1 GROUP BY 1, 2),
t AS (SELECT *, coalesce(greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)), high - low) AS tr, row_number() OVER o AS k FROM d WINDOW o AS (PARTITION BY symbol ORDER BY bar_ts)),
x(symbol, k, m, a) AS (SELECT symbol, k, close, tr FROM t WHERE k = 1 UNION ALL
  SELECT t.symbol, t.k, CASE WHEN t.k <= 10 THEN m + (close - m) / t.k ELSE m + (2.0::DOUBLE / 11) * (close - m) END, a + (tr - a) / least(t.k, 14) FROM x JOIN t ON t.symbol = x.symbol AND t.k = x.k + 1),
y AS (SELECT t.symbol, t.bar_ts, t.k, t.open, p.m AS m1, q.m AS m6, p.a AS a1, r.top, r.bottom, r.n FROM t LEFT JOIN x p ON p.symbol = t.symbol AND p.k = t.k - 1 LEFT JOIN x q ON q.symbol = t.symbol AND q.k = t.k - 6
  LEFT JOIN (SELECT a.symbol, a.k, max(b.high) AS top, min(b.low) AS bottom, count(*) AS n FROM t a JOIN t b ON b.symbol = a.symbol AND b.k BETWEEN a.k - 10 AND a.k - 1 GROUP BY ALL) r ON r.symbol = t.symbol AND r.k = t.k),
z AS (SELECT *, coalesce(k > 15 AND abs(m1 - m6) >= 0.2 * a1, false) AS trend FROM y)"""  # fmt: skip


@query(_DAYS + """, s AS (SELECT *, CASE WHEN trend AND m1 < m6 AND open < m1 THEN 'sell' WHEN trend AND m1 > m6 AND open > m1 THEN 'buy' END AS e FROM z)
SELECT symbol, bar_ts AS day, coalesce(e, CASE WHEN coalesce(n, 0) < 5 OR open > (top + bottom) / 2 THEN 'sell' ELSE 'buy' END) = 'sell' AS sells,
  coalesce(e, CASE WHEN coalesce(n, 0) < 5 OR open <= (top + bottom) / 2 THEN 'buy' ELSE 'sell' END) = 'buy' AS buys, CASE WHEN e IS NOT NULL THEN 'ema' WHEN coalesce(n, 0) < 5 THEN 'none' ELSE 'range' END AS rule FROM s""")  # fmt: skip
def side_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side each market day allows, by the mean of closes or the half of the range."""
    return setups.side_decisions(_days(spark, sf_dir), _RULE)


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m1 = settled(bars.ticks_to_bars(tables.ticks(spark, sf_dir), 60))
    busy = market.absorbing(m1, market.relative_volume(m1, 60))
    return settled(setups.minute_table(m1.join(busy, ["symbol", "bar_ts"], "left")))


def _touchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones until their second return is over, and order blocks and gaps until they expire."""
    hourly, ranges = _ranged(spark, sf_dir)
    zones = areas.returns(areas.zones(hourly, ranges, HOUR), hourly, HOUR).withColumn("last_ts", areas.after("second_return", HOUR))
    gaps = market.fair_value_gaps(hourly, ranges).select(
        F.concat_ws("@", "symbol", F.lit("fvg"), clock.epoch(F.col("bar_ts")).cast("string")).alias("area_id"), "symbol", F.lit("fvg").alias("kind"),
        F.when(F.col("side") == "up", "buy").otherwise("sell").alias("side"), "bottom", "top", areas.after("bar_ts", HOUR).alias("known_ts"), F.lit(True).alias("fills"),
    )
    blocks = _blocks_of(hourly).withColumn("fills", F.lit(False)).select(*gaps.columns)
    ended = market.track_areas(gaps.union(blocks), hourly, HOUR).withColumnRenamed("until", "until_ts").withColumn("last_ts", F.lit(None).cast("timestamp_ntz"))
    columns = ["area_id", "symbol", "kind", "side", "bottom", "top", "known_ts", "until_ts", "last_ts"]
    return zones.select(*columns).unionByName(ended.select(*columns))


def _touches(spark: SparkSession, sf_dir: str, minutes: DataFrame) -> DataFrame:
    """Entries into areas, and the sweeps of the day's edges and of equal highs and lows on 15-minute bars."""
    quarter = bars.ticks_to_bars(tables.ticks(spark, sf_dir), 900)
    edges = market.day_edges(market.previous_day_levels(h1(spark, sf_dir)), days=1)
    equal = _equal(spark, sf_dir).select(*edges.columns)
    swept = market.track_levels(edges.union(equal), quarter).where("not broke").select(
        "symbol", "side", F.concat_ws("@", "symbol", F.lit("level"), "side", F.col("price").cast("string"), clock.epoch(F.col("known_ts")).cast("string")).alias("area_id"), F.lit("level").alias("kind"),
        F.col("price").alias("bottom"), F.col("price").alias("top"), F.col("bar_ts").alias("start_ts"), areas.after("bar_ts", 900).alias("touch_ts"),
    )
    return settled(setups.entries(_touchable(spark, sf_dir), minutes).unionByName(swept))


@query(_ZONES + """,
v AS (SELECT zn.symbol, zn.kind, zn.pos, b.bar_ts, CASE side WHEN 'sell' THEN b.high >= bottom ELSE b.low <= top END AS ins FROM zn JOIN b ON b.symbol = zn.symbol AND b.bar_ts >= zn.known_ts
  AND (until_ts IS NULL OR b.bar_ts + INTERVAL 1 HOUR < until_ts)),
w AS (SELECT *, ins AND NOT coalesce(lag(ins) OVER o, false) AS came FROM v WINDOW o AS (PARTITION BY symbol, kind, pos ORDER BY bar_ts)),
x AS (SELECT symbol, kind, pos, list(bar_ts ORDER BY bar_ts) AS l FROM w WHERE came GROUP BY ALL),
m1 AS (SELECT symbol, date_trunc('minute', ts)::TIMESTAMP AS bar_ts, max(bid) AS high, min(bid) AS low FROM ticks GROUP BY ALL),
mp AS (SELECT *, coalesce(lag(high) OVER o, '-inf'::DOUBLE) AS ph, coalesce(lag(low) OVER o, 'inf'::DOUBLE) AS pl FROM m1 WINDOW o AS (PARTITION BY symbol ORDER BY bar_ts))
SELECT zn.symbol, zn.kind, zn.known_ts, mp.bar_ts AS start_ts FROM zn LEFT JOIN x ON x.symbol = zn.symbol AND x.kind = zn.kind AND x.pos = zn.pos
JOIN mp ON mp.symbol = zn.symbol AND mp.bar_ts >= zn.known_ts AND (until_ts IS NULL OR mp.bar_ts < until_ts) AND (l[2] IS NULL OR mp.bar_ts < l[2] + INTERVAL 1 HOUR)
 AND CASE side WHEN 'sell' THEN high >= bottom AND ph < bottom ELSE low <= top AND pl > top END""")  # fmt: skip
def zone_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minutes in which price comes into a zone, on its first two returns."""
    found = _touchable(spark, sf_dir).where("kind in ('supply', 'demand')")
    known = found.select("area_id", "known_ts")
    return setups.entries(found, _minutes(spark, sf_dir)).join(known, "area_id").select("symbol", "kind", "known_ts", "start_ts")


@query()
def trade_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setups from touches of all areas and levels, with their checks; held against a plain walk in the tests."""
    minutes = _minutes(spark, sf_dir)
    out = setups.setups(_touches(spark, sf_dir, minutes), minutes, setups.side_decisions(_days(spark, sf_dir), _RULE), _RULE)
    return rounded(out.withColumn("areas", F.concat_ws(",", "areas")), 6, "entry", "stop", "target", "small_price", "risk_pips", "room_pips")
