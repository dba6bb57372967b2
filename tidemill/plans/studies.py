"""Event study, direction, timestamp validation and closed-form statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import clock, statistics
from tidemill.functions.literals import literal_table
from tidemill.operators import bars, baseline, study, summaries, validation
from tidemill.operators.shared import settled
from tidemill.plans.markets import d1, h1
from tidemill.plans.registry import D1, H1, PAIRS, RELEASES, TICKS, query, rounded
from tidemill.sources import tables

_P = """CASE WHEN v < 1 OR t IS NULL THEN NULL WHEN v % 2 = 1 THEN 1 - (2 / pi()) * (atan(abs(t) / sqrt(v)) + sin(atan(abs(t) / sqrt(v))) *
  coalesce(list_sum(list_transform(range(1, (v - 1) // 2 + 1), lambda k: cos(atan(abs(t) / sqrt(v))) ** (2 * k - 1) * sqrt(pi()) / 2 * exp(lgamma(k) - lgamma(k + 0.5)))), 0))
  ELSE 1 - sin(atan(abs(t) / sqrt(v))) * coalesce(list_sum(list_transform(range(1, v // 2 + 1), lambda k: cos(atan(abs(t) / sqrt(v))) ** (2 * k - 2) * exp(lgamma(k - 0.5) - lgamma(k)) / sqrt(pi()))), 0) END"""


def _pairs(spark: SparkSession) -> DataFrame:
    return literal_table(spark, tables.PAIRINGS, ["symbol", "indicator"], ["string", "string"])


@query(f"SELECT o_orderkey, round({_P}, 6) AS p FROM (SELECT o_orderkey, (o_orderkey % 60)::INT AS v, o_totalprice / 100000 AS t FROM orders)")
def t_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders")
    p = statistics.t_two_sided_p(F.col("o_totalprice") / 100000, F.col("o_orderkey") % 60)
    return rounded(o.select("o_orderkey", p.alias("p")), 6, "p")


@query("""SELECT n, h, round(least(1, coalesce(list_sum(list_transform(range(h, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(1.0::DOUBLE / 7) + (n - k) * ln(6.0::DOUBLE / 7)))), 0)), 6) AS p
FROM (SELECT DISTINCT o_orderkey % 40 + 1 AS n, o_custkey % (o_orderkey % 40 + 1) AS h FROM orders)""")
def binomial_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 40 + 1).alias("n")
    cases = tables.table(spark, sf_dir, "orders").select(n, (F.col("o_custkey") % (F.col("o_orderkey") % 40 + 1)).alias("h")).distinct()
    return rounded(cases.withColumn("p", statistics.binomial_upper_tail(F.col("h"), F.col("n"), 1 / 7)), 6, "p")


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, avg(o_totalprice) / 600000 AS p FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS m FROM c)
SELECT o_custkey, o_orderpriority, round(least(1, min(p * m / k) OVER (PARTITION BY o_orderpriority ORDER BY k DESC)), 6) AS q FROM r""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg((F.avg("o_totalprice") / 600000).alias("p"))
    return rounded(statistics.bh_adjust(c, "p", "q", ["o_orderpriority"]).select("o_custkey", "o_orderpriority", "q"), 6, "q")


@query("""WITH m AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS md FROM lineitem GROUP BY 1), a AS (SELECT l.l_returnflag, l_extendedprice, abs(l_extendedprice - md) AS d FROM lineitem l JOIN m USING (l_returnflag)),
s AS (SELECT l_returnflag, quantile_cont(d, 0.5) * 1.4826 AS sp FROM a GROUP BY 1) SELECT l_returnflag, count(*) AS n, count_if(d / sp > 1.5)::BIGINT AS far FROM a JOIN s USING (l_returnflag) GROUP BY 1""")
def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = statistics.mad_outliers(tables.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", ["l_returnflag"], z=1.5)
    return flagged.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if("is_outlier").alias("far"))


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, count_if(o_orderstatus = 'F')::BIGINT AS w FROM orders GROUP BY 1), z AS (SELECT *, w / n AS p, 1.959964::DOUBLE AS z FROM g)
SELECT o_custkey, n, w, round((p + z*z/(2*n)) / (1 + z*z/n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 6) + 0.0::DOUBLE AS low,
 round((p + z*z/(2*n)) / (1 + z*z/n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 6) AS high FROM z""")
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("w"))
    low, high = statistics.wilson(F.col("w"), F.col("n"))
    return rounded(g.withColumn("low", low).withColumn("high", high), 6, "low", "high")


@query("""SELECT l_shipmode_like AS g, count(*) AS n, round(regr_slope(y, x), 4) AS slope, round(regr_r2(y, x), 6) AS r2,
 round(sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 4) AS se FROM
 (SELECT l_returnflag || l_linestatus AS l_shipmode_like, l_extendedprice AS y, l_quantity AS x FROM lineitem) GROUP BY 1""")
def ols_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("g"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"))
    fit = statistics.ols("y", "x")
    out = rows.groupBy("g").agg(fit["n"].alias("n"), fit["slope"].alias("slope"), fit["r2"].alias("r2"), fit["se"].alias("se"))
    return rounded(rounded(out, 4, "slope", "se"), 6, "r2")


# The study in SQL: forward-filled day grid, windows of the ladder, and counts of releases within them
_STUDY = f"""WITH {D1}, {RELEASES}, {PAIRS}, lad(horizon, seconds, days) AS (VALUES ('-5d',-432000,-5),('-1d',-86400,-1),('+1d',86400,1),('+3d',259200,3),('+1w',604800,7),('+2w',1209600,14),('+1M',2592000,30)),
b AS (SELECT *, (epoch(bar_ts)::BIGINT // 86400) AS slot FROM d1), sp AS (SELECT symbol, min(slot) AS a, max(slot) + 31 AS z FROM b GROUP BY 1),
g0 AS (SELECT symbol, unnest(generate_series(a, z)) AS slot FROM sp),
g AS (SELECT g0.symbol, g0.slot, last_value(open IGNORE NULLS) OVER w AS o, last_value(close IGNORE NULLS) OVER w AS c, count(close) OVER w AS nb,
  coalesce(sum((ln(close / open) ** 2)::DECIMAL(24,18)) OVER w, 0) AS sq FROM g0 LEFT JOIN b USING (symbol, slot) WINDOW w AS (PARTITION BY g0.symbol ORDER BY g0.slot)),
rt AS (SELECT g.symbol, g.slot, horizon, seconds, days, CASE WHEN days >= 0 THEN ln(f.c / g.o) ELSE ln(g.o / f.o) END AS ret,
  greatest(g.nb, f.nb) - coalesce(p.nb, 0) AS n_bars, sqrt(greatest(0, (greatest(g.sq, f.sq) - coalesce(p.sq, 0))::DOUBLE)) AS rv
  FROM g CROSS JOIN lad LEFT JOIN g f ON f.symbol = g.symbol AND f.slot = g.slot + days LEFT JOIN g p ON p.symbol = g.symbol AND p.slot = least(g.slot, g.slot + days) - 1),
os AS (SELECT DISTINCT ts, horizon, days FROM releases CROSS JOIN lad),
ev0 AS (SELECT r.indicator, pairs.symbol, r.ts, (epoch(r.ts)::BIGINT // 86400) AS slot, lad.horizon, lad.seconds, lad.days FROM releases r JOIN pairs USING (indicator) CROSS JOIN lad),
ev1 AS (SELECT e.*, coalesce(rt.n_bars, 0) AS n_bars, rt.ret AS ret0, rt.rv, least(e.ts, e.ts + e.days * INTERVAL 1 DAY) AS t1, greatest(e.ts, e.ts + e.days * INTERVAL 1 DAY) AS t2
  FROM ev0 e LEFT JOIN rt ON rt.symbol = e.symbol AND rt.slot = e.slot AND rt.horizon = e.horizon),
"""


def _study_sql(select: str) -> str:
    from tidemill.plans.markets import _open_seconds

    return _STUDY + f"""ev AS (SELECT *, greatest(1, ({_open_seconds('t2')} - {_open_seconds('t1')}) // 86400)::BIGINT AS bars_expected FROM ev1),
w AS (SELECT indicator, symbol, ts, slot, horizon, seconds, days, n_bars, bars_expected, coalesce(ret0 IS NOT NULL AND n_bars >= 0.6 * bars_expected, false) AS usable, ret0, rv FROM ev) {select}"""


@query(_study_sql("""SELECT indicator, symbol, ts, horizon, n_bars, bars_expected, CASE WHEN usable THEN round(ret0, 6) END AS ret,
 CASE WHEN usable AND n_bars > 1 THEN round(rv, 6) END AS realized_vol, usable FROM w"""))
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = study.event_windows(d1(spark, sf_dir), tables.releases(spark, sf_dir), _pairs(spark))
    return rounded(out.drop("slot", "seconds", "mfe", "mae"), 6, "ret", "realized_vol")


#: Validation on events: an indicator is an event type, its releases are the user's large events, all thirty days are used.
_GRADE_PAIRS = [("click", "click"), ("view", "view"), ("purchase", "purchase"), ("signup", "signup"), ("error", "error")]


def _alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    mark = F.get_json_object("props", "$.k").cast("int")
    return e.where(mark >= 90).select(F.col("event_type").alias("indicator"), "ts", (F.col("user_id") % 3).cast("int").alias("importance"), "event_id")


def _inner_ctes(step: int, rungs: dict[str, int]) -> str:
    """Windows by their definition: bars of the closed interval, prices as of its ends."""
    from tidemill.plans.markets import _open_seconds

    unit = {3600: "hour", 60: "minute"}[step]
    ladder = ", ".join(f"('{n}', {s})" for n, s in rungs.items())
    return f"""WITH {TICKS}, b AS (SELECT symbol, date_trunc('{unit}', ts)::TIMESTAMP AS bar_ts, first(bid ORDER BY ts, id) AS open, max(bid) AS high, min(bid) AS low, last(bid ORDER BY ts, id) AS close FROM ticks GROUP BY ALL),
lad(horizon, seconds) AS (VALUES {ladder}), ev AS (SELECT DISTINCT event_type AS indicator, event_type AS symbol, ts::TIMESTAMP AS ts FROM events WHERE json_extract_string(props, '$.k')::INT >= 90),
e0 AS (SELECT *, ts + seconds * INTERVAL 1 SECOND AS far, least(ts, far) AS t1, greatest(ts, far) AS t2 FROM ev CROSS JOIN lad),
e1 AS (SELECT e0.*, a.open AS a_open FROM e0 ASOF LEFT JOIN b a ON a.symbol = e0.symbol AND e0.ts >= a.bar_ts),
e2 AS (SELECT e1.*, o.open AS o_open, o.close AS o_close FROM e1 ASOF LEFT JOIN b o ON o.symbol = e1.symbol AND e1.far >= o.bar_ts),
n AS (SELECT e0.symbol, e0.ts, e0.horizon, count(b.symbol) AS n_bars, max(high) AS top, min(low) AS bottom, sqrt(sum(ln(close / open) ** 2)) AS rv FROM e0 LEFT JOIN b ON b.symbol = e0.symbol AND b.bar_ts BETWEEN t1 AND t2 GROUP BY ALL),
w AS (SELECT e2.*, n_bars, top, bottom, rv, greatest(1, ({_open_seconds('t2')} - {_open_seconds('t1')}) // {step})::BIGINT AS bars_expected, CASE WHEN seconds >= 0 THEN ln(o_close / a_open) ELSE ln(a_open / o_open) END AS r FROM e2 JOIN n USING (symbol, ts, horizon)),
u AS (SELECT *, coalesce(r IS NOT NULL AND n_bars >= 0.6 * bars_expected, false) AS usable FROM w)"""


def _inner_sql(step: int, rungs: dict[str, int]) -> str:
    return _inner_ctes(step, rungs) + """ SELECT indicator, symbol, ts, horizon, n_bars, bars_expected, CASE WHEN usable THEN round(r, 6) END AS ret, CASE WHEN usable AND n_bars > 1 THEN round(rv, 6) END AS realized_vol,
CASE WHEN usable AND n_bars > 0 THEN round(ln(top / a_open), 6) END AS mfe, CASE WHEN usable AND n_bars > 0 THEN round(ln(bottom / a_open), 6) END AS mae, usable FROM u"""


def _inner(spark: SparkSession, sf_dir: str, step: int, rungs: dict[str, int]) -> DataFrame:
    b = bars.ticks_to_bars(tables.ticks(spark, sf_dir), step)
    r = _alarms(spark, sf_dir).select("indicator", "ts").distinct()
    pairs = literal_table(spark, _GRADE_PAIRS, ["indicator", "symbol"], ["string", "string"])
    return rounded(study.event_windows(b, r, pairs, rungs, step).drop("slot", "seconds"), 6, "ret", "realized_vol", "mfe", "mae")


_HOUR_RUNGS = study.supported(study.HOUR)
_MINUTE_RUNGS = {n: s for n, s in study.LADDER.items() if abs(s) < study.HOUR}


@query(_inner_sql(study.HOUR, _HOUR_RUNGS))
def event_windows_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rungs that hourly bars can answer, with the best and worst price of each window."""
    return _inner(spark, sf_dir, study.HOUR, _HOUR_RUNGS)


@query(_inner_sql(study.MINUTE, _MINUTE_RUNGS))
def event_windows_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rungs below an hour, on minute bars."""
    return _inner(spark, sf_dir, study.MINUTE, _MINUTE_RUNGS)


def _baselined(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, r, p = settled(d1(spark, sf_dir)), tables.releases(spark, sf_dir), _pairs(spark)
    return settled(baseline.matched_baseline(b, r, p, settled(study.event_windows(b, r, p))))


_BASE = _study_sql(""", rs AS (SELECT indicator, (epoch(ts)::BIGINT // 86400) AS slot FROM releases),
ru AS MATERIALIZED (SELECT i.indicator, s.slot, count(rs.slot) OVER (PARTITION BY i.indicator ORDER BY s.slot) AS upto, (rs.slot IS NOT NULL)::INT AS here
  FROM (SELECT DISTINCT indicator FROM releases) i CROSS JOIN (SELECT unnest(generate_series((SELECT min(slot) - 450 FROM rs), (SELECT max(slot) + 450 FROM rs))) AS slot) s
  LEFT JOIN rs ON rs.indicator = i.indicator AND rs.slot = s.slot),
hq AS MATERIALIZED (SELECT a.indicator, a.slot, a.here, horizon, days, CASE WHEN days >= 0 THEN a.slot + days ELSE a.slot - 1 END AS hi,
  CASE WHEN days >= 0 THEN a.slot - 1 ELSE a.slot + days - 1 END AS lo FROM ru a CROSS JOIN lad),
hd AS MATERIALIZED (SELECT q.indicator, q.slot, horizon, days, h.upto - l.upto AS held, CASE WHEN days >= 0 THEN q.here ELSE 0 END AS own
  FROM hq q JOIN ru h ON h.indicator = q.indicator AND h.slot = q.hi JOIN ru l ON l.indicator = q.indicator AND l.slot = q.lo),
cand AS (SELECT hd.indicator, rt.symbol, hd.horizon, hd.slot, held, ret FROM hd JOIN pairs ON pairs.indicator = hd.indicator
  JOIN rt ON rt.symbol = pairs.symbol AND rt.slot = hd.slot AND rt.horizon = hd.horizon WHERE ret IS NOT NULL),
ask AS (SELECT w.*, hd.held - hd.own AS allowed FROM w JOIN hd ON hd.indicator = w.indicator AND hd.slot = w.slot AND hd.horizon = w.horizon WHERE usable),
tq AS MATERIALIZED (SELECT a.*, wk, turn, shift, a.slot - 7 * wk + shift AS c_slot
  FROM ask a CROSS JOIN range(1, 49) t(wk) CROSS JOIN (VALUES (0, 0), (1, -1), (2, 1), (3, -2), (4, 2)) s(turn, shift)),
cm AS MATERIALIZED (SELECT * FROM cand),
tr AS (SELECT a.indicator, a.symbol, a.slot, a.horizon, wk, c.ret, row_number() OVER (PARTITION BY a.indicator, a.symbol, a.slot, a.horizon, wk ORDER BY turn) AS k
  FROM tq a JOIN cm c ON c.indicator = a.indicator AND c.symbol = a.symbol AND c.horizon = a.horizon AND c.slot = a.c_slot
  WHERE (shift = 0 OR (c.slot + 3) % 7 < 5) AND c.slot + greatest(0, a.days) < a.slot AND c.held <= a.allowed),
tk AS (SELECT *, row_number() OVER (PARTITION BY indicator, symbol, slot, horizon ORDER BY wk) AS n FROM tr WHERE k = 1),
bs AS (SELECT indicator, symbol, slot, horizon, count(*) AS bn, avg(ret) AS bm, stddev_samp(ret) AS bsd, avg(abs(ret)) AS ba FROM tk WHERE n <= 12 GROUP BY ALL),
bl AS (SELECT w.*, coalesce(bn, 0)::INT AS baseline_n, CASE WHEN bn >= 3 THEN bm END AS bm, CASE WHEN bn >= 3 THEN bsd END AS bsd, CASE WHEN bn >= 3 THEN ba END AS ba FROM w LEFT JOIN bs USING (indicator, symbol, slot, horizon))""")


@query(_BASE + " SELECT indicator, symbol, ts, horizon, baseline_n, round(bm, 6) AS baseline_mean, round(bsd, 6) AS baseline_sd, round(ba, 6) AS baseline_abs_mean FROM bl")
def matched_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _baselined(spark, sf_dir).select("indicator", "symbol", "ts", "horizon", "baseline_n", "baseline_mean", "baseline_sd", "baseline_abs_mean")
    return rounded(out, 6, "baseline_mean", "baseline_sd", "baseline_abs_mean")


def _impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shocks = literal_table(spark, tables.SHOCKS, ["shock_ts", "label"], ["timestamp_ntz", "string"])
    return study.impacts(_baselined(spark, sf_dir), shocks)


def _impacts_sql(step: int, shocks: list[tuple[str, str]]) -> str:
    named = ", ".join(f"(epoch(TIMESTAMP '{t}')::BIGINT // {step}, '{label}')" for t, label in shocks)
    return """, im0 AS (SELECT *, ret0 AS ret, ret0 - bm AS ab, abs(ret0) - ba AS ae FROM bl WHERE usable),
md AS (SELECT indicator, symbol, horizon, quantile_cont(ab, 0.5) AS m FROM im0 GROUP BY ALL), aw AS (SELECT im0.*, abs(ab - m) AS d FROM im0 JOIN md USING (indicator, symbol, horizon)),
mm AS (SELECT indicator, symbol, horizon, quantile_cont(d, 0.5) * 1.4826 AS s, count(d) AS nd FROM aw GROUP BY ALL),
sh(sslot, label) AS (VALUES """ + named + """),
im AS (SELECT aw.*, (SELECT first('window contains: ' || label ORDER BY sslot) FROM sh WHERE sslot BETWEEN least(slot, slot + days) AND greatest(slot, slot + days)) AS shock,
  coalesce(nd >= 5 AND d / nullif(s, 0) > 10, false) AS far FROM aw JOIN mm USING (indicator, symbol, horizon))"""


_IMPACTS = _BASE + _impacts_sql(study.DAY, tables.SHOCKS)


@query(_IMPACTS + """ SELECT indicator, symbol, ts, horizon, round(ab, 6) + 0.0::DOUBLE AS abnormal_ret, round(ae, 6) + 0.0::DOUBLE AS abs_excess, round(ab / nullif(bsd, 0), 4) + 0.0::DOUBLE AS standardised,
  coalesce(shock, CASE WHEN far THEN 'far from the median' END) AS outlier_reason FROM im""")
def event_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _impacts(spark, sf_dir).select("indicator", "symbol", "ts", "horizon", "abnormal_ret", "abs_excess", "standardised", "outlier_reason")
    return rounded(rounded(out, 6, "abnormal_ret", "abs_excess"), 4, "standardised")


_POOLED = """, pl AS (SELECT indicator, symbol, horizon, days, count(*) AS n, floor(quantile_cont(nullif(baseline_n, 0), 0.5))::INT AS baseline_n, avg(ab) AS ma, stddev_samp(ab) AS sd, avg((ab > 0)::INT) AS hr,
  avg(ae) AS me, stddev_samp(ae) AS sde, sum(abs(ret)) FILTER (ba <> 0) / nullif(sum(ba) FILTER (ba <> 0), 0) AS ratio FROM im WHERE ab IS NOT NULL GROUP BY ALL),
pt AS (SELECT *, CASE WHEN n >= 2 AND sd > 0 THEN sd / sqrt(n) END AS se, CASE WHEN n >= 2 AND sde > 0 THEN sde / sqrt(n) END AS ase FROM pl),
pv AS (SELECT *, (SELECT """ + _P + """ FROM (SELECT me / ase AS t, (n - 1)::INT AS v)) AS ap FROM pt),
rk AS (SELECT *, row_number() OVER (PARTITION BY indicator, symbol ORDER BY ap) AS k, count(ap) OVER (PARTITION BY indicator, symbol) AS m FROM pv),
cv AS (SELECT *, least(1, min(ap * m / k) OVER (PARTITION BY indicator, symbol ORDER BY k DESC)) AS q FROM rk)"""
_POOL = _IMPACTS + _POOLED


def _curve_sql(step: int) -> str:
    return f""" SELECT indicator, symbol, horizon, n, baseline_n, round(CASE WHEN n >= 20 THEN ma END, 6) AS mean_abnormal, round(CASE WHEN n >= 20 THEN se END, 6) AS std_error,
  round(CASE WHEN n >= 20 THEN hr END, 6) AS hit_rate, round(CASE WHEN n >= 20 THEN me END, 6) AS mean_abs_excess, round(CASE WHEN n >= 20 THEN ap END, 5) AS abs_p_value,
  round(CASE WHEN n >= 20 THEN q END, 5) AS abs_p_fdr, round(CASE WHEN n >= 20 THEN ratio END, 6) AS abs_ratio, round(2.8 * se, 6) AS detectability_floor,
  CASE WHEN abs(days) * {step} <= 4 * 3600 THEN 'high' WHEN abs(days) * {step} <= 72 * 3600 THEN 'medium' ELSE 'low' END AS attribution FROM cv"""


@query(_POOL + _curve_sql(study.DAY))
def decay_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(_impacts(spark, sf_dir))


def _curve(found: DataFrame) -> DataFrame:
    out = study.decay_curve(found, ["indicator", "symbol"]).drop("seconds", "p_value", "abs_std_error")
    return rounded(rounded(out, 6, "mean_abnormal", "std_error", "hit_rate", "mean_abs_excess", "abs_ratio", "detectability_floor"), 5, "abs_p_value", "abs_p_fdr")


#: A shock among the events, which lie in one month.
_EVENT_SHOCKS = [("2024-01-17 12:00:00", "outage")]


def _fine_base(step: int, rungs: dict[str, int]) -> str:
    """The matched baseline by its definition, on bars of ``step`` seconds: weeks from the nearest, stand-ins of a week in order."""
    held = "len(list_filter(l, lambda x: x >= least({m}, {m} + seconds * INTERVAL 1 SECOND) AND CASE WHEN seconds < 0 THEN x < {m} ELSE x <= {m} + seconds * INTERVAL 1 SECOND END{own}))"
    return _inner_ctes(step, rungs) + f""", rs AS (SELECT indicator, list(ts ORDER BY ts) AS l FROM ev GROUP BY 1), fb AS (SELECT symbol, min(bar_ts) AS t FROM b GROUP BY 1),
us AS (SELECT u.*, {held.format(m='ts', own=' AND x <> ts')} AS allowed, fb.t AS first_bar FROM u JOIN rs USING (indicator) JOIN fb USING (symbol) WHERE usable),
tq AS MATERIALIZED (SELECT us.*, wk, turn, shift, ts - wk * INTERVAL 7 DAY + shift * INTERVAL 1 DAY AS m FROM us CROSS JOIN range(1, 49) t(wk) CROSS JOIN (VALUES (0, 0), (1, -1), (2, 1), (3, -2), (4, 2)) s(turn, shift)
  WHERE ts - wk * INTERVAL 7 DAY + shift * INTERVAL 1 DAY + least(seconds, 0) * INTERVAL 1 SECOND >= first_bar),
tm AS (SELECT tq.* FROM tq JOIN rs USING (indicator) WHERE (shift = 0 OR isodow(m) < 6) AND m + greatest(seconds, 0) * INTERVAL 1 SECOND < ts AND {held.format(m='m', own='')} <= allowed),
t1 AS (SELECT tm.*, m + seconds * INTERVAL 1 SECOND AS mf, a.open AS ma FROM tm ASOF JOIN b a ON a.symbol = tm.symbol AND tm.m >= a.bar_ts),
tr AS (SELECT t1.*, CASE WHEN seconds >= 0 THEN ln(o.close / ma) ELSE ln(ma / o.open) END AS v FROM t1 ASOF JOIN b o ON o.symbol = t1.symbol AND t1.mf >= o.bar_ts),
tk AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY indicator, symbol, ts, horizon, wk ORDER BY turn) = 1),
tn AS (SELECT *, row_number() OVER (PARTITION BY indicator, symbol, ts, horizon ORDER BY wk) AS n FROM tk),
bs AS (SELECT indicator, symbol, ts, horizon, count(*) AS bn, avg(v) AS bm, stddev_samp(v) AS bsd, avg(abs(v)) AS ba FROM tn WHERE n <= 12 GROUP BY ALL),
bl AS (SELECT u.indicator, u.symbol, u.ts, u.horizon, u.seconds, epoch(u.ts)::BIGINT // {step} AS slot, (u.seconds // {step})::INT AS days, usable, r AS ret0, coalesce(bn, 0)::INT AS baseline_n,
  CASE WHEN bn >= 3 THEN bm END AS bm, CASE WHEN bn >= 3 THEN bsd END AS bsd, CASE WHEN bn >= 3 THEN ba END AS ba FROM u LEFT JOIN bs USING (indicator, symbol, ts, horizon))"""


def _fine_baselined(spark: SparkSession, sf_dir: str, step: int, rungs: dict[str, int]) -> DataFrame:
    b = settled(bars.ticks_to_bars(tables.ticks(spark, sf_dir), step))
    r = _alarms(spark, sf_dir).select("indicator", "ts").distinct()
    pairs = literal_table(spark, _GRADE_PAIRS, ["indicator", "symbol"], ["string", "string"])
    return settled(baseline.matched_baseline(b, r, pairs, settled(study.event_windows(b, r, pairs, rungs, step))))


def _fine_impacts(spark: SparkSession, sf_dir: str, step: int, rungs: dict[str, int]) -> DataFrame:
    shocks = literal_table(spark, _EVENT_SHOCKS, ["shock_ts", "label"], ["timestamp_ntz", "string"])
    return study.impacts(_fine_baselined(spark, sf_dir, step, rungs), shocks, step)


@query(_fine_base(study.HOUR, _HOUR_RUNGS) + " SELECT indicator, symbol, ts, horizon, baseline_n, round(bm, 6) AS baseline_mean, round(bsd, 6) AS baseline_sd, round(ba, 6) AS baseline_abs_mean FROM bl")
def matched_baseline_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal of every rung that hourly bars can answer, for moments within the hour."""
    out = _fine_baselined(spark, sf_dir, study.HOUR, _HOUR_RUNGS).select("indicator", "symbol", "ts", "horizon", "baseline_n", "baseline_mean", "baseline_sd", "baseline_abs_mean")
    return rounded(out, 6, "baseline_mean", "baseline_sd", "baseline_abs_mean")


@query(_fine_base(study.HOUR, _HOUR_RUNGS) + _impacts_sql(study.HOUR, _EVENT_SHOCKS) + _POOLED + _curve_sql(study.HOUR))
def decay_curve_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve of the rungs from an hour on, on hourly bars."""
    return _curve(_fine_impacts(spark, sf_dir, study.HOUR, _HOUR_RUNGS))


@query(_fine_base(study.MINUTE, _MINUTE_RUNGS) + _impacts_sql(study.MINUTE, _EVENT_SHOCKS) + _POOLED + _curve_sql(study.MINUTE))
def decay_curve_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve of the rungs below an hour, on minute bars."""
    return _curve(_fine_impacts(spark, sf_dir, study.MINUTE, _MINUTE_RUNGS))


_GATED = _POOL + """, c AS (SELECT indicator, symbol, horizon, days * 86400 AS seconds, n, CASE WHEN n >= 20 THEN me END AS eff, CASE WHEN n >= 20 THEN q END AS q, CASE WHEN n >= 20 THEN ratio END AS ratio FROM cv)"""


@query(_GATED + """, m AS (SELECT *, max(seconds) FILTER (seconds > 0 AND q < 0.05) OVER (PARTITION BY indicator, symbol) AS last FROM c)
SELECT indicator, symbol, max(n) AS n, arg_max(horizon, eff) FILTER (seconds > 0 AND eff IS NOT NULL) AS peak, round(max(eff) FILTER (seconds > 0), 6) AS peak_effect, round(arg_max(ratio, eff) FILTER (seconds > 0 AND eff IS NOT NULL), 6) AS peak_ratio,
 arg_max(horizon, seconds) FILTER (seconds > 0 AND q < 0.05) AS last_significant, arg_min(horizon, seconds) FILTER (seconds > last) AS first_insignificant,
 arg_max(horizon, seconds) FILTER (seconds < 0 AND q < 0.05 AND eff < 0) AS quiet_before, round(arg_max(ratio, seconds) FILTER (seconds < 0 AND q < 0.05 AND eff < 0), 6) AS quiet_ratio,
 coalesce(bool_or(seconds > 0 AND q < 0.05), false) AS any_effect FROM m GROUP BY indicator, symbol""")
def curve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.curve_summary(study.decay_curve(_impacts(spark, sf_dir), ["indicator", "symbol"]), ["indicator", "symbol"])
    return rounded(out, 6, "peak_effect", "peak_ratio", "quiet_ratio")


@query(_GATED + """, a AS (SELECT indicator, symbol, horizon, avg(abs(ret)) / 0.0001::DOUBLE AS mean FROM im GROUP BY ALL)
SELECT im.indicator, im.symbol, im.horizon, im.ts, round(abs(im.ret) / 0.0001::DOUBLE, 4) AS move, round(mean - eff / 0.0001::DOUBLE, 4) AS normal
FROM im JOIN a USING (indicator, symbol, horizon) LEFT JOIN c USING (indicator, symbol, horizon) WHERE im.horizon = '+1d'""")
def event_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moves of a day after each release, in pips, beside the normal level."""
    found, by = settled(_impacts(spark, sf_dir)), ["indicator", "symbol", "horizon"]
    out = summaries.event_scatter(found.where("horizon = '+1d'"), study.decay_curve(found, ["indicator", "symbol"]), by, 0.0001)
    return rounded(out.drop("is_outlier"), 4, "move", "normal")


_CHANGE = f"""WITH {RELEASES}, c AS (SELECT indicator, ts, (actual - previous)::DOUBLE AS ch FROM releases),
z AS (SELECT indicator, ts, CASE WHEN count(ch) OVER w >= 8 AND stddev_samp(ch) OVER w > 0 THEN ch / stddev_samp(ch) OVER w END AS z FROM c WHERE ch IS NOT NULL
  WINDOW w AS (PARTITION BY indicator ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = tables.releases(spark, sf_dir).select("indicator", "ts", (F.col("actual") - F.col("previous")).cast("double").alias("change"))
    return study.change_z(series, ["indicator"], "ts", "change")


@query(_CHANGE + " SELECT c.indicator, c.ts, round(z, 6) AS z FROM c LEFT JOIN z USING (indicator, ts)")
def change_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_changes(spark, sf_dir).select("indicator", "ts", "z"), 6, "z")


_FIT = _IMPACTS + """, c AS (SELECT indicator, ts, (actual - previous)::DOUBLE AS ch FROM releases),
z AS (SELECT indicator, ts, CASE WHEN count(ch) OVER v >= 8 AND stddev_samp(ch) OVER v > 0 THEN ch / stddev_samp(ch) OVER v END AS x FROM c WHERE ch IS NOT NULL
  WINDOW v AS (PARTITION BY indicator ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
xy AS (SELECT im.indicator, im.symbol, im.horizon, x, ab AS y FROM im JOIN z ON z.indicator = im.indicator AND z.ts = im.ts
  WHERE x IS NOT NULL AND ab IS NOT NULL AND shock IS NULL AND NOT far),
ft AS (SELECT indicator, symbol, horizon, count(*) AS n, regr_slope(y, x) AS beta, regr_r2(y, x) AS r2, sqrt(nullif(greatest(0, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)), 0) / (count(*) - 2) / regr_sxx(y, x)) AS se,
  count_if(x > 0)::BIGINT AS n_up, count_if(x < 0)::BIGINT AS n_down, regr_slope(y, x) FILTER (x > 0) AS bu, regr_slope(y, x) FILTER (x < 0) AS bd FROM xy GROUP BY ALL HAVING count(*) >= 3)"""


@query(_FIT + " SELECT indicator, symbol, horizon, n, n_up, n_down, round(beta, 5) AS beta, round(r2, 5) AS r_squared, round(se, 5) AS std_error, round(bu, 5) AS beta_up, round(bd, 5) AS beta_down FROM ft")
def direction_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression of abnormal return on the standardised change, without flagged rows."""
    kept = _impacts(spark, sf_dir).where("not is_outlier")
    joined = kept.join(_changes(spark, sf_dir).select("indicator", "ts", "z"), ["indicator", "ts"])
    out = study.direction_fit(joined, ["indicator", "symbol", "horizon"]).where("n >= 3")
    return rounded(out.select("indicator", "symbol", "horizon", "n", "n_up", "n_down", "beta", "r_squared", "std_error", "beta_up", "beta_down"), 5, "beta", "r_squared", "std_error", "beta_up", "beta_down")


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _alarms(spark, sf_dir)
    pairs = r.select("indicator", F.col("indicator").alias("symbol")).distinct()
    return validation.grade(r, h1(spark, sf_dir), pairs, least=2)


_GRADE = f"""WITH {H1}, rl AS (SELECT event_type AS indicator, ts, (user_id % 3)::INT AS importance, floor(epoch(ts))::BIGINT // 3600 AS hour FROM events WHERE json_extract_string(props, '$.k')::INT >= 90),
rg AS (SELECT symbol, epoch(bar_ts)::BIGINT // 3600 AS hour, ln(high / low) AS r FROM h1),
sp AS (SELECT indicator, ts, hour, o AS offset_h, hour + o AS spot FROM rl CROSS JOIN range(-3, 4) t(o)),
bk AS (SELECT sp.indicator, sp.ts, sp.offset_h, r, row_number() OVER (PARTITION BY sp.indicator, sp.ts, offset_h ORDER BY wk) AS k FROM sp CROSS JOIN range(1, 41) t(wk)
  JOIN rg ON rg.symbol = sp.indicator AND rg.hour = spot - 168 * wk WHERE NOT EXISTS (SELECT 1 FROM rl x WHERE x.indicator = sp.indicator AND x.hour = spot - 168 * wk)),
nm AS (SELECT indicator, ts, offset_h, CASE WHEN count(*) >= 2 THEN quantile_cont(r, 0.5) END AS normal FROM bk WHERE k <= 12 GROUP BY ALL),
rt AS (SELECT sp.indicator, sp.ts, sp.hour, sp.offset_h, CASE WHEN normal > 0 THEN rg.r / normal END AS ratio FROM sp LEFT JOIN rg ON rg.symbol = sp.indicator AND rg.hour = spot LEFT JOIN nm USING (indicator, ts, offset_h)),
be AS (SELECT indicator, ts, hour, max(ratio) FILTER (offset_h = 0) AS ratio, max(ratio) AS best, first(offset_h ORDER BY ratio DESC NULLS LAST, offset_h) AS o FROM rt GROUP BY ALL),
im AS (SELECT DISTINCT indicator, hour, importance FROM rl),
bl AS (SELECT DISTINCT a.indicator, a.hour, s.o FROM im a CROSS JOIN range(-3, 4) s(o) JOIN im b ON b.hour = a.hour + s.o AND b.indicator <> a.indicator AND b.importance >= a.importance WHERE s.o <> 0),
gr AS (SELECT be.indicator, be.ts, be.ratio, be.best, be.o, CASE WHEN be.ratio IS NULL THEN 'uncheckable' WHEN best < 1.5 THEN 'no_spike' WHEN be.ratio >= 1.5 AND be.ratio >= best * 0.9 THEN 'confirmed_hour'
  WHEN bl.o IS NOT NULL THEN 'confounded' ELSE 'offset' END AS status FROM be LEFT JOIN bl ON bl.indicator = be.indicator AND bl.hour = be.hour AND bl.o = be.o),
gd AS (SELECT indicator, ts, status, ratio, CASE WHEN status <> 'uncheckable' THEN best END AS best_ratio, CASE status WHEN 'confirmed_hour' THEN 0 WHEN 'offset' THEN o * 60 WHEN 'confounded' THEN o * 60 END AS offset_min FROM gr)"""


@query(_GRADE + " SELECT indicator, ts, status, round(ratio, 5) AS ratio, round(best_ratio, 5) AS best_ratio, offset_min::INT AS offset_min FROM gd")
def vol_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_grades(spark, sf_dir).drop("symbol").withColumn("offset_min", F.col("offset_min").cast("int")), 5, "ratio", "best_ratio")


@query(_GRADE + """ SELECT o * 60 AS offset_min, count(indicator) AS n FROM (SELECT unnest(range(-3, 4))::INT AS o) LEFT JOIN gd ON offset_min = o * 60 AND status IN ('confirmed_hour', 'offset') GROUP BY o""")
def offset_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.offset_histogram(_grades(spark, sf_dir))


@query("WITH rl AS (SELECT DISTINCT event_type AS indicator, (user_id % 3)::INT AS importance, floor(epoch(ts))::BIGINT // 3600 AS hour FROM events WHERE json_extract_string(props, '$.k')::INT >= 90) "
       "SELECT DISTINCT a.indicator, a.hour, s.o::INT AS \"offset\" FROM rl a CROSS JOIN range(-3, 4) s(o) JOIN rl b ON b.hour = a.hour + s.o AND b.indicator <> a.indicator AND b.importance >= a.importance WHERE s.o <> 0")  # fmt: skip
def blocked_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.blocked_offsets(_alarms(spark, sf_dir)).distinct()


def _verdict_sql(by: str, named: str) -> str:
    tail = "round(least(1, coalesce(list_sum(list_transform(range({h}, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(1.0::DOUBLE / 7) + (n - k) * ln(6.0::DOUBLE / 7)))), 0)), 12)"
    return _GRADE + f""", vt AS (SELECT {named}, status, ratio, CASE status WHEN 'confirmed_hour' THEN 0 WHEN 'offset' THEN offset_min END AS vote FROM gd),
ct AS (SELECT {by}, vote, count(*) AS k FROM vt WHERE vote IS NOT NULL GROUP BY ALL),
md AS (SELECT {by}, first(vote ORDER BY k DESC, abs(vote), vote) AS modal_offset, max(k) AS modal_n, sum(k)::BIGINT AS n, coalesce(sum(k) FILTER (vote = 0), 0)::BIGINT AS confirmed, max(k) FILTER (vote <> 0) AS best_off FROM ct GROUP BY ALL),
rt2 AS (SELECT {by}, count_if(status = 'no_spike')::BIGINT AS no_spike, count_if(status = 'confounded')::BIGINT AS confounded, quantile_cont(ratio, 0.5) FILTER (vote IS NOT NULL OR status = 'no_spike') AS median_ratio FROM vt GROUP BY ALL),
v0 AS (SELECT rt2.*, modal_offset, coalesce(n, 0) AS spiked, coalesce(confirmed, 0) AS confirmed, modal_n / n AS modal_share, coalesce(n, 0) + no_spike AS attributable,
  CASE WHEN n > 0 THEN {tail.format(h='modal_n')} END AS modal_p, CASE WHEN best_off > 0 THEN {tail.format(h='best_off')} END AS offset_p FROM rt2 LEFT JOIN md USING ({by})),
v1 AS (SELECT *, CASE WHEN attributable < {validation.MIN_VERDICT} THEN 'insufficient' WHEN spiked / nullif(attributable, 0) < {validation.SILENT_SHARE} THEN 'silent'
  WHEN modal_share < {validation.MODAL_SHARE} OR modal_p >= {validation.DECISIVE_P} THEN 'scattered' WHEN modal_offset = 0 THEN 'aligned' ELSE 'offset' END AS before FROM v0),
f0 AS (SELECT *, row_number() OVER (PARTITION BY offset_p IS NULL ORDER BY offset_p) AS fk, count(offset_p) OVER () AS fm FROM v1),
f1 AS (SELECT *, CASE WHEN offset_p IS NOT NULL THEN least(1, min(offset_p * fm / fk) OVER (PARTITION BY offset_p IS NULL ORDER BY fk DESC)) END AS offset_p_fdr FROM f0),
vd AS (SELECT {by}, no_spike, confounded, median_ratio, modal_offset, spiked, confirmed, modal_share, attributable, modal_p, offset_p, offset_p_fdr, before,
  CASE WHEN before = 'offset' AND coalesce(offset_p_fdr, 1) >= {validation.DECISIVE_P} THEN 'scattered' ELSE before END AS status FROM f1)"""


_VERDICT_COLUMNS = """no_spike, confounded, round(median_ratio, 6) AS median_ratio, modal_offset, spiked, confirmed, round(modal_share, 6) AS modal_share, attributable, round(modal_p, 6) AS modal_p, round(offset_p, 6) AS offset_p"""


@query(_verdict_sql("indicator", "indicator") + f" SELECT indicator, {_VERDICT_COLUMNS}, round(offset_p_fdr, 6) AS offset_p_fdr, status FROM vd")
def vol_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts per indicator after the sweep's correction."""
    found = validation.sweep(validation.verdicts(_grades(spark, sf_dir), ["indicator"]))
    return rounded(found, 6, "median_ratio", "modal_share", "modal_p", "offset_p", "offset_p_fdr")


_SUMMER = "epoch(timezone('America/New_York', timezone('UTC', ts)))::BIGINT - epoch(ts)::BIGINT = -14400"


@query(_verdict_sql("indicator, summer", f"indicator, {_SUMMER} AS summer") + f" SELECT indicator, summer, {_VERDICT_COLUMNS}, before AS status FROM vd")
def vol_verdicts_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for summer and winter time in New York apart: a clock that is an hour off in one of them looks scattered when pooled."""
    graded = _grades(spark, sf_dir).withColumn("summer", clock.is_summer_time(F.col("ts")))
    return rounded(validation.verdicts(graded, ["indicator", "summer"]), 6, "median_ratio", "modal_share", "modal_p", "offset_p")


@query(_GRADE + """, oc AS (SELECT indicator, offset_min, count(*) AS k FROM gd WHERE status = 'offset' GROUP BY ALL), om AS (SELECT indicator, first(offset_min ORDER BY k DESC, abs(offset_min), offset_min) AS m FROM oc GROUP BY 1),
mo AS (SELECT DISTINCT gd.indicator, floor((epoch(ts) + m * 60) / 3600)::BIGINT AS hour FROM gd JOIN om USING (indicator) WHERE status = 'offset' AND offset_min = m),
nb AS (SELECT mo.indicator, r.indicator AS neighbour, count(*) AS n FROM mo JOIN rl r ON r.hour = mo.hour AND r.indicator <> mo.indicator AND r.importance >= 1 GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY n DESC, neighbour) AS place FROM nb QUALIFY place <= 6""")
def offset_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What else is released in the hours in which an indicator's spikes land, at its most frequent offset."""
    graded = _grades(spark, sf_dir)
    moved = validation.verdicts(graded.where("status = 'offset'"), ["indicator"])
    # the events' importances run from 0 to 2
    return summaries.neighbours_at_offset(graded, moved, _alarms(spark, sf_dir), least=1)


#: Concept, importance and release group of each indicator.
_INDICATORS = [("1-URGENT", "rates", 3, "desk"), ("2-HIGH", "rates", 3, "desk"), ("3-MEDIUM", "growth", 2, None), ("4-NOT SPECIFIED", "growth", 1, None), ("5-LOW", "surveys", 1, None)]


@query(_POOL + """, ind(indicator, concept, importance, rg) AS (VALUES ('1-URGENT','rates',3,'desk'),('2-HIGH','rates',3,'desk'),('3-MEDIUM','growth',2,NULL),('4-NOT SPECIFIED','growth',1,NULL),('5-LOW','surveys',1,NULL)),
mr AS (SELECT cv.*, concept, importance, coalesce('group:' || rg, 'indicator:' || cv.indicator) AS tok FROM cv JOIN ind USING (indicator) WHERE horizon = '+1d' AND n >= 20 AND me IS NOT NULL),
rs2 AS (SELECT *, row_number() OVER (PARTITION BY ap IS NULL ORDER BY ap) AS sk, count(ap) OVER () AS sm FROM mr),
ps AS (SELECT *, CASE WHEN ap IS NOT NULL THEN least(1, min(ap * sm / sk) OVER (PARTITION BY ap IS NULL ORDER BY sk DESC)) END AS psw FROM rs2),
tkn AS (SELECT *, row_number() OVER (PARTITION BY tok, symbol ORDER BY indicator) = 1 AS c1 FROM ps WHERE ratio IS NOT NULL),
cp AS (SELECT concept, quantile_cont(ratio, 0.5) FILTER (c1) AS mrt, count(*) FILTER (c1) AS pairings, count(*) FILTER (c1 AND psw < 0.05) AS significant, (sum(n) FILTER (c1))::BIGINT AS releases,
  avg(importance) FILTER (c1) AS published, count(DISTINCT indicator) AS indicators, max(ratio) AS best FROM tkn GROUP BY concept)
SELECT concept, round(mrt, 6) AS median_ratio, pairings, significant, releases, published, indicators, round(best, 6) AS best, row_number() OVER (ORDER BY mrt DESC NULLS LAST, concept)::INT AS rank,
  row_number() OVER (ORDER BY published DESC NULLS LAST, concept)::INT AS published_rank FROM cp""")
def concept_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.operators import ranking

    indicators = literal_table(spark, _INDICATORS, ["indicator", "concept", "importance", "release_group"], ["string", "string", "int", "string"])
    out = ranking.concept_ranking(study.decay_curve(_impacts(spark, sf_dir), ["indicator", "symbol"]), indicators)
    return rounded(out.drop("best_indicator", "disagreement"), 6, "median_ratio", "best")
