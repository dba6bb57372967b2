"""Constructed cases with known answers."""

from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.functions import clock, statistics, text
from tidemill.operators import asof, bars, baseline, consolidation, execution, market, study, validation
from tidemill.streaming import live

T0 = datetime(2024, 9, 6, 12, 30)


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def ntz(spark, moments, name="ts"):
    return spark.createDataFrame([(m,) for m in moments], f"{name} timestamp_ntz")


@pytest.mark.parametrize(
    ("moment", "day"),
    [
        (datetime(2024, 7, 1, 20, 59), date(2024, 7, 1)),  # summer: 17:00 in New York is 21:00
        (datetime(2024, 7, 1, 21, 0), date(2024, 7, 2)),
        (datetime(2024, 1, 2, 21, 30), date(2024, 1, 2)),  # winter: 22:00
        (datetime(2024, 1, 2, 22, 0), date(2024, 1, 3)),
        (datetime(2024, 7, 5, 21, 30), date(2024, 7, 8)),  # Friday evening belongs to Monday
        (datetime(2024, 7, 6, 12, 0), date(2024, 7, 8)),
    ],
)
def test_trading_day(spark, moment, day):
    assert ntz(spark, [moment]).select(clock.trading_day(F.col("ts")).alias("d")).first()["d"] == day


def test_open_time(spark):
    hours = lambda a, b: ntz(spark, [a]).select((clock.open_seconds_between(F.col("ts"), F.lit(b).cast("timestamp_ntz")) / 3600).alias("h")).first()["h"]
    assert hours(datetime(2024, 7, 5, 20), datetime(2024, 7, 5, 22)) == 1  # the week ends at 21:00
    assert hours(datetime(2024, 7, 6, 0), datetime(2024, 7, 7, 21)) == 0
    assert hours(datetime(2024, 7, 1, 0), datetime(2024, 7, 8, 0)) == 120
    assert hours(datetime(2024, 3, 8, 22), datetime(2024, 3, 10, 22)) == 1  # clocks change in the weekend
    month = spark.range(1).select(clock.expected_minutes(F.lit("2024-09-01").cast("date")).alias("m")).first()["m"]
    assert month == sum(_open_minutes(datetime(2024, 9, 1) + timedelta(hours=h)) for h in range(30 * 24))


def _open_minutes(hour):  # September: New York is four hours behind
    local = hour - timedelta(hours=4)
    closed = (local.weekday() == 4 and local.hour >= 17) or local.weekday() == 5 or (local.weekday() == 6 and local.hour < 17)
    return 0 if closed else 60


def test_students_t_and_binomial(spark):
    p = lambda t, v: one(spark, statistics.t_two_sided_p(F.lit(t), F.lit(v)))
    for t, v, want in [(2.0, 10, 0.0733880348), (2.0, 9, 0.0765528), (1.0, 2, 0.4226497), (5.0, 233, 1.1275e-6), (1.0, 1, 0.5)]:
        assert p(t, v) == pytest.approx(want, rel=1e-4)
    assert p(None, 5) is None and p(1.0, 0) is None
    exact = lambda h, n, q: sum(math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(h, n + 1))
    for h, n in [(0, 5), (3, 10), (10, 10), (30, 100)]:
        assert one(spark, statistics.binomial_upper_tail(F.lit(h), F.lit(n), 1 / 7)) == pytest.approx(exact(h, n, 1 / 7), rel=1e-9)
    assert 0 < one(spark, statistics.binomial_upper_tail(F.lit(900), F.lit(6000), 1 / 7)) < 1


def test_false_discoveries(spark):
    p = [0.001, 0.04, None, 0.03, 0.5]
    df = statistics.bh_adjust(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double"), "p", "q")
    q = [r["q"] for r in df.orderBy("i").collect()]
    assert q[2] is None and q[0] == pytest.approx(0.004) and q[1] == q[3] == pytest.approx(0.16 / 3)
    assert all(b >= a for a, b in zip(p, q) if a is not None)


def test_outliers_need_spread_and_five_values(spark):
    rows = [("a", float(x)) for x in [1, 2, 3, 4, 1000]] + [("b", 1.0)] * 6 + [("b", 99.0)] + [("c", float(x)) for x in [1, 2, 900]]
    got = statistics.mad_outliers(spark.createDataFrame(rows, "g string, v double"), "v", ["g"])
    assert [(r["g"], r["v"]) for r in got.where("is_outlier").collect()] == [("a", 1000.0)]


def test_medians_are_exact_and_no_task_gets_a_group(spark):
    import random

    rng = random.Random(7)
    rows = [("a", rng.gauss(0, 1e6)) for _ in range(3001)] + [("b", float(rng.randint(0, 3))) for _ in range(1000)] + [("c", None)] * 3 + [("d", 2.0), ("d", None), ("d", 5.0), (None, 7.0)]
    rows += [("e", float(x)) for x in [1] * 500 + [9] * 500] + [("f", float("nan")), ("f", 1.0), ("f", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["m"], r["__n"]) for r in statistics.medians(df, "v", ["g"], "m").collect()}
    want = {r["g"]: (r["m"], r["n"]) for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m"), F.count("v").alias("n")).collect()}
    assert got == want
    plan = statistics.mad_outliers(df, "v", ["g"])._jdf.queryExecution().toString().lower()
    assert "broadcasthashjoin" in plan and "sortmergejoin" not in plan and " percentile(" not in plan


@pytest.mark.parametrize(
    ("raw", "value"),
    [("227K", 227000), ("3.2%", 3.2), ("-0.1%", -0.1), ("<0.1", 0.1), ("$52.3B", 52.3e9), ("1,234", 1234), ("", None), ("-", None), ("N/A", None), ("abc", None), (None, None), ("~5m", 5e6)],
)
def test_parse_numeric(spark, raw, value):
    got = spark.createDataFrame([(raw,)], "t string").select(text.parse_numeric(F.col("t")).alias("x")).first()["x"]
    assert (got is None) == (value is None) and (value is None or float(got) == value)


def test_periods(spark):
    rows = ["2024-03-05", "2024-03", "2024-Q3", "2024-S2", "2024", "nonsense"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(text.period_start(F.col("t")).alias("d")).collect()
    assert [r["d"] for r in got] == [date(2024, 3, 5), date(2024, 3, 1), date(2024, 7, 1), date(2024, 7, 1), date(2024, 1, 1), None]


def test_asof_across_buckets_and_ties(spark):
    left = spark.createDataFrame([("a", T0), ("a", T0 - timedelta(days=9)), ("b", T0)], "k string, ts timestamp_ntz")
    right = spark.createDataFrame([("a", T0 - timedelta(days=5), 1), ("a", T0, 2), ("a", T0, 3), ("a", T0 + timedelta(seconds=1), 4)], "k string, at timestamp_ntz, v int")
    got = {(r["k"], r["ts"]): r["v"] for r in asof.asof_backward(left, right, ["k"], "ts", "at", ["v"], ["v"]).collect()}
    assert got == {("a", T0): 3, ("a", T0 - timedelta(days=9)): None, ("b", T0): None}
    late = spark.createDataFrame([("a", T0 - timedelta(days=1)), ("a", T0 - timedelta(hours=1))], "k string, ts timestamp_ntz")
    fresh = {r["ts"]: r["v"] for r in asof.asof_within(late, right, ["k"], "ts", "at", ["v"], 4 * 86400 + 3600).collect()}
    assert fresh == {T0 - timedelta(days=1): 1, T0 - timedelta(hours=1): None}


def test_range_counts(spark):
    times = spark.createDataFrame([("a", T0 + timedelta(hours=h)) for h in (0, 0, 1, 30)], "k string, ts timestamp_ntz")
    asked = spark.createDataFrame([("a", T0), ("b", T0)], "k string, ts timestamp_ntz")
    n = lambda closed: {r["k"]: r["n"] for r in asof.count_between(times, asked, ["k"], "ts", F.col("ts"), F.col("ts") + F.expr("INTERVAL 1 HOUR"), closed).collect()}
    assert n(True) == {"a": 3, "b": 0} and n(False) == {"a": 2, "b": 0}


def test_bars_and_cleaning(spark):
    rows = [(i, "x", T0 + timedelta(seconds=s), b, b + 0.01) for i, (s, b) in enumerate([(0, 1.0), (10, 3.0), (20, 0.5), (20, 2.0), (3700, 9.0)])]
    ticks = spark.createDataFrame(rows, "id int, symbol string, ts timestamp_ntz, bid double, ask double")
    got = bars.ticks_to_bars(ticks, 3600).orderBy("bar_ts").collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["tick_count"]) for r in got] == [(1.0, 3.0, 0.5, 2.0, 4), (9.0, 9.0, 9.0, 9.0, 1)]
    assert got[0]["bar_ts"] == datetime(2024, 9, 6, 12)
    flags = {r["id"]: r["flag"] for r in bars.clean_ticks(ticks).collect()}
    assert set(flags) == {0, 1, 3, 4} and flags[0] == bars.FLAG_OK and flags[1] == bars.FLAG_GAP
    weeks = ntz(spark, [datetime(2024, 9, 2), datetime(2024, 9, 8)]).select(bars.week_label(F.col("ts")).alias("w")).collect()
    assert {r["w"] for r in weeks} == {datetime(2024, 9, 8)}


CLAIM = "identity string, field string, source string, seq long, value decimal(24,6)"


@pytest.mark.parametrize(
    ("claims", "value", "owner", "revisions", "disagreements", "cross"),
    [
        ([("mt5_calendar", 1)], 1, "mt5_calendar", 0, 0, "single"),
        ([("mt5_calendar", 1), ("mt5_calendar", 2)], 2, "mt5_calendar", 1, 0, "single"),
        ([("mt5_calendar", 1), ("agency_schedule", 1)], 1, "mt5_calendar", 0, 0, "agree"),
        ([("mt5_calendar", 1), ("agency_schedule", 2)], 2, "agency_schedule", 0, 1, "disagree"),
        ([("agency_schedule", 1), ("mt5_calendar", 2)], 1, "agency_schedule", 0, 1, "disagree"),
        ([("agency_schedule", 1), ("mt5_calendar", 2), ("mt5_calendar", 1)], 1, "agency_schedule", 0, 1, "disagree"),
        ([("nobody", 5), ("someone", 6)], 5, "nobody", 0, 1, "disagree"),
    ],
)
def test_merging_claims(spark, claims, value, owner, revisions, disagreements, cross):
    from decimal import Decimal

    df = spark.createDataFrame([("i", "actual_first_print", s, k, Decimal(v)) for k, (s, v) in enumerate(claims)], CLAIM)
    r = consolidation.merge_claims(df).first()
    assert (float(r["value"]), r["owner"], r["revisions"], r["disagreements"], r["cross_source"]) == (value, owner, revisions, disagreements, cross)


def test_chains_compare_with_the_row_before(spark):
    at = [0, 100, 200, 321, 5000, None]
    df = spark.createDataFrame([("i", None if s is None else T0 + timedelta(seconds=s)) for s in at], "k string, ts timestamp_ntz")
    assert [r["n"] for r in consolidation.gap_groups(df, ["k"], "ts").collect()] == [3]


def test_similar_names_equal_all_pairs(spark):
    import random

    rng = random.Random(1)
    names = [(i, "g", " ".join(rng.sample("cpi core yoy mom final flash index price rate".split(), rng.randint(1, 5)))) for i in range(60)]
    got = {(r["a"], r["b"]) for r in consolidation.similar_names(spark.createDataFrame(names, "k int, g string, n string"), "g", "n", "k").collect()}
    sets = [set(n.split()) for _, _, n in names]
    assert got == {(i, j) for j in range(60) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6}


def test_sentinels(spark):
    v = [-(2**63), -(2**63) / 1e6, 1e12, 2e17]
    got = spark.createDataFrame([(float(x),) for x in v], "v double").select(consolidation.is_sentinel(F.col("v")).alias("s"), consolidation.is_absurd(F.col("v")).alias("a")).collect()
    assert [(r["s"], r["a"]) for r in got] == [(True, True), (True, False), (False, False), (False, True)]


def flat_days(spark, n, jump=None, at=None):
    start = datetime(2023, 1, 2)
    rows = []
    for d in range(n):
        p = 1.1 if jump is None or start + timedelta(days=d) < at else 1.1 * math.exp(jump)
        rows.append(("X", start + timedelta(days=d), p, p, p, p))
    return spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double")


def test_event_study_finds_a_step(spark):
    at = datetime(2024, 3, 6)
    releases = spark.createDataFrame([("i", at)], "indicator string, ts timestamp_ntz")
    pairs = spark.createDataFrame([("X", "i")], "symbol string, indicator string")
    b = flat_days(spark, 800, 0.01, at + timedelta(days=1))
    rows = baseline.matched_baseline(b, releases, pairs, study.event_windows(b, releases, pairs))
    got = {r["horizon"]: r for r in rows.collect()}
    assert got["+1d"]["ret"] == pytest.approx(0.01) and got["-1d"]["ret"] == pytest.approx(0.0)
    assert got["+1d"]["baseline_n"] == 12 and got["+1d"]["baseline_mean"] == pytest.approx(0.0)
    quiet = flat_days(spark, 300)
    assert {r["ret"] for r in study.event_windows(quiet, spark.createDataFrame([("i", datetime(2023, 6, 7))], "indicator string, ts timestamp_ntz"), pairs).collect()} == {0.0}


def test_weekly_series_is_not_its_own_baseline(spark):
    weekly = [datetime(2023, 1, 4) + timedelta(weeks=w) for w in range(60)]
    releases = spark.createDataFrame([("i", t) for t in weekly], "indicator string, ts timestamp_ntz")
    pairs = spark.createDataFrame([("X", "i")], "symbol string, indicator string")
    rows = [("X", datetime(2023, 1, 2) + timedelta(days=d), 1.0, 1.0, 1.0, 1.05 if (datetime(2023, 1, 2) + timedelta(days=d)) in weekly else 1.0) for d in range(430)]
    b = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double")
    ladder = {"-1d": -86400, "+1d": 86400}
    got = baseline.matched_baseline(b, releases, pairs, study.event_windows(b, releases, pairs, ladder)).where("horizon = '+1d'")
    r = got.where(F.col("ts") == F.lit(weekly[50])).first()
    assert r["baseline_n"] == 12 and r["baseline_abs_mean"] == pytest.approx(0.0)


def test_pooling_and_gate(spark):
    rows = [("i", "X", "+1d", 86400, 0.01 + 0.001 * (k % 3), 0.01, 0.02, 0.01, 12) for k in range(25)]
    cols = "indicator string, symbol string, horizon string, seconds int, abnormal_ret double, abs_excess double, abs_ret double, baseline_abs_mean double, baseline_n int"
    r = study.decay_curve(spark.createDataFrame(rows, cols), ["indicator", "symbol"]).first()
    assert r["n"] == 25 and r["abs_ratio"] == pytest.approx(2.0) and r["hit_rate"] == 1.0 and r["attribution"] == "medium"
    few = study.decay_curve(spark.createDataFrame(rows[:10], cols), ["indicator", "symbol"]).first()
    assert few["mean_abnormal"] is None and few["n"] == 10 and few["detectability_floor"] is not None


def test_change_z_uses_the_past_alone(spark):
    rows = [("i", T0 + timedelta(days=d), None if d == 3 else float((-1) ** d * (d + 1))) for d in range(15)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    a = [r["z"] for r in study.change_z(df, ["k"], "ts", "v").orderBy("ts").collect()]
    b = [r["z"] for r in study.change_z(df.where(F.col("ts") < F.lit(T0 + timedelta(days=12))), ["k"], "ts", "v").orderBy("ts").collect()]
    assert a[:12] == b and a[3] is None and a[8] is None and a[9] is not None


def test_direction_recovers_a_slope(spark):
    rows = [("i", float(x), 0.5 * x + 0.01 * (-1) ** k) for k, x in enumerate([-3, -2, -1, 1, 2, 3, 4, -4])]
    r = study.direction_fit(spark.createDataFrame(rows, "k string, z double, abnormal_ret double"), ["k"]).first()
    assert r["beta"] == pytest.approx(0.5, abs=0.01) and r["n_up"] == 4 and r["p_value"] < 1e-6 and r["beta_up"] > 0


def hourly(spark, spike_at=None):
    start = datetime(2024, 1, 1)
    rows = []
    for h in range(7000):
        t = start + timedelta(hours=h)
        w = 0.0040 if t == spike_at else 0.0005
        rows.append(("X", t, 1.1, 1.1 + w, 1.1 - w, 1.1))
    return spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double")


def test_a_spike_is_found_where_it_is(spark):
    at = datetime(2024, 9, 6, 13, 30)
    r = spark.createDataFrame([("i", at, 3)], "indicator string, ts timestamp_ntz, importance int")
    pairs = spark.createDataFrame([("i", "X")], "indicator string, symbol string")
    grade = lambda b, rel=r: validation.grade(rel, b, pairs).where("indicator = 'i'").first()
    assert grade(hourly(spark, datetime(2024, 9, 6, 13)))["status"] == "confirmed_hour"
    late = grade(hourly(spark, datetime(2024, 9, 6, 14)))
    assert (late["status"], late["offset_min"]) == ("offset", 60)
    assert grade(hourly(spark))["status"] == "no_spike"
    both = r.union(spark.createDataFrame([("heavy", datetime(2024, 9, 6, 14), 3)], r.schema))
    assert grade(hourly(spark, datetime(2024, 9, 6, 14)), both)["status"] == "confounded"


def test_verdict_ladder(spark):
    make = lambda k, rows: [(k, s, o, 2.0) for s, o, n in rows for _ in range(n)]
    rows = make("few", [("confirmed_hour", 0, 4)]) + make("silent", [("no_spike", None, 40), ("confirmed_hour", 0, 2)]) + make("aligned", [("confirmed_hour", 0, 18), ("offset", 60, 2)])
    rows += make("late", [("offset", 60, 18), ("confirmed_hour", 0, 2)]) + make("mixed", [("offset", 60 * k, 2) for k in (-3, -2, -1, 1, 2, 3)])
    got = validation.sweep(validation.verdicts(spark.createDataFrame(rows, "k string, status string, offset_min int, ratio double"), ["k"]))
    assert {r["k"]: r["status"] for r in got.collect()} == {"few": "insufficient", "silent": "silent", "aligned": "aligned", "late": "offset", "mixed": "scattered"}


def test_smoothing_against_loops(spark):
    closes = [1.0, 2.0, 4.0, 8.0, 16.0, 3.0]
    rows = [("X", T0 + timedelta(hours=h), c, c + 1, c - 1, c) for h, c in enumerate(closes)]
    b = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double")
    got = [r["ema"] for r in market.ema(b, 3).orderBy("bar_ts").collect()]
    x = sum(closes[:3]) / 3
    want = [None, None, x]
    for c in closes[3:]:
        x += 0.5 * (c - x)
        want.append(x)
    assert got[:2] == want[:2] and got[2:] == pytest.approx(want[2:])
    assert market.atr(b, 3).orderBy("bar_ts").first()["atr"] == pytest.approx(2.0)


def test_swings_wait_for_the_right_side(spark):
    highs = [1, 2, 5, 5, 1, 1, 7]
    rows = [("X", T0 + timedelta(hours=h), float(x), float(x), 0.0, float(x)) for h, x in enumerate(highs)]
    b = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double")
    got = market.swings(b).where("kind = 'high'").collect()
    assert [(r["bar_ts"], r["known_ts"]) for r in got] == [(T0 + timedelta(hours=2), T0 + timedelta(hours=4))]


def test_a_tick_that_meets_both_closes_at_the_stop(spark):
    tick = lambda i, s, bid: (i, "X", T0 + timedelta(seconds=s), bid, bid + 0.1)
    ticks = spark.createDataFrame([tick(0, 0, 99.0), tick(1, 1, 100.0), tick(2, 2, 100.5), tick(3, 3, 98.0), tick(4, 4, 120.0)], "id int, symbol string, ts timestamp_ntz, bid double, ask double")
    orders = spark.createDataFrame([(1, "X", 1, T0, 1.0, 5.0), (2, "X", -1, T0, 50.0, 1.0), (3, "X", 1, T0 + timedelta(hours=1), 1.0, 1.0)], "order_id int, symbol string, side int, placed_ts timestamp_ntz, stop double, target double")
    got = {r["order_id"]: r for r in execution.bracket_outcomes(orders, ticks).collect()}
    assert got[1]["entry_price"] == 100.1 and got[1]["exit_reason"] == "stop" and got[1]["exit_price"] == 98.0
    assert got[2]["exit_reason"] == "target" and got[2]["gain"] == pytest.approx(1.9)
    assert got[3]["exit_reason"] == "pending" and got[3]["entry_ts"] is None


def test_orders_against_a_walk_over_ticks(spark):
    import random

    rng, at, mid, ticks = random.Random(6), T0, 100.0, []
    for i in range(3000):
        at += timedelta(seconds=rng.choice([0, 1, 7, 40, 900, 20_000 if i % 50 == 0 else 3]))
        mid += rng.gauss(0, 1)
        ticks.append((i, "X", at, mid, mid + rng.choice([0.1, 0.5])))
    orders = []
    for n in range(120):
        placed = rng.choice(ticks[:2900])
        orders.append((n, "X", rng.choice([1, -1]), placed[2], rng.choice([2.0, 8.0, 40.0]), rng.choice([3.0, 12.0, 60.0]), rng.choice([None, "market", "stop", "limit"]), placed[3] + rng.gauss(0, 6)))

    def walk(o):
        _, _, side, placed, stop, target, kind, price = o
        entry = None
        for _, _, ts, bid, ask in ticks:
            if entry is None and ts > placed:
                px = ask if side > 0 else bid
                if kind in (None, "market") or ((px >= price) if (side > 0) == (kind == "stop") else (px <= price)):
                    entry = (ts, px)
            if entry is not None and ts >= entry[0]:
                px = bid if side > 0 else ask
                if (px <= entry[1] - stop) if side > 0 else (px >= entry[1] + stop):
                    return (*entry, ts, px, "stop")
                if (px >= entry[1] + target) if side > 0 else (px <= entry[1] - target):
                    return (*entry, ts, px, "target")
        return (None, None, None, None, "pending") if entry is None else (*entry, None, None, "open")

    t = spark.createDataFrame(ticks, "id int, symbol string, ts timestamp_ntz, bid double, ask double")
    o = spark.createDataFrame(orders, "order_id int, symbol string, side int, placed_ts timestamp_ntz, stop double, target double, kind string, price double")
    got = {r["order_id"]: (r["entry_ts"], r["entry_price"], r["exit_ts"], r["exit_price"], r["exit_reason"]) for r in execution.bracket_outcomes(o, t).collect()}
    want = {x[0]: walk(x) for x in orders}
    assert {x[-1] for x in want.values()} == {"stop", "target", "open", "pending"} and got == want


def test_journal(spark):
    rows = [("a", i, n, n / 10) for i, n in enumerate([10.0, -5.0, -5.0, 20.0])]
    t = spark.createDataFrame(rows, "k string, i int, net double, r double")
    s = execution.journal_summary(t, ["k"]).first()
    assert (s["n"], s["wins"], s["profit_factor"], s["win_rate"]) == (4, 2, 3.0, 0.5) and s["win_low"] < 0.5 < s["win_high"]
    d = execution.drawdown(t, ["k"], ["i"]).first()
    assert (d["equity"], d["peak"], d["max_drawdown"], d["max_drawdown_at"]) == (20.0, 20.0, 10.0, 2)


def test_no_look_ahead_and_restart(spark):
    rows = [(i, "X", T0 + timedelta(minutes=i), float(i), float(i) + 0.1) for i in range(200)]
    ticks = spark.createDataFrame(rows, "id int, symbol string, ts timestamp_ntz, bid double, ask double")
    clock_at = str(T0 + timedelta(minutes=100))
    early = ticks.where(F.col("ts") <= F.lit(T0 + timedelta(minutes=100)))
    a = sorted(map(tuple, live.forming(ticks, clock_at, 3600).collect()))
    assert a == sorted(map(tuple, live.forming(early, clock_at, 3600).collect())) and {r[-1] for r in a} == {True, False}
    same = spark.createDataFrame([(1, "X", T0, 1.0, 1.1), (2, "X", T0, 1.0, 1.1), (3, "X", T0, 1.0, 1.1)], ticks.schema)
    assert [r["id"] for r in live.after_restart(same, same.where("id < 3")).collect()] == [3]


def test_ticks_cleaned_in_blocks_equal_windows(spark, monkeypatch):
    import random

    import numpy as np

    from tidemill.operators import bars, blocks

    draw = random.Random(5)
    mids = [None if i % 97 == 0 else 100 + draw.gauss(0, 1) + (40 if i % 331 == 0 else 0) for i in range(2600)]
    middle, deviation = bars.surroundings(np.array(mids, float))
    for i in (0, 1, 97, 499, 500, 501, 1300, 2100, 2101, 2599):
        w = [x for x in mids[max(0, i - 500) : i + 500] if x is not None]
        assert abs(middle[i] - np.median(w)) < 1e-9 and abs(deviation[i] - np.std(w, ddof=1)) < 1e-9
    rows = [(i, "S", 1_704_067_200_000_000 + i * 900_000 + (i % 7 == 0) * 5_000_000, None if m is None else m - 0.01, m) for i, m in enumerate(mids)]
    ticks = spark.createDataFrame(rows, "id long, symbol string, us long, bid double, ask double").withColumn("ts", F.expr("cast(timestamp_micros(us) as timestamp_ntz)"))
    whole = {r["id"]: r["flag"] for r in bars.clean_ticks(ticks).collect()}
    monkeypatch.setattr(blocks, "SIZE", 512)
    assert {r["id"]: r["flag"] for r in bars.clean_ticks(ticks).collect()} == whole and len(whole) == 2600
    assert {i for i, f in whole.items() if f == bars.FLAG_JUMP} == {i for i in range(331, 2600, 331) if i % 97}


def test_similar_names_of_large_classes_and_repeated_keys(spark, monkeypatch):
    from tidemill.operators import consolidation

    monkeypatch.setattr(consolidation, "CLASS_CHUNK", 3)
    kinds = ["red iron bolt", "bolt, iron RED", "red iron nut", "red iron nut big", "green cup", "the of", ""]
    rows = [(g, i % 40, kinds[i % 7]) for i in range(90) for g in ("A", "B", None)] + [("A", None, "red iron bolt")]
    words = {k: frozenset(w.strip(",") for w in k.lower().split()) - {"the", "of"} for k in kinds}
    want = {}
    for g, k, x in rows:
        for h, j, y in rows:
            if g and g == h and k is not None and j is not None and k < j and words[x] and words[y] and (score := len(words[x] & words[y]) / len(words[x] | words[y])) >= 0.6:
                want[g, k, j, round(score, 9)] = want.get((g, k, j, round(score, 9)), 0) + 1
    found = consolidation.similar_names(spark.createDataFrame(rows, "g string, k long, n string"), "g", "n", "k").collect()
    got = {}
    for r in found:
        at = r["g"], r["a"], r["b"], round(r["score"], 9)
        got[at] = got.get(at, 0) + 1
    assert got == want and max(want.values()) > 1


def test_restart_counts_rounded_milliseconds_and_ticks_without_id(spark):
    import duckdb

    from tidemill.plans import ORACLES
    from tidemill.streaming import live

    micros = [760_563, 761_308, 760_499, 760_500, 761_499, 761_500, -1_500, -1_499, -500, -499, 499, 500]
    rows = [(None if (i + j) % 4 == 0 else 10 * i + j, u) for i, u in enumerate(micros) for j in range(3)]
    events = spark.createDataFrame(rows, "id long, us long").selectExpr("id", "'X' as symbol", "cast(timestamp_micros(us) as timestamp_ntz) as ts", "1D as bid", "2D as ask")
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, us BIGINT)")
    con.executemany("INSERT INTO e VALUES (?, ?)", rows)
    con.execute("CREATE VIEW events AS SELECT event_id, make_timestamp(us) AS ts, 'X' AS event_type, 0 AS value, '{\"k\": 1}' AS props FROM e")
    want = con.execute(ORACLES["restart_dedupe"]).fetchall()
    got = live.after_restart(events, events.where("id % 3 <> 0")).select("id", "symbol", "ts").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_summary_operators_on_odd_rows(spark):
    from tidemill.functions import text
    from tidemill.operators import summaries

    days = [("EU", "a", "2024-01-01 10:00:00"), ("EU", "b", "2024-01-01 10:05:00"), ("EU", "c", "2024-01-01 10:05:01"), ("EU", "c", "2024-01-01 09:00:00"),
            ("JP", "c", "2024-01-01 10:00:00"), ("JP", "z", "2024-01-02 10:00:00"), ("US", "b", None)]
    d = spark.createDataFrame(days, "k string, source string, last string").selectExpr("k", "source", "cast(last as timestamp_ntz) as last_ts")
    got = {r["k"]: r["source"] for r in summaries.best_source(d, ["k"], ["a", "b", "c"]).collect()}
    assert got == {"EU": "c", "JP": "c", "US": "b"}
    assert summaries.best_source(d.limit(0), ["k"], ["a", "b", "c"]).count() == 0

    ts = "cast('2024-01-01' as timestamp_ntz) as ts"
    r = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "indicator string").selectExpr("indicator", ts)
    assert sorted((q["indicator"], q["neighbour"], q["n"]) for q in summaries.co_timed(r).collect()) == [("x", "y", 1), ("y", "x", 1)]

    quotes = spark.createDataFrame([(1, "EU", 1.5, 1.75), (2, "EU", 1.25, 1.5)], "id long, symbol string, bid double, ask double").selectExpr("*", ts)
    held = spark.createDataFrame([("EU", 1, 2.0, 1.0), ("EU", -1, 2.0, 1.0), ("JP", 1, 1.0, 1.0)], "symbol string, side int, lots double, entry double")
    book = sorted((q["symbol"], q["side"], q["mark"], q["profit"]) for q in summaries.open_book(held, quotes, "2024-01-02 00:00:00", 0.01, 100).collect())
    assert book == [("EU", -1, 1.5, -100.0), ("EU", 1, 1.25, 50.0), ("JP", 1, None, None)]

    names = spark.createDataFrame([("Core CPI m/m", None), ("", None), ("the of", ""), ("Home Sales", "HOME_SALES_LONG"), (None, None)], "name string, canon string")
    codes = [q[0] for q in names.select(text.short_code(F.lit("US"), F.col("name"), F.col("canon"))).collect()]
    assert codes == ["US CPI", "US ", "US THE", "HOME_SALES_L", "US"]
    figures = spark.createDataFrame([(x,) for x in (0.0, 1.5, 142000.0, 7180000.0, -2500.0, 350.4, 1e12, None)], "v double")
    assert [q[0] for q in figures.select(text.compact(F.col("v"))).collect()] == ["0", "1.5", "142K", "7.2M", "-2.5K", "350", "1T", None]


def test_numbers_as_text(spark):
    from decimal import Decimal

    from tidemill.functions import text

    rows = [(Decimal(v), n) for v, n in (("7180000", ""), ("272000", "Payrolls"), ("0.4", "CPI m/m"), ("-7600000000", ""), ("1234.5", ""), ("0", "Bank Rate"))]
    got = spark.createDataFrame(rows, "v decimal(24,6), n string").select(text.marker_number(F.col("v")).alias("m"), text.calendar_number(F.col("v"), F.col("n")).alias("c")).collect()
    assert [r["m"] for r in got] == ["7.18M", "272K", "0.4", "-7.6B", "1.23K", "0"]
    assert [r["c"] for r in got] == ["7.18M", "272K", "0.4%", "-7.6B", "1234.5", "0%"]


def test_structure_turns(spark):
    from tidemill.operators import market

    closes = [1, 2, 5, 2, 1, 2, 6, 3, 1, 2, 3, 0.5, 0.4]
    rows = [("s", T0 + timedelta(hours=i), c, c + 0.1, c - 0.1, float(c)) for i, c in enumerate(map(float, closes))]
    got = market.structure(spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double")).orderBy("bar_ts").collect()
    assert [(r["kind"], r["side"]) for r in got] == [("BOS", "buy"), ("CHoCH", "sell")]
    assert [round(r["level"], 1) for r in got] == [5.1, 0.9]


def test_windows_below_a_day(spark):
    at = datetime(2024, 6, 5, 12)
    rows = [("s", at + timedelta(hours=i), 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i) for i in range(-6, 7)]
    b = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double")
    r = spark.createDataFrame([("i", at), ("i", at + timedelta(minutes=30))], "indicator string, ts timestamp_ntz")
    pairs = spark.createDataFrame([("i", "s")], "indicator string, symbol string")
    got = {(x["ts"].minute, x["horizon"]): x for x in study.event_windows(b, r, pairs, {"+4h": 14400, "-1h": -3600}, 3600).collect()}
    whole, within, before = got[0, "+4h"], got[30, "+4h"], got[30, "-1h"]
    assert (whole["n_bars"], within["n_bars"], before["n_bars"]) == (5, 4, 1)
    assert math.isclose(whole["mfe"], math.log(105 / 100)) and math.isclose(whole["mae"], math.log(99 / 100))
    assert math.isclose(within["mfe"], math.log(105 / 100)) and math.isclose(within["mae"], math.log(100 / 100), abs_tol=1e-12)
    assert math.isclose(before["ret"], math.log(100 / 99)) and len(study.LADDER) == 17 and len(study.supported(3600)) == 11


def test_first_touch_without_rows_for_each_block(spark):
    import random
    from datetime import timedelta

    rng, start = random.Random(9), datetime(1969, 12, 31, 23, 0)
    moments = [start + timedelta(seconds=rng.choice([1, 5000, 90_000, 6_000_000]) * rng.random()) for _ in range(300)] + [start + timedelta(milliseconds=i) for i in range(100)]
    rows = [(i, "s", m, float(rng.randint(1, 60)), float(rng.randint(1, 60))) for i, m in enumerate(moments)]
    asked = [(i, "s", start + timedelta(seconds=rng.choice([0, 1, 4000, 100_000]) * rng.random()), rng.choice(["bid", "ask"]), float(rng.randint(0, 9)), float(rng.randint(50, 61))) for i in range(120)]
    ticks = spark.createDataFrame(rows, "id long, symbol string, ts timestamp_ntz, bid double, ask double")
    found = execution.first_touch(spark.createDataFrame(asked, "id long, symbol string, from_ts timestamp_ntz, of string, below double, above double"), ticks)
    want = {}
    for i, _, since, of, below, above in asked:
        hits = sorted((m, k, b, a) for k, _, m, b, a in rows if m >= since and ((b if of == "bid" else a) <= below or (b if of == "bid" else a) >= above))
        if hits:
            want[i] = (hits[0][0], *hits[0][2:])
    assert want and {r["id"]: (r["ts"], r["bid"], r["ask"]) for r in found.collect()} == want
    # hours and coarser blocks are few: orders are dealt out among copies of them
    assert "copy" in found._jdf.queryExecution().toString()


def test_journal_median_meets_in_no_single_task(spark):
    t = spark.createDataFrame([(None, 1.0, 0.5), (None, -1.0, -1.0), (2, 3.0, None), (2, 3.0, 4.0), (2, 3.0, 7.0)], "k int, net double, r double")
    s = execution.journal_summary(t, ["k"])
    assert {r["k"]: (r["n"], r["median_r"]) for r in s.collect()} == {None: (2, -0.25), 2: (3, 5.5)}
    assert "percentile(" not in s._jdf.queryExecution().toString().replace("approx_percentile(", "")


def test_drawdown_carries_from_block_to_block(spark):
    rng = random.Random(7)
    trades = [(k, i * 700 - 40_000, i % 3, float(rng.randint(-50, 48))) for k in ("a", None) for i in range(300)]
    trades = [t[:3] + (None,) if n % 41 == 0 else t for n, t in enumerate(trades)]
    rng.shuffle(trades)
    got = execution.drawdown(spark.createDataFrame(trades, "k string, i long, j int, net double"), ["k"], ["i", "j"], start=5.0)
    # rows of a key alone are in no window: only the blocks' sums are
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window" in line and "net#" in line]
    found = {r["k"]: r for r in got.collect()}
    assert set(found) == {"a", None}
    for k, r in found.items():
        equity = peak = 5.0
        worst, seen = (-1.0, None), False
        for _, i, _, net in sorted((t for t in trades if t[0] == k), key=lambda t: t[1:3]):
            seen, equity = seen or net is not None, equity + (net or 0.0)
            peak = max(peak, equity)
            if seen and round(peak - equity, 6) > worst[0]:
                worst = (round(peak - equity, 6), i)
        assert (r["equity"], r["peak"], r["max_drawdown"], r["max_drawdown_at"]) == (equity, peak, *worst)


def test_grades_are_worked_out_once_for_each_hour(spark):
    t0 = datetime(2024, 3, 4, 10)
    bars = [("x", t0 - timedelta(weeks=w) + timedelta(hours=o), 1.0, 1.0 + 0.01 * (9 if (w, o) == (0, 1) else 1), 1.0, 1.0) for w in range(10) for o in range(-4, 5)]
    bars = spark.createDataFrame(bars, "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double")
    releases = spark.createDataFrame([("x", t0 + timedelta(seconds=s), 1) for s in range(300)], "indicator string, ts timestamp_ntz, importance int")
    got = validation.grade(releases, bars, spark.createDataFrame([("x", "x")], "indicator string, symbol string"), least=2)
    rows = got.collect()
    assert len({r["ts"] for r in rows}) == len(rows) == 300 and {(r["status"], r["offset_min"]) for r in rows} == {("offset", 60)}
    # the weeks of 7 hours are looked up, not those of 300 releases
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    weeks = next(n for n, line in enumerate(plan) if "Generate explode" in line and "week#" in line)
    assert any("Aggregate" in line and "ts#" not in line for line in plan[weeks : weeks + 3])
