"""Areas of price, intervals at clocks and windows in blocks, each against a plain walk."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.operators import baseline, blocks, intervals, market, study, zones

T0, HOUR = datetime(2024, 3, 4), timedelta(hours=1)
BARS = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double"


def walk(symbol, n, seed, gap=0.1):
    """Random bars whose prices come back, some hours missing."""
    rng, out, p = random.Random(seed), [], 100.0
    for h in range(n):
        if rng.random() < gap:
            continue
        o = p
        step = rng.choice([0.05, 0.05, 0.3, 1.2])
        p = round(min(110.0, max(90.0, p + rng.gauss(0, step))), 2)
        hi, lo = max(o, p) + round(abs(rng.gauss(0, 0.1)), 2), min(o, p) - round(abs(rng.gauss(0, 0.1)), 2)
        out.append((symbol, T0 + h * HOUR, o, round(hi, 2), round(lo, 2), p))
    return out


@pytest.fixture(scope="module")
def rows():
    return walk("A", 700, 1) + walk("B", 500, 2)


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "SIZE", 64)


def by_symbol(rows):
    return {s: sorted(r[1:] for r in rows if r[0] == s) for s in {r[0] for r in rows}}


def plain_atr(b, n=14):
    out = []
    for i, (_, _, h, lo, _) in enumerate(b):
        prev = b[i - 1][4] if i else b[0][4]
        tr = max(h - lo, abs(h - prev), abs(lo - prev))
        out.append(tr if not i else out[-1] + (tr - out[-1]) / min(i + 1, n))
    return [round(x, 9) for x in out]


def plain_zones(b):
    at, out = plain_atr(b), []
    for k in range(3, len(b)):
        a, o, c = at[k - 1], b[k][1], b[k][4]
        d = (c > o) - (c < o)
        end = None
        for m in range(k, min(k + 3, len(b))) if d else ():
            body, span = (b[m][4] - b[m][1]) * d, b[m][2] - b[m][3]
            if body <= 0 or span <= 0 or body < 0.5 * span:
                break
            if (b[m][4] - o) * d >= 1.5 * a:
                end = m
                break
        if end is None:
            continue
        base = [k - 1]
        for j in (k - 2, k - 3):
            if abs(b[j][4] - b[j][1]) > 0.5 * a:
                break
            base.append(j)
        last = b[k - 1]
        lo, hi = (min(b[j][3] for j in base), max(last[1], last[4])) if d > 0 else (min(last[1], last[4]), max(b[j][2] for j in base))
        if hi - lo > a or hi <= lo:
            continue
        known, kind = b[end][0] + HOUR, "demand" if d > 0 else "supply"
        if any(z[0] == kind and z[3] <= known and (z[4] is None or known < z[4]) and min(z[2], hi) - max(z[1], lo) > 0.5 * (hi - lo) for z in out):
            continue
        until = next((x[0] + HOUR for x in b if x[0] >= known and (x[4] < lo if d > 0 else x[4] > hi)), None)
        out.append((kind, lo, hi, known, until))
    return out


def found_zones(spark, rows):
    b = spark.createDataFrame(rows, BARS)
    return zones.zones(b, market.atr(b).withColumn("atr", F.round("atr", 9)), 3600)


def plain_set(rows):
    return sorted(((s, *z) for s, b in by_symbol(rows).items() for z in plain_zones(b)), key=lambda z: (z[:5], z[5] or datetime.max))


def test_zones_equal_a_plain_walk_over_several_blocks(spark, rows, small_blocks):
    got = sorted(as_set_rows(found_zones(spark, rows)), key=lambda z: (z[:5], z[5] or datetime.max))
    assert got == plain_set(rows) and len(got) > 30


def as_set_rows(df):
    return [(r["symbol"], r["kind"], r["bottom"], r["top"], r["known_ts"], r["until_ts"]) for r in df.collect()]


def test_returns_of_zones(spark, rows):
    found = found_zones(spark, rows)
    b = by_symbol(rows)
    for r in zones.returns(found, spark.createDataFrame(rows, BARS), 3600).collect():
        visits, outside = [], True
        for t, _, h, lo, c in b[r["symbol"]]:
            if t < r["known_ts"]:
                continue
            if c > r["top"] if r["side"] == "sell" else c < r["bottom"]:
                break
            inside = h >= r["bottom"] if r["side"] == "sell" else lo <= r["top"]
            if inside and outside:
                visits.append(t)
            outside = not inside
        assert [r["first_return"], r["second_return"]] == (visits + [None, None])[:2]


def test_what_is_alive_at_a_clock_does_not_change_later(spark, rows):
    clocks = spark.createDataFrame([(f"{s}{h}", s, T0 + h * HOUR + timedelta(minutes=7)) for s in "AB" for h in (0, 60, 150, 300, 420)], "clock_id string, symbol string, clock_ts timestamp_ntz")
    whole = zones.alive_at(clocks, found_zones(spark, rows)).collect()
    seen = lambda at, who: sorted((r["clock_id"], r["kind"], r["bottom"], r["top"], r["known_ts"]) for r in who if r["clock_ts"] == at)
    for h in (60, 300):
        at = T0 + h * HOUR + timedelta(minutes=7)
        early = zones.alive_at(clocks, found_zones(spark, [r for r in rows if r[1] + HOUR <= at])).collect()
        assert seen(at, whole) == seen(at, early) and all(r[4] <= at for r in seen(at, whole))
    plain = {(c["clock_id"], *z[1:5]) for c in clocks.collect() for z in plain_set(rows) if z[0] == c["symbol"] and z[4] <= c["clock_ts"] and (z[5] is None or c["clock_ts"] < z[5])}
    assert {(r["clock_id"], r["kind"], r["bottom"], r["top"], r["known_ts"]) for r in whole} == plain and plain


def test_equal_highs_and_lows_equal_a_plain_walk(spark, rows, small_blocks):
    b = spark.createDataFrame(rows, BARS)
    tol = b.select("symbol", "bar_ts", F.lit(0.15).alias("tolerance"))
    swings = market.swings(b).withColumn("known_ts", zones.after("known_ts", 3600))
    got = sorted((r["symbol"], r["kind"], r["price"], r["known_ts"], r["origin_ts"]) for r in zones.equal_levels(b, swings, tol, 3600).collect())
    want = []
    for s, x in by_symbol(rows).items():
        for kind, col, beats in (("eqh", 2, lambda p, q: p > q), ("eql", 3, lambda p, q: p < q)):
            marks = [i for i in range(2, len(x) - 2) if all(beats(x[i][col], x[j][col]) for j in (i - 2, i - 1)) and not any(beats(x[j][col], x[i][col]) for j in (i + 1, i + 2))]
            made = []
            for n, i in enumerate(marks):
                known = x[i + 2][0] + HOUR
                for a in reversed(marks[:n]):
                    if x[i][0] - x[a][0] > timedelta(days=2):
                        break
                    if abs(x[a][col] - x[i][col]) > 0.15:
                        continue
                    level = (max if kind == "eqh" else min)(x[a][col], x[i][col])
                    if any(beats(x[j][col], level) for j in range(a + 1, i)):
                        continue
                    if not any(abs(p - level) <= 0.15 and k >= known - timedelta(days=1) for p, k in made):
                        made.append((level, known))
                        want.append((s, kind, level, known, x[a][0]))
                    break
    assert got == sorted(want) and len(got) > 10


def test_order_blocks_look_back_over_blocks(spark, rows, small_blocks):
    b = spark.createDataFrame(rows, BARS)
    breaks = market.structure(b)
    got = {(r["symbol"], r["side"], r["known_ts"]): (r["bottom"], r["top"], r["origin_ts"]) for r in zones.order_blocks(b, breaks, 3600).collect()}
    plain = by_symbol(rows)
    for r in breaks.collect():
        x = plain[r["symbol"]]
        j = [t[0] for t in x].index(r["bar_ts"])
        d = 1 if r["side"] == "buy" else -1
        k = next((k for k in range(j - 1, max(j - 30, -1), -1) if (x[k][4] - x[k][1]) * d < 0), None)
        assert got.get((r["symbol"], r["side"], r["bar_ts"] + HOUR)) == (None if k is None else (x[k][3], x[k][2], x[k][0]))


def test_stabbing_equals_all_pairs(spark):
    rng = random.Random(3)
    at = lambda m: T0 + timedelta(minutes=m)
    points = [(i, rng.choice("xy"), at(rng.randint(-4000, 90_000))) for i in range(60)] + [(99, "x", None)]
    held = [(i, rng.choice("xy"), at(a), None if i % 7 == 0 else at(a + rng.choice([0, 1, 59, 60, 61, 5000, 80_000]))) for i, a in enumerate(rng.randint(-9000, 80_000) for _ in range(80))]
    p = spark.createDataFrame(points, "p int, k string, at timestamp_ntz")
    q = spark.createDataFrame(held, "q int, k string, a timestamp_ntz, z timestamp_ntz")
    got = sorted((r["p"], r["q"]) for r in intervals.stabbed(p, q, ["k"], "at", "a", "z").collect())
    assert got == sorted((i, j) for i, k, t in points if t for j, g, a, z in held if g == k and a <= t and (z is None or t < z))
    assert intervals.stabbed(p.limit(0), q, ["k"], "at", "a", "z").count() == 0 and intervals.stabbed(p, q.limit(0), ["k"], "at", "a", "z").count() == 0
    with pytest.raises(ValueError):
        intervals.stabbed(p.withColumn("a", F.lit(1)), q, ["k"], "at", "a", "z")


def test_first_come_equals_a_fold(spark):
    rng = random.Random(5)
    against = {i: {j for j in range(i) if rng.random() < 0.04} for i in range(120)}
    kept = []
    for i in range(120):
        if not against[i] & set(kept):
            kept.append(i)
    c = spark.createDataFrame([(i, i) for i in range(120)], "id long, place long")
    r = spark.createDataFrame([(i, j) for i, js in against.items() for j in js], "id long, rival long")
    assert sorted(x["id"] for x in intervals.first_come(c, r).collect()) == kept
    assert intervals.first_come(c, r.limit(0)).count() == 120


def test_recursions_over_blocks_equal_loops(spark, rows):
    b = spark.createDataFrame(rows, BARS)
    for n, weight, warm in ((20, 2 / 21, "null"), (14, 1 / 14, "mean"), (1, 1.0, "null"), (3, 0.5, "mean")):
        got = {(r["symbol"], r["bar_ts"]): r["v"] for r in blocks.recursive_mean(b, ["symbol"], "bar_ts", "close", n, weight, "v", warm, size=37).collect()}
        for s, x in by_symbol(rows).items():
            v = 0.0
            for i, (t, *_, c) in enumerate(x, 1):
                v = v + (c - v) / i if i <= n else v + weight * (c - v)
                assert got[s, t] == (None if i < n and warm == "null" else pytest.approx(v, abs=1e-9))
    with pytest.raises(ValueError):
        blocks.recursive_mean(b, ["symbol"], "bar_ts", "close", 50, 0.1, "v", "null", size=37)


def test_places_and_guests(spark, rows):
    b = spark.createDataFrame(rows, BARS)
    placed = blocks.numbered(b, ["symbol"], "bar_ts", bucket_seconds=7200)
    got = {(r["symbol"], r["bar_ts"]): r["pos"] for r in placed.collect()}
    assert got == {(s, t[0]): i for s, x in by_symbol(rows).items() for i, t in enumerate(x)}
    spread = blocks.dealt(placed, 3, 2, 50).groupBy("symbol", "block").agg(F.collect_list("pos").alias("p")).collect()
    for r in spread:
        n = sum(1 for s, _ in got if s == r["symbol"])
        k = r["block"] * 50
        assert sorted(r["p"]) == list(range(max(0, k - 3), min(n, k + 52))) if k < n else sorted(r["p"]) == list(range(k - 3, n))


def test_baseline_of_hours_looks_back_over_blocks(spark):
    """Moments off the grid, a weekly series beside a rare one, and a year's bound between a release and its weeks."""
    rng = random.Random(4)
    start = datetime(2022, 11, 7)  # the years' blocks end on the 8th of December 2022
    bars = [("X", start + i * HOUR, p, p, p, p * (1 + rng.gauss(0, 0.002))) for i, p in enumerate(100 + rng.gauss(0, 1) for _ in range(24 * 75)) if i % 24 != 3]
    events = [("w", start + timedelta(days=7 * k + 2, hours=13, minutes=30)) for k in range(9)] + [("r", start + timedelta(days=d, hours=9, minutes=5)) for d in (30, 44, 61, 61, 70)]
    pairs = [("X", "w"), ("X", "r")]
    rungs = {"-4h": -14_400, "+1h": 3600, "+1d": 86_400, "+1w": 604_800}
    b = spark.createDataFrame(bars, BARS)
    r = spark.createDataFrame(events, "indicator string, ts timestamp_ntz")
    p = spark.createDataFrame(pairs, "symbol string, indicator string")
    windows = study.event_windows(b, r, p, rungs, 3600)
    rule = baseline.BaselineRule(weeks=4, lookback=7, least=2)
    got = baseline.matched_baseline(b, r, p, windows, rule).where("usable").collect()
    starts = [x[1] for x in bars]

    def price(t, col):
        i = max((i for i, s in enumerate(starts) if s <= t), default=None)
        return None if i is None else bars[i][col]

    def ret(t, h):
        import math

        a, z = price(t, 2), price(t + timedelta(seconds=h), 5 if h >= 0 else 2)
        return None if a is None or z is None else math.log(z / a) if h >= 0 else math.log(a / z)

    def others(times, t, h, skip=None):
        lo, hi = min(t, t + timedelta(seconds=h)), max(t, t + timedelta(seconds=h))
        return sum(1 for x in times if (lo <= x <= hi if h >= 0 else lo <= x < hi) and x != skip)

    assert len(got) > 30
    for row in got:
        t, h, times = row["ts"], row["seconds"], [x for i, x in events if i == row["indicator"]]
        allowed, taken = others(times, t, h, t), []
        for week in range(1, 8):
            for shift in (0, -1, 1, -2, 2):
                m = t + timedelta(days=shift - 7 * week)
                if len(taken) == 4 or shift and m.weekday() >= 5 or max(m, m + timedelta(seconds=h)) >= t or others(times, m, h) > allowed or ret(m, h) is None:
                    continue
                taken.append(ret(m, h))
                break
        assert row["baseline_n"] == len(taken)
        mean = sum(taken) / len(taken) if len(taken) >= 2 else None
        assert (row["baseline_mean"] is None) if mean is None else row["baseline_mean"] == pytest.approx(mean, abs=1e-12)


def test_baseline_and_windows_by_parts_equal_those_of_whole_blocks(spark, monkeypatch):
    start = datetime(2023, 1, 2)
    b = spark.range(24 * 150).selectExpr(
        "'X' as symbol", f"timestamp_ntz '{start}' + make_dt_interval(0, id) as bar_ts", "100D + (id * 7919 % 101) / 50 as open", "103D as high", "99D as low", "100D + (id * 104729 % 97) / 50 as close"
    )
    r = spark.range(90).selectExpr("concat('i', id % 2) as indicator", f"timestamp_ntz '{start}' + make_dt_interval(100 + id div 2, id % 24, 7 * id % 60) as ts")
    pairs = spark.createDataFrame([("i0", "X"), ("i1", "X")], "indicator string, symbol string")
    asked = r.join(pairs, "indicator").select("indicator", "symbol", "ts")
    windows = asked.selectExpr("*", "explode(array(3600, -7200, 86400)) as seconds", "true as usable")

    def both():
        found = baseline.matched_baseline(b, r, pairs, windows), baseline.measured(b, asked, {"h": 3600, "-d": -86400})
        return [sorted(map(str, df.collect())) for df in found]

    whole = both()
    sizes = lambda: [n["n"] for n in baseline._dealt(b, baseline._moments(asked, 2, F.lit(None)), 0, 0, ["open"], baseline.MOMENTS).where("kind = 2").groupBy("symbol", "block", "part").agg(F.count("*").alias("n")).collect()]
    assert max(sizes()) > 40
    monkeypatch.setattr(baseline, "MOMENTS", 8)
    assert both() == whole and max(sizes()) < 30
