"""Touches, failures and setups against a plain walk over minutes."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.operators import setups

T0, M = datetime(2024, 3, 5), timedelta(minutes=1)
RULE = setups.Routine(pip=0.01)
BARS = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, tick_count long, spread_last double, absorbed boolean"


def minutes(symbol, n, seed):
    rng, out, p = random.Random(seed), [], 100.0
    for i in range(n):
        if rng.random() < 0.03:
            continue
        o, p = p, round(p + rng.gauss(0, 0.02) + 0.01 * ((100 - p) > 0) - 0.01 * ((100 - p) < 0), 2)
        out.append((symbol, T0 + i * M, o, round(max(o, p) + abs(rng.gauss(0, 0.01)), 2), round(min(o, p) - abs(rng.gauss(0, 0.01)), 2), p, rng.randint(1, 9), 0.02, rng.random() < 0.1))
    return out


@pytest.fixture(scope="module")
def bars():
    return minutes("A", 2200, 1) + minutes("B", 1500, 2)


@pytest.fixture(scope="module")
def areas():
    rng, out = random.Random(7), []
    for i in range(30):
        side, known = rng.choice(["sell", "buy"]), T0 + rng.randint(-3, 20) * timedelta(hours=1)
        mid = 100 + (1 if side == "sell" else -1) * rng.choice([0.02, 0.05, 0.08])
        until = None if i % 3 else known + rng.randint(1, 9) * timedelta(hours=1)
        last = None if i % 4 else known + rng.randint(1, 9) * timedelta(hours=1)
        out.append((f"z{i:02d}", rng.choice("AB"), "supply" if side == "sell" else "demand", side, round(mid - 0.02, 2), round(mid + 0.02, 2), known, until, last))
    return out


AREAS = "area_id string, symbol string, kind string, side string, bottom double, top double, known_ts timestamp_ntz, until_ts timestamp_ntz, last_ts timestamp_ntz"


def plain_touches(bars, areas):
    out = []
    for i, s, _, side, lo, hi, known, until, last in areas:
        x = [b for b in bars if b[0] == s]
        for j, b in enumerate(x):
            if b[1] < known or until and b[1] >= until or last and b[1] >= last:
                continue
            before = x[j - 1] if j else None
            if side == "sell" and b[3] >= lo and (before is None or before[3] < lo) or side == "buy" and b[4] <= hi and (before is None or before[4] > hi):
                out.append((i, s, side, lo, hi, b[1], b[1] + M))
    return out


def plain_swings(x, col, beats):
    return [i for i in range(2, len(x) - 2) if all(beats(x[i][col], x[j][col]) for j in (i - 2, i - 1)) and not any(beats(x[j][col], x[i][col]) for j in (i + 1, i + 2))]


def plain_failure(x, pool, touch):
    _, _, side, _, _, start, at = touch
    sell = side == "sell"
    j0 = next(j for j, b in enumerate(x) if b[1] >= start)
    for j, b in enumerate(x):
        if b[1] + M < at or b[1] >= at + timedelta(hours=1) or j < j0:
            continue
        ext = max(range(j0, j + 1), key=lambda k: (x[k][3], -k)) if sell else min(range(j0, j + 1), key=lambda k: (x[k][4], k))
        small = next((k for k in reversed(pool) if k < ext and x[k + 2][1] + M <= b[1]), None)
        if small is None or x[small][1] < start - timedelta(minutes=30):
            continue
        price = x[small][4 if sell else 3]
        if b[5] < price if sell else b[5] > price:
            wide = False
            for k in range(max(j0, j - 15), j + 1):
                if not k:
                    continue
                past = [abs(y[5] - y[2]) for y in x[max(0, k - 20) : k]]
                body, span = x[k][5] - x[k][2], x[k][3] - x[k][4]
                if span <= 0 or abs(body) < 1.2 * (sum(past) / len(past)):
                    continue
                near = body < 0 and x[k][5] - x[k][4] <= 0.4 * span if sell else body > 0 and x[k][3] - x[k][5] <= 0.4 * span
                wide |= near and (x[k][5] < price if sell else x[k][5] > price)
            extreme = max(y[3] for y in x[j0 : j + 1]) if sell else min(y[4] for y in x[j0 : j + 1])
            return b[1], b[5], extreme, price, wide, sum(y[8] for y in x[j0 : j + 1])
    return None


def test_setups_equal_a_plain_walk(spark, bars, areas):
    table = setups.minute_table(spark.createDataFrame(bars, BARS)).cache()
    touches = setups.entries(spark.createDataFrame(areas, AREAS), table)
    want = plain_touches(bars, areas)
    got = sorted((r["area_id"], r["symbol"], r["side"], r["bottom"], r["top"], r["start_ts"], r["touch_ts"]) for r in touches.collect())
    assert got == sorted(want) and len(got) > 60

    by = {s: [b for b in bars if b[0] == s] for s in "AB"}
    pools = {(s, side): plain_swings(by[s], 4 if side == "sell" else 3, (lambda p, q: p < q) if side == "sell" else (lambda p, q: p > q)) for s in "AB" for side in ("sell", "buy")}
    failed = {(t[0], t[6]): plain_failure(by[t[1]], pools[t[1], t[2]], t) for t in want}
    found = setups.failures(touches, table).collect()
    assert len(found) == len(want) and sum(f is not None for f in failed.values()) > 20
    for r in found:
        f = failed[r["area_id"], r["touch_ts"]]
        assert (r["fail_ts"], r["close"], r["extreme"], r["small_price"], r["wide"], r["absorbed"]) == (f or (None,) * 6)

    made, last = {}, {}
    for i, s, side, lo, hi, start, at in sorted(want, key=lambda t: (t[6], t[2], t[0])):
        f = failed[i, at]
        if f is None or i in last and at < last[i] + timedelta(hours=1):
            continue
        if (s, side, f[0]) in made:
            made[s, side, f[0]][0].add(i)
            continue
        sell = side == "sell"
        edge, ask = (lo, None) if sell else (hi, f[1] + 0.02)
        market = edge <= f[1] if sell else edge >= ask
        entry = (f[1] if sell else ask) if market else edge
        stop = max(f[2], hi) + 0.015 if sell else min(f[2], lo) - 0.015
        made[s, side, f[0]] = [{i}, start, market, entry, stop]
        last[i] = f[0] + M
    sides = spark.createDataFrame([("A", datetime(2024, 3, 4, 22), True, False, "ema")], "symbol string, day timestamp_ntz, sells boolean, buys boolean, rule string")
    rows = setups.setups(touches, table, sides, RULE).collect()
    assert len(rows) == len(made) > 5
    for r in rows:
        areas_, start, market, entry, stop = made[r["symbol"], r["side"], r["setup_ts"] - M]
        assert (set(r["areas"]), r["push_ts"], r["market"]) == (areas_, start, market)
        assert (r["entry"], r["stop"], r["target"]) == (pytest.approx(entry), pytest.approx(stop), pytest.approx(entry + (-0.1 if r["side"] == "sell" else 0.1)))
        assert r["stop_ok"] == (abs(stop - entry) / 0.01 <= 10 + 1e-9) and r["ok"] == (r["side_ok"] and r["room_ok"] and r["wide_ok"] and r["stop_ok"])
        barred = r["symbol"] == "A" and datetime(2024, 3, 4, 22) <= r["setup_ts"] < datetime(2024, 3, 5, 22) and r["side"] == "buy"
        assert r["side_ok"] == (not barred)

    # later bars change nothing in what was known before
    cut = T0 + timedelta(hours=12)
    early = setups.minute_table(spark.createDataFrame([b for b in bars if b[1] + M <= cut], BARS))
    known = setups.setups(setups.entries(spark.createDataFrame(areas, AREAS), early), early, sides, RULE).collect()
    assert {tuple(r.asDict().items()).__repr__() for r in known} == {tuple(r.asDict().items()).__repr__() for r in rows if r["setup_ts"] <= cut} and known


def test_room_before_the_busy_middle(spark):
    p = spark.createDataFrame([(x, s) for x in (90.0, 99.0, 101.0, 103.0, 120.0) for s in ("sell", "buy")], "price double, side string")
    room = setups.room(F.col("price"), F.col("side"), F.lit(100.0), F.lit(102.0), F.lit(98.0), 0.5)
    got = {(r["price"], r["side"]): r["room"] for r in p.select("price", "side", room.alias("room")).collect()}
    inf = float("inf")
    assert got == {(90.0, "sell"): inf, (90.0, "buy"): 16.0, (99.0, "sell"): 0.0, (99.0, "buy"): 2.0, (101.0, "sell"): 2.0, (101.0, "buy"): 0.0,
                   (103.0, "sell"): 2.0, (103.0, "buy"): inf, (120.0, "sell"): 36.0, (120.0, "buy"): inf}
    none = setups.room(F.col("price"), F.col("side"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"), 0.5)
    assert p.where(none.isNotNull()).count() == 0
