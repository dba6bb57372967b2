"""The routine from a level to a trade: which side a day allows, where price touched an area, where the push failed, how much
room there is, and the setups that come of it.

Everything is known at the time it carries: a touch at its minute's close or the sweep's quarter-hour, a setup at the close that
failed. Bars after that change nothing in it.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import clock
from tidemill.operators import blocks, intervals, market
from tidemill.operators.shared import settled

MINUTE, HOUR, DAY = 60, 3600, 86_400
#: A touch waits so long for the failure; the small swing may lie so long before the push (fixed values).
WATCH, SMALL_BACK = HOUR, 30 * MINUTE
#: The push of a sweep and the hour after it, in minutes, with the half hour before.
_BACK = 110


@dataclass(frozen=True)
class Routine:
    pip: float
    target: float = 10.0
    most_stop: float = 10.0
    buffer: float = 1.5
    ema_days: int = 20
    range_days: int = 20


def side_decisions(days: DataFrame, rule: Routine) -> DataFrame:
    """sells, buys and rule of each market day, from the days before it and its open.

    days: symbol, bar_ts (the day's start), open, high, low, close. Below a falling mean of closes sells alone, above a rising one
    buys alone. If the mean is flat (it moved less than a fifth of a day's range in five days), too young, or on the
    other side, the half of the range decides in which the day opened; with fewer than five days before both are allowed.
    """
    mean = market.ema(days, rule.ema_days).withColumnRenamed("ema", "mean")
    both = days.join(mean, ["symbol", "bar_ts"]).join(market.atr(days), ["symbol", "bar_ts"])
    w = blocks.within(["symbol"])
    past = w.rowsBetween(-rule.range_days, -1)
    made = {
        "mean_1": F.lag("mean").over(w), "mean_6": F.lag("mean", 6).over(w), "atr_1": F.lag("atr").over(w), "top": F.max("high").over(past),
        "bottom": F.min("low").over(past), "days_before": F.count("*").over(past),
    }
    rows = blocks.framed(both, ["symbol"], "bar_ts", max(rule.range_days, 6), 0, made)
    slope = F.col("mean_1") - F.col("mean_6")
    trends = F.coalesce((F.col("pos") >= rule.ema_days + 5) & (F.abs(slope) >= 0.2 * F.col("atr_1")), F.lit(False))
    falls, rises = trends & (slope < 0) & (F.col("open") < F.col("mean_1")), trends & (slope > 0) & (F.col("open") > F.col("mean_1"))
    middle = (F.col("top") + F.col("bottom")) / 2
    young = F.col("days_before") < 5
    side = F.when(falls, "sell").when(rises, "buy").when(young, None).when(F.col("open") > middle, "sell").otherwise("buy")
    name = F.when(falls | rises, "ema").when(young, "none").otherwise("range")
    rows = rows.withColumns({"side": side, "rule": name})
    return rows.select("symbol", F.col("bar_ts").alias("day"), (F.coalesce("side", F.lit("sell")) == "sell").alias("sells"), (F.coalesce("side", F.lit("buy")) == "buy").alias("buys"), "rule")


def room(price: Column, side: Column, poc: Column, high_edge: Column, low_edge: Column, pip: float) -> Column:
    """Pips that price can travel before the busy middle of a volume profile; infinite where it has left it, null without one."""
    sell = F.when(price > high_edge, price - high_edge).when(price > poc, price - poc).when(price >= low_edge, 0.0).otherwise(float("inf"))
    buy = F.when(price < low_edge, low_edge - price).when(price < poc, poc - price).when(price <= high_edge, 0.0).otherwise(float("inf"))
    return F.when(poc.isNull(), None).otherwise(F.when(side == "sell", sell).otherwise(buy) / pip)


def minute_table(bars: DataFrame) -> DataFrame:
    """Minute bars with pos, the bar before, the last small swings, and the side in which the bar is wide."""
    w = blocks.within(["symbol"])
    before, after = w.rowsBetween(-2, -1), w.rowsBetween(1, 2)
    whole = (F.count("high").over(before) == 2) & (F.count("high").over(after) == 2)
    body, span = F.col("close") - F.col("open"), F.col("high") - F.col("low")
    wide = (span > 0) & (F.abs(body) >= 1.2 * F.avg(F.abs(body)).over(w.rowsBetween(-20, -1)))
    made = {
        "prev_high": F.lag("high").over(w), "prev_low": F.lag("low").over(w),
        "is_high": whole & (F.col("high") > F.max("high").over(before)) & (F.col("high") >= F.max("high").over(after)),
        "is_low": whole & (F.col("low") < F.min("low").over(before)) & (F.col("low") <= F.min("low").over(after)),
        "wide_side": F.when(wide & (body > 0) & (F.col("high") - F.col("close") <= 0.4 * span), "buy").when(wide & (body < 0) & (F.col("close") - F.col("low") <= 0.4 * span), "sell"),
    }
    marked = blocks.framed(bars, ["symbol"], "bar_ts", 20, 2, made).drop("pos")
    lately = w.rowsBetween(-_BACK, 0)
    swing = lambda flag, price: F.last(F.when(F.col(flag), F.struct("pos", "bar_ts", F.col(price).alias("price"))), ignorenulls=True).over(lately)
    return blocks.framed(marked, ["symbol"], "bar_ts", _BACK, 0, {"small_high": swing("is_high", "high"), "small_low": swing("is_low", "low")}).drop("is_high", "is_low")


def entries(areas: DataFrame, minutes: DataFrame) -> DataFrame:
    """A touch for each minute bar that comes into a living area from outside: symbol, side, area_id, kind, bottom, top, start_ts, touch_ts.

    areas: area_id, symbol, kind, side, bottom, top, known_ts, until_ts, and last_ts, from which touches do not count any more
    (null: never). Hours are met with the areas alive in them first, and only hours whose bars cross an edge are looked at.
    """
    hour = F.floor(clock.epoch(F.col("bar_ts")) / HOUR)
    hours = minutes.groupBy("symbol", hour.alias("hour")).agg(
        F.max("high").alias("h_high"), F.min("low").alias("h_low"), F.min(F.coalesce("prev_high", F.lit(float("-inf")))).alias("h_prev_high"), F.max(F.coalesce("prev_low", F.lit(float("inf")))).alias("h_prev_low")
    ).withColumn("hour_ts", clock.at_seconds(F.col("hour") * HOUR))
    until = F.when(F.col("last_ts").isNull() | (F.col("until_ts") < F.col("last_ts")), F.col("until_ts")).otherwise(F.col("last_ts"))
    held = areas.select("area_id", "symbol", "kind", "side", "bottom", "top", "known_ts", until.alias("end_ts")).withColumn("near_ts", F.timestamp_add("SECOND", F.lit(-HOUR), F.col("known_ts")))
    met = intervals.stabbed(hours, held, ["symbol"], "hour_ts", "near_ts", "end_ts")
    sell = F.col("side") == "sell"
    met = met.where(F.when(sell, (F.col("h_high") >= F.col("bottom")) & (F.col("h_prev_high") < F.col("bottom"))).otherwise((F.col("h_low") <= F.col("top")) & (F.col("h_prev_low") > F.col("top"))))
    near = met.select("symbol", "hour", "area_id", "kind", "side", "bottom", "top", "known_ts", "end_ts")
    bars = minutes.select("symbol", hour.alias("hour"), "bar_ts", "high", "low", "prev_high", "prev_low")
    both = near.join(bars, ["symbol", "hour"]).where((F.col("bar_ts") >= F.col("known_ts")) & (F.col("end_ts").isNull() | (F.col("bar_ts") < F.col("end_ts"))))
    up = (F.col("high") >= F.col("bottom")) & (F.coalesce("prev_high", F.lit(float("-inf"))) < F.col("bottom"))
    down = (F.col("low") <= F.col("top")) & (F.coalesce("prev_low", F.lit(float("inf"))) > F.col("top"))
    both = both.where(F.when(sell, up).otherwise(down))
    return both.select("symbol", "side", "area_id", "kind", "bottom", "top", F.col("bar_ts").alias("start_ts"), F.timestamp_add("SECOND", F.lit(MINUTE), F.col("bar_ts")).alias("touch_ts"))


def failures(touches: DataFrame, minutes: DataFrame) -> DataFrame:
    """touches with the first minute close beyond the last small swing before the push's extreme, within the hour (fail_ts, close, spread,
    extreme, small_price, wide, absorbed, all null where there is none).

    The push runs from start_ts; a small swing counts once the two bars after it have closed, if it lies at most half an hour
    before the push. wide: whether a wide bar of the last 16 closed beyond the swing; absorbed: busy bars in the push.
    """
    hour = lambda c, more=0: F.floor((clock.epoch(F.col(c)) + more) / HOUR)
    keyed = touches.withColumn("touch_id", F.concat_ws("|", "area_id", clock.epoch(F.col("touch_ts")).cast("string")))
    spread = keyed.withColumn("hour", F.explode(F.sequence(hour("start_ts"), hour("touch_ts", WATCH))))
    bars = minutes.select("symbol", hour("bar_ts").alias("hour"), "bar_ts", "pos", "high", "low", "close", F.col("spread_last").alias("spread"), "wide_side", "absorbed")
    key = ["touch_id", "symbol", "side", "start_ts", "touch_ts"]
    met = spread.select(*key, "hour").join(bars, ["symbol", "hour"]).drop("hour")
    met = met.where((F.col("bar_ts") >= F.col("start_ts")) & (clock.epoch(F.col("bar_ts")) < clock.epoch(F.col("touch_ts")) + WATCH))
    sell = F.col("side") == "sell"
    so_far = Window.partitionBy("touch_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    high, low = F.max(F.struct("high", (-F.col("pos")).alias("pos"))).over(so_far), F.min(F.struct("low", "pos")).over(so_far)
    recent = F.collect_list(F.when(F.col("wide_side") == F.col("side"), F.col("close"))).over(so_far.rowsBetween(-15, 0))
    met = met.withColumns({"top_": high, "bottom_": low, "wides": recent, "absorbed_bars": F.count_if("absorbed").over(so_far)})
    met = met.where(clock.epoch(F.col("bar_ts")) + MINUTE >= clock.epoch(F.col("touch_ts")))
    extreme_pos = F.when(sell, -F.col("top_.pos")).otherwise(F.col("bottom_.pos"))
    met = met.withColumn("look", F.least(extreme_pos - 1, F.col("pos") - 3)).withColumn("extreme", F.when(sell, F.col("top_.high")).otherwise(F.col("bottom_.low")))
    past = minutes.select("symbol", F.col("pos").alias("look"), "small_low", "small_high")
    met = met.join(past, ["symbol", "look"]).withColumn("small", F.when(sell, F.col("small_low")).otherwise(F.col("small_high")))
    fresh = clock.epoch(F.col("small.bar_ts")) >= clock.epoch(F.col("start_ts")) - SMALL_BACK
    beyond = lambda c: F.when(sell, c < F.col("small.price")).otherwise(c > F.col("small.price"))
    met = met.where(F.coalesce(fresh & beyond(F.col("close")), F.lit(False)))
    hit = F.struct(
        "pos", F.col("bar_ts").alias("fail_ts"), "close", "spread", "extreme", F.col("small.price").alias("small_price"),
        F.exists("wides", lambda c: beyond(c)).alias("wide"), F.col("absorbed_bars").alias("absorbed"),
    )
    first = met.groupBy("touch_id").agg(F.min_by(hit, "pos").alias("f"))
    return keyed.join(first.select("touch_id", "f.fail_ts", "f.close", "f.spread", "f.extreme", "f.small_price", "f.wide", "f.absorbed"), "touch_id", "left")


def one_each(failed: DataFrame) -> DataFrame:
    """The touches that make a setup, with the areas of all that failed at the same close.

    In order of time: an area makes one setup an hour, and several touches that fail at one close are one setup, of the first of
    them. Touches of a symbol that lie three hours apart cannot meet, so each stretch between such gaps is decided by itself.
    """
    order = Window.partitionBy("symbol").orderBy("touch_ts")
    gap = clock.epoch(F.col("touch_ts")) - clock.epoch(F.lag("touch_ts").over(order)) > 3 * HOUR
    moments = failed.select("symbol", "touch_ts").distinct().withColumn("new", F.coalesce(gap, F.lit(True)).cast("int"))
    moments = moments.withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    rows = failed.where("fail_ts is not null").join(moments, ["symbol", "touch_ts"]).select("symbol", "stretch", "touch_id", "area_id", "side", "touch_ts", "fail_ts")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        made: dict[tuple[str, object], list] = {}
        last: dict[str, pd.Timestamp] = {}
        for r in group.sort_values(["touch_ts", "side", "area_id"]).itertuples():
            if r.area_id in last and r.touch_ts < last[r.area_id] + pd.Timedelta(seconds=WATCH):
                continue
            key = (r.side, r.fail_ts)
            if key in made:
                if r.area_id not in made[key][1]:
                    made[key][1].append(r.area_id)
                continue
            made[key] = [r.touch_id, [r.area_id]]
            last[r.area_id] = r.fail_ts + pd.Timedelta(seconds=MINUTE)
        return pd.DataFrame(list(made.values()), columns=["touch_id", "areas"])

    chosen = rows.groupBy("symbol", "stretch").applyInPandas(choose, "touch_id string, areas array<string>")
    return failed.join(chosen, "touch_id")


def setups(touches: DataFrame, minutes: DataFrame, sides: DataFrame, rule: Routine) -> DataFrame:
    """Setups with entry, stop, target and the checks side_ok, room_ok, wide_ok and stop_ok (absorbed counts, but is not asked for).

    The entry is a limit at the area's near edge, or the market where price is past it; the stop lies beyond the push and the area.
    Room is measured in the profile of the session before and this one up to the setup.
    """
    sell = F.col("side") == "sell"
    found = settled(one_each(settled(failures(touches, minutes))))
    ask = F.col("close") + F.col("spread")
    edge = F.when(sell, F.col("bottom")).otherwise(F.col("top"))
    at_market = F.when(sell, edge <= F.col("close")).otherwise(edge >= ask)
    found = found.withColumn("market", at_market).withColumn("entry", F.when(~F.col("market"), edge).when(sell, F.col("close")).otherwise(ask))
    beyond = F.when(sell, F.greatest("extreme", "top") + rule.buffer * rule.pip).otherwise(F.least("extreme", "bottom") - rule.buffer * rule.pip)
    found = found.withColumn("stop", beyond).withColumn("target", F.col("entry") + F.when(sell, -1).otherwise(1) * rule.target * rule.pip)
    found = found.withColumn("setup_ts", F.timestamp_add("SECOND", F.lit(MINUTE), F.col("fail_ts"))).withColumn("day", clock.fx_day_start(F.col("setup_ts")))
    found = found.join(sides, ["symbol", "day"], "left").withColumn("side_ok", F.when(sell, F.coalesce("sells", F.lit(True))).otherwise(F.coalesce("buys", F.lit(True))))
    current = clock.session_start(F.col("setup_ts"))
    before = clock.session_start(F.timestamp_add("SECOND", F.lit(-1), current))
    spans = found.select("touch_id", "symbol", "setup_ts", before.alias("from_ts"))
    hour = lambda c: F.floor(clock.epoch(c) / HOUR)
    spans = spans.withColumn("hour", F.explode(F.sequence(hour(F.col("from_ts")), hour(F.col("setup_ts")))))
    bars = minutes.select("symbol", hour(F.col("bar_ts")).alias("hour"), "bar_ts", "high", "low", "tick_count")
    inside = spans.join(bars, ["symbol", "hour"]).where((F.col("bar_ts") >= F.col("from_ts")) & (clock.epoch(F.col("bar_ts")) + MINUTE <= clock.epoch(F.col("setup_ts"))))
    profile = market.value_area(inside, F.col("touch_id"), rule.pip).withColumnRenamed("period", "touch_id")
    found = found.join(profile, ["symbol", "touch_id"], "left")
    pips = room(F.col("entry"), F.col("side"), F.col("poc"), F.col("high_edge"), F.col("low_edge"), rule.pip)
    risk = F.abs(F.col("stop") - F.col("entry")) / rule.pip
    found = found.withColumns({"room_pips": pips, "risk_pips": risk, "room_ok": F.coalesce(pips >= rule.target, F.lit(False)), "stop_ok": risk <= rule.most_stop + 1e-9})
    return found.select(
        "symbol", "side", "setup_ts", F.col("start_ts").alias("push_ts"), F.sort_array("areas").alias("areas"), "market", "entry", "stop", "target", "small_price", "risk_pips", "room_pips",
        "absorbed", "side_ok", "room_ok", F.col("wide").alias("wide_ok"), "stop_ok", (F.col("side_ok") & F.col("room_ok") & F.col("wide") & F.col("stop_ok")).alias("ok"),
    )
