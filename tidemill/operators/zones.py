"""Price areas of market structure: supply and demand zones, equal highs and lows, order blocks, touches, and what is
alive at a clock.

An area has area_id, symbol, kind, side (sell above, buy below), bottom, top, known_ts (nothing of it is used before), origin_ts
and until_ts (null as long as it lives).
"""

from __future__ import annotations

from math import floor, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import clock
from tidemill.operators import blocks, execution, intervals
from tidemill.operators.shared import settled

DAY = 86_400


def after(ts: str, seconds: int) -> Column:
    return F.timestamp_add("SECOND", F.lit(seconds), F.col(ts))


def zone_candidates(bars: DataFrame, ranges: DataFrame, seconds: int, least_move: float = 1.5) -> DataFrame:
    """Supply and demand zones before any is suppressed, with the place of their first strong bar.

    A strong move: one to three bars the same way, each with a body of at least half its range, that together move
    least_move average ranges (of the bar before). The zone is the bar before them, and up to two small ones before that:
    from the extreme wick to the body of the last of these, at most an average range tall.
    """
    w = blocks.within(["symbol"])
    shaped = bars.join(ranges, ["symbol", "bar_ts"])
    columns = ["open", "high", "low", "close", "bar_ts"]
    made = {f"{c}_{k}": F.lag(c, k).over(w) for c in columns for k in (1, 2, 3)} | {f"{c}{k}": F.lead(c, k).over(w) for c in columns for k in (1, 2)} | {"range": F.lag("atr").over(w)}
    rows = blocks.framed(shaped.select("symbol", *columns, "atr"), ["symbol"], "bar_ts", 3, 2, made).where("pos >= 3")
    d = F.signum(F.col("close") - F.col("open"))

    def strong(k: str) -> Column:
        body, span = (F.col(f"close{k}") - F.col(f"open{k}")) * d, F.col(f"high{k}") - F.col(f"low{k}")
        return F.coalesce((body > 0) & (span > 0) & (body >= 0.5 * span), F.lit(False))

    far = lambda k: F.coalesce((F.col(f"close{k}") - F.col("open")) * d >= least_move * F.col("range"), F.lit(False))
    s0, s1, s2 = strong(""), strong("1"), strong("2")
    move_end = F.when(s0 & far(""), F.col("bar_ts")).when(s0 & s1 & far("1"), F.col("bar_ts1")).when(s0 & s1 & s2 & far("2"), F.col("bar_ts2"))
    small = lambda k: F.abs(F.col(f"close_{k}") - F.col(f"open_{k}")) <= 0.5 * F.col("range")
    base = lambda c, pick: F.when(small(2) & small(3), pick(f"{c}_1", f"{c}_2", f"{c}_3")).when(small(2), pick(f"{c}_1", f"{c}_2")).otherwise(F.col(f"{c}_1"))
    buy = d > 0
    found = rows.withColumn("end_bar", move_end).where(F.col("end_bar").isNotNull() & (d != 0)).select(
        "symbol", F.col("pos").alias("place"), F.when(buy, "demand").otherwise("supply").alias("kind"), F.when(buy, "buy").otherwise("sell").alias("side"),
        F.when(buy, base("low", F.least)).otherwise(F.least("open_1", "close_1")).alias("bottom"),
        F.when(buy, F.greatest("open_1", "close_1")).otherwise(base("high", F.greatest)).alias("top"),
        after("end_bar", seconds).alias("known_ts"), base("bar_ts", F.least).alias("origin_ts"), "range",
    )
    tall = F.col("top") - F.col("bottom")
    found = found.where((tall <= F.col("range")) & (tall > 0)).drop("range")
    return found.withColumn("area_id", F.concat_ws("@", "symbol", "kind", F.col("place").cast("string")))


def first_bar(areas: DataFrame, bars: DataFrame, since: str, price: str, below: Column, above: Column, strict: bool) -> DataFrame:
    """area_id and bar_ts of the first bar from since on whose price falls to below or rises to above (null: either never)."""
    marks = bars.select("symbol", F.col("bar_ts").alias("ts"), clock.epoch(F.col("bar_ts")).alias("id"), F.col(price).alias("bid"), F.col(price).alias("ask"))
    asked = areas.where(F.col(since).isNotNull()).select(F.col("area_id").alias("id"), "symbol", F.col(since).alias("from_ts"), F.lit("bid").alias("of"), below.alias("below"), above.alias("above"))
    return execution.first_touch(asked, marks, strict).select(F.col("id").alias("area_id"), F.col("ts").alias("bar_ts"))


def broken(areas: DataFrame, bars: DataFrame, seconds: int) -> DataFrame:
    """areas with until_ts, the end of the first bar that closes beyond their far side."""
    sell = F.col("side") == "sell"
    ends = first_bar(areas, bars, "known_ts", "close", F.when(~sell, F.col("bottom")), F.when(sell, F.col("top")), True)
    return areas.join(ends.select("area_id", after("bar_ts", seconds).alias("until_ts")), "area_id", "left")


def zones(bars: DataFrame, ranges: DataFrame, seconds: int, overlap: float = 0.5) -> DataFrame:
    """Zones with their ends. In order of their first strong bar, one of which more than half is covered by a zone of its
    kind that is alive when it becomes known is none."""
    found = settled(broken(settled(zone_candidates(bars, ranges, seconds)), bars, seconds))
    # zones that overlap share a step of a price ladder as wide as the tallest zone of their symbol
    heights = found.groupBy("symbol", "kind").agg(F.max(F.col("top") - F.col("bottom")).alias("step"))
    laid = found.join(heights, ["symbol", "kind"])
    rung = F.explode(F.sequence(F.floor(F.col("bottom") / F.col("step")), F.floor(F.col("top") / F.col("step"))))
    laid = laid.withColumn("rung", rung)
    new = laid.select("symbol", "kind", "rung", F.col("area_id").alias("id"), F.col("place").alias("at"), F.col("bottom").alias("b"), F.col("top").alias("t"), F.col("known_ts").alias("moment"))
    old = laid.select("symbol", "kind", "rung", F.col("area_id").alias("rival"), "place", "bottom", "top", "known_ts", "until_ts")
    met = intervals.stabbed(new, old, ["symbol", "kind", "rung"], "moment", "known_ts", "until_ts")
    met = met.where((F.col("place") < F.col("at")) & (F.least("t", "top") - F.greatest("b", "bottom") > overlap * (F.col("t") - F.col("b"))))
    kept = intervals.first_come(found.withColumnRenamed("area_id", "id"), met).withColumnRenamed("id", "area_id")
    return kept.select("area_id", "symbol", "kind", "side", "bottom", "top", "known_ts", "origin_ts", "until_ts")


def returns(areas: DataFrame, bars: DataFrame, seconds: int) -> DataFrame:
    """areas with the bars of their first two returns (first_return, first_left: the bar that is outside again, second_return)."""
    sell = F.col("side") == "sell"
    none = F.lit(None).cast("double")

    def turn(rows: DataFrame, since: str, inward: bool, out: str) -> DataFrame:
        """The first bar from since on that comes in, or that stays out: highs decide for areas above, lows for those below."""
        marks = bars.select("symbol", F.col("bar_ts").alias("ts"), clock.epoch(F.col("bar_ts")).alias("id"), F.col("high").alias("bid"), F.col("low").alias("ask"))
        rises = F.lit(inward) == sell
        edge = F.when(sell, F.col("bottom")).otherwise(F.col("top"))
        asked = rows.where(F.col(since).isNotNull()).select(
            F.col("area_id").alias("id"), "symbol", F.col(since).alias("from_ts"), F.when(sell, "bid").otherwise("ask").alias("of"),
            F.when(~rises, edge).otherwise(none).alias("below"), F.when(rises, edge).otherwise(none).alias("above"),
        )
        hit = execution.first_touch(asked, marks, strict=not inward).select(F.col("id").alias("area_id"), F.col("ts").alias(out))
        met = settled(rows.join(hit, "area_id", "left"))
        # the bar that ends an area is no visit of it
        return met.withColumn(out, F.when(F.col("until_ts").isNull() | (after(out, seconds) < F.col("until_ts")), F.col(out)))

    bars, areas = settled(bars.select("symbol", "bar_ts", "high", "low")), settled(areas)
    one = turn(areas, "known_ts", True, "first_return")
    return turn(turn(one, "first_return", False, "first_left"), "first_left", True, "second_return")


def range_extremes(bars: DataFrame, levels: int) -> DataFrame:
    """symbol, level, pos, top and bottom: highest high and lowest low of the 2**level bars from pos on (a sparse table)."""
    w = blocks.within(["symbol"])
    made = {}
    for j in range(levels):
        ahead = w.rowsBetween(0, (1 << j) - 1)
        made[f"m{j}"] = F.struct(F.lit(j).alias("level"), F.max("high").over(ahead).alias("top"), F.min("low").over(ahead).alias("bottom"))
    rows = blocks.framed(bars.select("symbol", "bar_ts", "high", "low"), ["symbol"], "bar_ts", 0, 1 << (levels - 1), made)
    return rows.select("symbol", "pos", F.inline(F.array(*made)))


def equal_levels(bars: DataFrame, swings: DataFrame, tolerance: DataFrame, seconds: int, days: int = 2) -> DataFrame:
    """Equal highs and lows as levels, alive for some days from when the later swing is known.

    swings: symbol, bar_ts, known_ts, kind (high, low), price; tolerance: symbol, bar_ts, tolerance (as of the later swing).
    A swing and the nearest one before it within the days that differs by the tolerance at most, nothing in between being
    beyond both, are a level, unless one of its kind of the day before lies within the tolerance.
    """
    placed = blocks.numbered(bars.select("symbol", "bar_ts"), ["symbol"], "bar_ts").select("symbol", "bar_ts", "pos")
    span = days * DAY
    marked = swings.join(placed, ["symbol", "bar_ts"]).join(tolerance, ["symbol", "bar_ts"]).withColumn("bucket", F.floor(clock.epoch(F.col("bar_ts")) / span))
    late = marked.select("symbol", "kind", F.explode(F.array("bucket", F.col("bucket") - 1)).alias("bucket"), "bar_ts", "known_ts", "price", "pos", "tolerance")
    early = marked.select("symbol", "kind", "bucket", F.col("bar_ts").alias("first_ts"), F.col("price").alias("first_price"), F.col("pos").alias("first_pos"))
    pairs = late.join(early, ["symbol", "kind", "bucket"]).where(
        (F.col("first_pos") < F.col("pos")) & (clock.epoch(F.col("bar_ts")) - clock.epoch(F.col("first_ts")) <= span) & (F.abs(F.col("price") - F.col("first_price")) <= F.col("tolerance"))
    )
    levels = floor(log2(span // seconds)) + 1
    table = range_extremes(bars, levels)
    length = F.col("pos") - F.col("first_pos") - 1
    pairs = pairs.withColumn("level", F.when(length > 0, F.floor(F.log2(length.cast("double")))).cast("int"))
    ends = {"a": F.col("first_pos") + 1, "b": F.col("pos") - F.pow(F.lit(2.0), F.col("level")).cast("long")}
    for name, at in ends.items():
        side = table.select("symbol", "level", F.col("pos").alias(f"{name}_pos"), F.struct("top", "bottom").alias(name))
        pairs = pairs.withColumn(f"{name}_pos", at).join(side, ["symbol", "level", f"{name}_pos"], "left")
    high = F.col("kind") == "high"
    level = F.when(high, F.greatest("price", "first_price")).otherwise(F.least("price", "first_price"))
    beyond = F.when(high, F.greatest("a.top", "b.top") > level).otherwise(F.least("a.bottom", "b.bottom") < level)
    fine = pairs.withColumn("found", level).where(~F.coalesce(beyond, F.lit(False)))
    nearest = F.max_by(F.struct("found", "first_ts"), "first_pos").alias("n")
    found = fine.groupBy("symbol", "kind", "pos", "bar_ts", "known_ts", "tolerance").agg(nearest)
    found = found.select(
        F.concat_ws("@", "symbol", "kind", F.col("pos").cast("string")).alias("id"), "symbol", "kind", F.col("pos").alias("place"), "known_ts", "tolerance",
        F.col("n.found").alias("price"), F.col("n.first_ts").alias("origin_ts"),
    )
    found = settled(found)
    day = lambda c: F.floor(clock.epoch(F.col(c)) / DAY)
    new = found.select("id", "symbol", "kind", F.explode(F.array(day("known_ts"), day("known_ts") - 1)).alias("day"), "place", "price", "tolerance", clock.epoch(F.col("known_ts")).alias("at"))
    old = found.select(F.col("id").alias("rival"), "symbol", "kind", day("known_ts").alias("day"), F.col("place").alias("old_place"), F.col("price").alias("old"), clock.epoch(F.col("known_ts")).alias("old_at"))
    met = new.join(old, ["symbol", "kind", "day"]).where((F.col("old_place") < F.col("place")) & (F.abs(F.col("old") - F.col("price")) <= F.col("tolerance")) & (F.col("old_at") >= F.col("at") - DAY))
    kept = intervals.first_come(found, met)
    side = F.when(F.col("kind") == "high", "sell").otherwise("buy")
    return kept.select(
        F.col("id").alias("area_id"), "symbol", F.when(F.col("kind") == "high", "eqh").otherwise("eql").alias("kind"), side.alias("side"), "price", "known_ts", "origin_ts",
        after("known_ts", span).alias("expires_ts"),
    )


def order_blocks(bars: DataFrame, breaks: DataFrame, seconds: int, back: int = 29, days: int = 5) -> DataFrame:
    """The last bar the other way within so many bars before each break of structure, all of its range, as an area
    that expires. breaks: symbol, bar_ts, side. Breaks without such a bar have none."""
    w = blocks.within(["symbol"]).rowsBetween(-back, -1)
    shape = F.struct("low", "high", "bar_ts")
    up, down = F.col("close") > F.col("open"), F.col("close") < F.col("open")
    made = {"last_up": F.last(F.when(up, shape), ignorenulls=True).over(w), "last_down": F.last(F.when(down, shape), ignorenulls=True).over(w)}
    before = blocks.framed(bars, ["symbol"], "bar_ts", back, 0, made).select("symbol", "bar_ts", "last_up", "last_down")
    met = breaks.select("symbol", "bar_ts", "side").join(before, ["symbol", "bar_ts"])
    met = met.withColumn("from", F.when(F.col("side") == "buy", F.col("last_down")).otherwise(F.col("last_up"))).where("from is not null")
    return met.select(
        F.concat_ws("@", "symbol", F.lit("ob"), "side", clock.epoch(F.col("bar_ts")).cast("string")).alias("area_id"), "symbol", F.lit("ob").alias("kind"), "side",
        F.col("from.low").alias("bottom"), F.col("from.high").alias("top"), after("bar_ts", seconds).alias("known_ts"), F.col("from.bar_ts").alias("origin_ts"),
        F.timestamp_add("SECOND", F.lit(seconds + days * DAY), F.col("bar_ts")).alias("expires_ts"),
    )


def alive_at(clocks: DataFrame, areas: DataFrame) -> DataFrame:
    """Each clock (clock_id, symbol, clock_ts) with every area that is known and has not ended by then.

    until_ts is dropped: at the clock nobody knows it. Rows that become known after a clock change nothing there.
    """
    held = areas.select("symbol", "area_id", "kind", "side", "bottom", "top", "known_ts", "until_ts")
    return intervals.stabbed(clocks.select("clock_id", "symbol", "clock_ts"), held, ["symbol"], "clock_ts", "known_ts", "until_ts").drop("until_ts")
