"""Timestamp validation: does the widest bar near a release lie in the stored hour?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import clock
from tidemill.functions.statistics import bh_adjust, binomial_upper_tail

HOUR = 3600
WEEK_HOURS = 168
WEEKS, LOOKBACK, MIN_BASELINE = 12, 40, 5
SPIKE, TIE, NEIGHBOURS = 1.5, 0.9, 3
MIN_VERDICT, MODAL_SHARE, DECISIVE_P, SILENT_SHARE = 10, 0.20, 0.01, 0.2


def hour_number(ts: Column) -> Column:
    return F.floor(clock.epoch(ts) / HOUR)


def ranges(bars: DataFrame) -> DataFrame:
    """Log range of each hour; negative or undefined ones are null."""
    r = F.when((F.col("low") > 0) & (F.col("high") >= F.col("low")), F.ln(F.col("high") / F.col("low")))
    return bars.select("symbol", hour_number(F.col("bar_ts")).alias("hour"), r.alias("range"))


def blocked_offsets(releases: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """indicator, hour and offset (in bars) whose bar holds another indicator's release of equal or greater weight."""
    own = releases.select("indicator", "importance", hour_number(F.col("ts")).alias("hour")).distinct()
    steps = [i for i in range(-neighbours, neighbours + 1) if i]
    asked = own.withColumn("offset", F.explode(F.array(*[F.lit(i) for i in steps]))).withColumn("there", F.col("hour") + F.col("offset"))
    other = own.select(F.col("indicator").alias("o_indicator"), F.col("importance").alias("o_importance"), F.col("hour").alias("there"))
    heavier = (asked["there"] == other["there"]) & (F.col("o_indicator") != F.col("indicator")) & (F.col("o_importance") >= F.col("importance"))
    return asked.join(other, heavier, "left_semi").select("indicator", "hour", "offset").distinct()


def grade(
    releases: DataFrame, bars: DataFrame, pairs: DataFrame, weeks: int = WEEKS, lookback: int = LOOKBACK, least: int = MIN_BASELINE, spike: float = SPIKE
) -> DataFrame:
    """One row per release: status, ratio (own hour), best_ratio and offset_min.

    Every hour of the neighbourhood is compared with the median of the same hour of earlier weeks that hold
    none of the indicator's releases. Of equal ratios the earliest hour counts. All this rests on the hour alone: it is done once
    for each hour of an indicator, and releases get the grade of their hour. Repeated releases repeat their weeks.
    """
    r = ranges(bars)
    timed = releases.groupBy("indicator", "ts").agg(F.least(F.count("*"), F.lit(weeks)).cast("int").alias("times")).withColumn("hour", hour_number(F.col("ts")))
    asked = timed.select("indicator", "hour", "times").distinct().join(F.broadcast(pairs), "indicator")
    steps = F.explode(F.sequence(F.lit(-NEIGHBOURS), F.lit(NEIGHBOURS)))
    spots = asked.select("indicator", "symbol", "times", "hour", steps.alias("offset")).withColumn("at", F.col("hour") + F.col("offset"))
    taken = releases.select("indicator", hour_number(F.col("ts")).alias("past")).distinct()
    back = spots.select("indicator", "symbol", "times", "at").distinct()
    back = back.withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(lookback)))).withColumn("past", F.col("at") - WEEK_HOURS * F.col("week"))
    back = back.join(taken, ["indicator", "past"], "left_anti").join(r.select("symbol", F.col("hour").alias("past"), F.col("range").alias("r")), ["symbol", "past"])
    back = back.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    # the nearest clean weeks, at most so many: arrays of a dozen numbers
    near = F.slice(F.sort_array(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("week", "r")))), 1, weeks)
    normal = back.groupBy("indicator", "symbol", "times", "at").agg(F.sort_array(F.transform(near, lambda x: x["r"])).alias("s"))
    n = F.size("s")
    mid = (F.get("s", F.floor((n - 1) / 2).cast("int")) + F.get("s", F.floor(n / 2).cast("int"))) / 2
    normal = normal.select("indicator", "symbol", "times", "at", F.when(n >= least, mid).alias("normal"))
    seen = spots.join(r.select("symbol", F.col("hour").alias("at"), F.col("range").alias("observed")), ["symbol", "at"], "left")
    rated = seen.join(normal, ["indicator", "symbol", "times", "at"], "left")
    rated = rated.withColumn("ratio", F.when(F.col("normal") > 0, F.col("observed") / F.col("normal")))
    best = rated.groupBy("indicator", "symbol", "times", "hour").agg(
        F.max(F.when(F.col("offset") == 0, F.col("ratio"))).alias("ratio"),
        F.max("ratio").alias("best_ratio"),
        F.max_by("offset", F.struct("ratio", -F.col("offset"))).alias("offset"),
    )
    blocked = blocked_offsets(releases).withColumn("blocked", F.lit(True))
    best = best.join(blocked, ["indicator", "hour", "offset"], "left")
    own = (F.col("ratio") >= spike) & (F.col("ratio") >= F.col("best_ratio") * TIE)
    status = (
        F.when(F.col("ratio").isNull(), "uncheckable")
        .when(F.col("best_ratio") < spike, "no_spike")
        .when(own, "confirmed_hour")
        .when(F.col("blocked"), "confounded")
        .otherwise("offset")
    )
    best = best.withColumn("status", status)
    minutes = F.when(F.col("status") == "confirmed_hour", 0).when(F.col("status").isin("offset", "confounded"), F.col("offset") * 60)
    known = F.col("status") != "uncheckable"
    timed = timed.select(F.col("indicator").alias("__i"), "ts", F.col("times").alias("__n"), F.col("hour").alias("__h"))
    best = best.join(timed, (F.col("indicator") == F.col("__i")) & (F.col("times") == F.col("__n")) & F.col("hour").eqNullSafe(F.col("__h")))
    return best.select("indicator", "symbol", "ts", "status", "ratio", F.when(known, F.col("best_ratio")).alias("best_ratio"), minutes.alias("offset_min"))


def verdicts(grades: DataFrame, by: list[str], bins: int = 2 * NEIGHBOURS + 1) -> DataFrame:
    """One verdict per group: modal offset, its share and chance, and the status before the sweep's correction."""
    voted = grades.withColumn("vote", F.when(F.col("status") == "confirmed_hour", 0).when(F.col("status") == "offset", F.col("offset_min")))
    counts = voted.where("vote is not null").groupBy(*by, "vote").agg(F.count("*").alias("__k"))
    modal = counts.groupBy(*by).agg(
        F.min_by("vote", F.struct(-F.col("__k"), F.abs("vote"), "vote")).alias("modal_offset"),
        F.max("__k").alias("modal_n"),
        F.sum("__k").alias("spiked"),
        F.sum(F.when(F.col("vote") == 0, F.col("__k"))).alias("confirmed"),
        F.max(F.when(F.col("vote") != 0, F.col("__k"))).alias("best_off"),
    )
    rated = F.when((F.col("vote").isNotNull()) | (F.col("status") == "no_spike"), F.col("ratio"))
    rest = voted.groupBy(*by).agg(
        F.count_if(F.col("status") == "no_spike").alias("no_spike"), F.count_if(F.col("status") == "confounded").alias("confounded"), F.percentile(rated, 0.5).alias("median_ratio")
    )
    v = rest.join(modal, by, "left").fillna(0, ["spiked", "confirmed"])
    v = v.withColumn("modal_share", F.col("modal_n") / F.nullif("spiked", F.lit(0))).withColumn("attributable", F.col("spiked") + F.col("no_spike"))
    v = v.withColumn("modal_p", F.when(F.col("spiked") > 0, binomial_upper_tail(F.col("modal_n"), F.col("spiked"), 1 / bins)))
    v = v.withColumn("offset_p", F.when(F.col("best_off") > 0, binomial_upper_tail(F.col("best_off"), F.col("spiked"), 1 / bins)))
    status = (
        F.when(F.col("attributable") < MIN_VERDICT, "insufficient")
        .when(F.col("spiked") / F.nullif("attributable", F.lit(0)) < SILENT_SHARE, "silent")
        .when((F.col("modal_share") < MODAL_SHARE) | (F.col("modal_p") >= DECISIVE_P), "scattered")
        .when(F.col("modal_offset") == 0, "aligned")
        .otherwise("offset")
    )
    return v.withColumn("status", status).drop("modal_n", "best_off")


def sweep(found: DataFrame, alpha: float = DECISIVE_P) -> DataFrame:
    """Controls false discoveries across all groups checked: an offset that does not survive is scattered."""
    adjusted = bh_adjust(found, "offset_p", "offset_p_fdr")
    fails = (F.col("status") == "offset") & (F.coalesce("offset_p_fdr", F.lit(1.0)) >= alpha)
    return adjusted.withColumn("status", F.when(fails, "scattered").otherwise(F.col("status")))


def offset_histogram(grades: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Releases per hourly offset, empty ones too."""
    spots = grades.sparkSession.range(-neighbours, neighbours + 1).select((F.col("id") * 60).cast("int").alias("offset_min"))
    counted = grades.where("status in ('confirmed_hour', 'offset')").groupBy("offset_min").agg(F.count("*").alias("n"))
    return spots.join(counted, "offset_min", "left").fillna(0, ["n"])
