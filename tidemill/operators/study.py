"""Event study: how far price moves around releases against its matched normal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import clock
from tidemill.functions.statistics import bh_adjust, mad_outliers, t_two_sided_p
from tidemill.operators.baseline import measured

DAY, HOUR, MINUTE = 86400, 3600, 60
#: The ladder's rungs in seconds (fixed values).
LADDER = {
    "-5d": -5 * DAY, "-1d": -DAY, "-4h": -4 * HOUR, "-1h": -HOUR, "-15m": -15 * MINUTE, "-5m": -5 * MINUTE,
    "+1m": MINUTE, "+5m": 5 * MINUTE, "+15m": 15 * MINUTE, "+30m": 30 * MINUTE, "+1h": HOUR, "+4h": 4 * HOUR,
    "+1d": DAY, "+3d": 3 * DAY, "+1w": 7 * DAY, "+2w": 14 * DAY, "+1M": 30 * DAY,
}


def supported(step: int, ladder: dict[str, int] = LADDER) -> dict[str, int]:
    """The rungs that bars of ``step`` seconds can answer: those at least one bar long."""
    return {name: seconds for name, seconds in ladder.items() if abs(seconds) >= step}


DAY_LADDER = supported(DAY)
MIN_COVERAGE, MIN_POOL, POWER = 0.6, 20, 2.8


def slot_of(ts: Column, step: int = DAY) -> Column:
    return F.floor(clock.epoch(ts) / step).cast("int")


def event_windows(bars: DataFrame, releases: DataFrame, pairs: DataFrame, ladder: dict[str, int] = DAY_LADDER, step: int = DAY) -> DataFrame:
    """One row per release, symbol and horizon: ret, n_bars, bars_expected, realized_vol, mfe, mae, usable.

    step is the bars' length in seconds; every rung is a multiple of it. mfe and mae are the log distances from the
    price before the release to the highest and the lowest price of the window. Null where the window is not usable.
    """
    asked = releases.select("indicator", "ts").join(pairs.select("indicator", "symbol"), "indicator")
    met = measured(bars, asked, ladder).withColumn("slot", slot_of(F.col("ts"), step))
    shifted = F.timestamp_add("SECOND", F.col("seconds"), F.col("ts"))
    open_time = clock.open_seconds_between(F.least("ts", shifted), F.greatest("ts", shifted))
    met = met.withColumn("bars_expected", F.greatest(F.floor(open_time / step), F.lit(1)))
    usable = F.col("ret").isNotNull() & (F.col("n_bars") >= MIN_COVERAGE * F.col("bars_expected"))
    reach_of = lambda c: F.when(usable & (F.col("n_bars") > 0) & (F.col("anchor") > 0) & (F.col(c) > 0), F.ln(F.col(c) / F.col("anchor")))
    return met.select(
        "indicator", "symbol", "ts", "slot", "horizon", "seconds", "n_bars", "bars_expected",
        F.when(usable, F.col("ret")).alias("ret"), F.when(usable & (F.col("n_bars") > 1), F.col("realized_vol")).alias("realized_vol"),
        reach_of("top").alias("mfe"), reach_of("bottom").alias("mae"), F.coalesce(usable, F.lit(False)).alias("usable"),
    )


def impacts(baselined: DataFrame, shocks: DataFrame, step: int = DAY) -> DataFrame:
    """abnormal_ret, abs_excess, abs_ratio, standardised, is_outlier and outlier_reason of each usable row; step is the bars' length."""
    rows = baselined.where("usable").select(
        "*",
        F.abs("ret").alias("abs_ret"),
        (F.col("ret") - F.col("baseline_mean")).alias("abnormal_ret"),
        (F.abs("ret") - F.col("baseline_abs_mean")).alias("abs_excess"),
        (F.abs("ret") / F.nullif("baseline_abs_mean", F.lit(0.0))).alias("abs_ratio"),
        ((F.col("ret") - F.col("baseline_mean")) / F.nullif("baseline_sd", F.lit(0.0))).alias("standardised"),
    )
    flagged = mad_outliers(rows, "abnormal_ret", ["indicator", "symbol", "horizon"], "far")
    slots = (F.col("seconds") / step).cast("int")
    # shocks are a handful, named by hand: all of them stand beside each row, in order
    known = shocks.select(F.struct(slot_of(F.col("shock_ts"), step).alias("slot"), "label").alias("s")).agg(F.sort_array(F.collect_list("s")).alias("shocks"))
    # windows are widened to whole bars
    first, last = F.least(F.col("slot"), F.col("slot") + slots), F.greatest(F.col("slot"), F.col("slot") + slots)
    met = F.get(F.filter("shocks", lambda s: (s["slot"] >= first) & (s["slot"] <= last)), F.lit(0))["label"]
    hit = flagged.crossJoin(F.broadcast(known)).withColumn("label", met)
    reason = F.when(F.col("label").isNotNull(), F.concat(F.lit("window contains: "), "label")).when(F.col("far"), "far from the median")
    return hit.select(*rows.columns, reason.alias("outlier_reason"), reason.isNotNull().alias("is_outlier"))


def pool(measured: DataFrame, by: list[str]) -> DataFrame:
    """Pooled effect per group: signed and absolute mean, errors, t, p, hit rate, floor, ratio of means."""
    ratio_row = F.col("baseline_abs_mean").isNotNull() & (F.col("baseline_abs_mean") != 0)
    a = measured.where("abnormal_ret is not null").groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("abnormal_ret").alias("mean_abnormal"),
        F.stddev_samp("abnormal_ret").alias("sd"),
        F.avg((F.col("abnormal_ret") > 0).cast("double")).alias("hit_rate"),
        F.avg("abs_excess").alias("mean_abs_excess"),
        F.stddev_samp("abs_excess").alias("abs_sd"),
        F.count("abs_excess").alias("abs_n"),
        (F.sum(F.when(ratio_row, F.col("abs_ret"))) / F.nullif(F.sum(F.when(ratio_row, F.col("baseline_abs_mean"))), F.lit(0.0))).alias("abs_ratio"),
        F.percentile(F.nullif("baseline_n", F.lit(0)), 0.5).cast("int").alias("baseline_n"),
    )
    se = F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.col("sd") / F.sqrt("n"))
    abs_se = F.when((F.col("abs_n") >= 2) & (F.col("abs_sd") > 0), F.col("abs_sd") / F.sqrt("abs_n"))
    a = a.withColumn("std_error", se).withColumn("abs_std_error", abs_se)
    return a.select(
        *by, "n", "baseline_n", F.when(F.col("n") >= 2, F.col("mean_abnormal")).alias("mean_abnormal"), "std_error",
        F.when(F.col("n") >= 2, F.col("hit_rate")).alias("hit_rate"),
        t_two_sided_p(F.col("mean_abnormal") / F.col("std_error"), F.col("n") - 1).alias("p_value"),
        (POWER * F.col("std_error")).alias("detectability_floor"),
        F.when(F.col("abs_n") >= 2, F.col("mean_abs_excess")).alias("mean_abs_excess"), "abs_std_error",
        t_two_sided_p(F.col("mean_abs_excess") / F.col("abs_std_error"), F.col("abs_n") - 1).alias("abs_p_value"), "abs_ratio",
    )


def decay_curve(measured: DataFrame, pairing: list[str], least: int = MIN_POOL) -> DataFrame:
    """The curve of each pairing: pooled points with p adjusted across its horizons; effects are null below
    the least number of releases, floor and n stay."""
    points = bh_adjust(pool(measured, [*pairing, "horizon", "seconds"]), "abs_p_value", "abs_p_fdr", pairing)
    gate = lambda c: F.when(F.col("n") >= least, F.col(c)).alias(c)
    gated = ["mean_abnormal", "std_error", "hit_rate", "p_value", "mean_abs_excess", "abs_std_error", "abs_p_value", "abs_p_fdr", "abs_ratio"]
    hours = F.abs("seconds") / 3600
    badge = F.when(hours <= 4, "high").when(hours <= 72, "medium").otherwise("low")
    return points.select(*pairing, "horizon", "seconds", "n", "baseline_n", *[gate(c) for c in gated], "detectability_floor", badge.alias("attribution"))


def change_z(series: DataFrame, by: list[str], ts: str, value: str, window: int = 20, least: int = 8) -> DataFrame:
    """z of each change against the sample deviation of the known changes before it (never its own)."""
    known = series.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    w = Window.partitionBy(*by).orderBy(ts).rowsBetween(-window, -1)
    sigma = F.stddev_samp(value).over(w)
    scored = known.select(*by, ts, F.when((F.count(value).over(w) >= least) & (sigma > 0), F.col(value) / sigma).alias("z"))
    return series.join(scored, [*by, ts], "left")


def direction_fit(measured: DataFrame, by: list[str], x: str = "z", y: str = "abnormal_ret") -> DataFrame:
    """Regression of abnormal return on standardised change: slope, error, t, p, R2, floor, and both halves."""
    from tidemill.functions.statistics import ols

    rows = measured.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).alias("x"), F.col(y).alias("y"), F.when(F.col(x) > 0, F.col(x)).alias("x_up"), F.when(F.col(x) < 0, F.col(x)).alias("x_down")
    )
    both, up, down = ols("y", "x"), ols("y", "x_up"), ols("y", "x_down")
    fits = rows.groupBy(*by).agg(
        F.count("*").alias("n"), both["slope"].alias("beta"), both["intercept"].alias("intercept"), both["r2"].alias("r_squared"), both["se"].alias("std_error"),
        F.count("x_up").alias("n_up"), F.count("x_down").alias("n_down"),
        up["slope"].alias("beta_up"), down["slope"].alias("beta_down"),
    )
    enough = F.col("n") >= 3
    null = lambda c, ok=enough: F.when(ok, F.col(c)).alias(c)
    fits = fits.select(
        *by, "n", "n_up", "n_down", null("beta"), null("intercept"), null("std_error"), null("r_squared"),
        null("beta_up", enough & (F.col("n_up") >= 3)), null("beta_down", enough & (F.col("n_down") >= 3)),
    )
    t = F.col("beta") / F.col("std_error")
    return fits.withColumn("t_stat", t).withColumn("p_value", t_two_sided_p(t, F.col("n") - 2)).withColumn("detectability_floor", POWER * F.col("std_error"))
