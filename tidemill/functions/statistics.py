"""Closed-form statistics as column expressions, and those that need windows as functions of DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.shared import settled

Z95 = 1.959964
MAD_TO_SIGMA = 1.4826


def t_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite trigonometric series."""
    v = dof.cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(v))
    cos = F.cos(theta)
    odd = v % 2 == 1
    terms = F.when(odd, F.floor((v - 1) / 2)).otherwise(F.floor(v / 2)).cast("int")
    steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.when(odd, cos).otherwise(F.lit(1.0)).alias("m"), F.lit(0.0).alias("s"))

    def step(acc: Column, k: Column) -> Column:
        ratio = F.when(odd, 2.0 * k / (2.0 * k + 1.0)).otherwise((2.0 * k - 1.0) / (2.0 * k))
        return F.struct((acc["m"] * cos * cos * ratio).alias("m"), (acc["s"] + acc["m"]).alias("s"))

    total = F.aggregate(steps, start, step, lambda acc: acc["s"])
    p_odd = 1 - (2 / math.pi) * (theta + F.sin(theta) * total)
    p = F.when(odd, p_odd).otherwise(1 - F.sin(theta) * total)
    return F.when((v >= 1) & t.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def binomial_upper_tail(hits: Column, n: Column, q: float) -> Column:
    """P(X >= hits) of n trials with chance q, in logarithms so that large n does not underflow."""
    last = n.cast("int")
    steps = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(
        (last * math.log1p(-q)).alias("m"), F.when(hits <= 0, F.exp(last * math.log1p(-q))).otherwise(0.0).alias("s")
    )

    def step(acc: Column, k: Column) -> Column:
        m = acc["m"] + F.log((last - k) / (k + 1.0)) + math.log(q / (1 - q))
        return F.struct(m.alias("m"), (acc["s"] + F.when(k + 1 >= hits, F.exp(m)).otherwise(0.0)).alias("s"))

    return F.least(F.lit(1.0), F.aggregate(steps, start, step, lambda acc: acc["s"]))


def wilson(wins: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Low and high end of Wilson's interval; null without trials."""
    p = wins / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def ols(y: str, x: str) -> dict[str, Column]:
    """Aggregates of a least-squares line: n, slope, intercept, r2, se (null where the residuals vanish)."""
    sxx, syy, sxy = F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    n = F.regr_count(F.col(y), F.col(x))
    sse = syy - sxy * sxy / F.nullif(sxx, F.lit(0.0))
    return {
        "n": n,
        "slope": F.when(sxx > 0, F.regr_slope(y, x)),
        "intercept": F.when(sxx > 0, F.regr_intercept(y, x)),
        "r2": F.when((sxx > 0) & (syy > 0), sxy * sxy / F.nullif(sxx * syy, F.lit(0.0))),
        "se": F.when((n > 2) & (sse > 0), F.sqrt(sse / F.nullif(n - 2, F.lit(0)) / F.nullif(sxx, F.lit(0.0)))),
    }


def bh_adjust(df: DataFrame, p: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg step-up within groups (or over all rows); nulls take no part and stay null.

    Without ``by`` the family is the whole table: meant for results of a study (one row for each
    indicator or horizon), not for raw data.
    """
    keys = [F.col(c) for c in by] if by else [F.lit(1)]
    known = F.col(p).isNotNull()
    group = Window.partitionBy(*keys, known)
    up = group.orderBy(p)
    ranked = df.withColumn("__rank", F.row_number().over(up)).withColumn("__m", F.count(p).over(group))
    scaled = ranked.withColumn("__q", F.col(p) * F.col("__m") / F.col("__rank"))
    down = group.orderBy(F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min("__q").over(down))
    return scaled.withColumn(out, F.when(known, adjusted)).drop("__rank", "__m", "__q")


#: Groups up to which a table of one row a group is broadcast.
MOST_GROUPS = 100_000


def _per_group(rows: DataFrame) -> DataFrame:
    """One row a group, computed once; broadcast where a count proves it small, so that no task gets all rows of a group."""
    kept = settled(rows)
    return F.broadcast(kept) if kept.count() <= MOST_GROUPS else kept


def medians(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """One row for each group of by: the exact median of value (null without values) and ``__n``, how many values there are.

    A sketch gives two bounds close to the middle; they part a group's values into those below, between and above, whose counts
    tell where the middle ranks lie. Only that part's values are ordered, as distinct values with counts. However poor the bounds, the
    median is exact; equal values are counted before they meet in one task.
    """
    counts = df.groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__k"))
    bounds = _per_group(df.groupBy(*by).agg(F.percentile_approx(value, [0.4995, 0.5005], 10_000).alias("__b"), F.count(value).alias("__n")))
    same = lambda other: [F.col(f"l.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in by]
    v, b = F.col("__v"), F.col("__b")
    part = F.when(v <= b[0], 0).when(v <= b[1], 1).otherwise(2)
    met = counts.where(v.isNotNull()).alias("l").join(bounds.alias("b"), same("b"))
    parted = met.select("l.*", part.alias("__part"))
    sizes = parted.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("__part") < p, F.col("__k"))), F.lit(0)).alias(f"__before{p}") for p in (1, 2)])
    known = bounds.alias("l").join(sizes.alias("s"), same("s")).select(*[F.col(f"l.{c}").alias(c) for c in by], "__n", "__b", "__before1", "__before2")
    low, high = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)  # ranks from 0
    of = lambda rank: F.when(rank < F.col("__before1"), 0).when(rank < F.col("__before2"), 1).otherwise(2)
    known = _per_group(known.select(*by, "__b", low.alias("__low"), high.alias("__high"), of(low).alias("__from"), of(high).alias("__to"), "__before1", "__before2"))
    # the middle lies in one part, or between two of them
    ends = parted.groupBy(*by, "__part").agg(F.min("__v").alias("__first"), F.max("__v").alias("__last"))
    near = counts.where(v.isNotNull()).alias("l").join(known.alias("m"), same("m")).select("l.*", *[F.col(f"m.{c}") for c in ("__low", "__high", "__from", "__to", "__before1", "__before2")], part.alias("__part"))
    inside = near.where((F.col("__part") == F.col("__from")) & (F.col("__from") == F.col("__to")))
    start = F.when(F.col("__part") == 0, 0).when(F.col("__part") == 1, F.col("__before1")).otherwise(F.col("__before2"))
    through = start + F.sum("__k").over(Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("__through", through)
    at = lambda rank: F.min(F.when(F.col("__through") > F.col(rank), v))
    within = ranked.groupBy(*by).agg(at("__low").alias("__a"), at("__high").alias("__z"))
    split = known.where("__from < __to").alias("l")
    between = (
        split.join(ends.alias("e"), same("e")).groupBy(*[F.col(f"l.{c}").alias(c) for c in by])
        .agg(F.max(F.when(F.col("__part") == F.col("__from"), F.col("__last"))).alias("__a"), F.max(F.when(F.col("__part") == F.col("__to"), F.col("__first"))).alias("__z"))
    )
    middle = within.unionByName(between).select(*by, (F.col("__a") * F.lit(0.5) + F.col("__z") * F.lit(0.5)).alias(out))
    return _per_group(bounds.alias("l").join(middle.alias("m"), same("m"), "left").select(*[F.col(f"l.{c}").alias(c) for c in by], out, "__n"))


def mad_outliers(df: DataFrame, value: str, by: list[str], out: str = "is_outlier", z: float = 10.0, least: int = 5) -> DataFrame:
    """Marks values further than z robust deviations from their group's median; never where MAD is 0."""
    mid = medians(df, value, by, "__mid").drop("__n")
    away = df.join(mid, by).withColumn("__away", F.abs(F.col(value) - F.col("__mid")))
    spread = medians(away, "__away", by, "__mad")
    far = F.col("__away") / F.nullif(F.col("__mad") * MAD_TO_SIGMA, F.lit(0.0)) > z
    flagged = away.join(spread, by).withColumn(out, F.coalesce((F.col("__n") >= least) & far, F.lit(False)))
    return flagged.drop("__mid", "__away", "__mad", "__n")
