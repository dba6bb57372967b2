"""Which kinds of news move price: curves pooled by concept, against the published importance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.statistics import bh_adjust


def concept_ranking(curve: DataFrame, indicators: DataFrame, horizon: str = "+1d", alpha: float = 0.05) -> DataFrame:
    """One row per concept: median ratio, pairings, significant ones, releases, importance and both ranks.

    indicators: indicator, concept, importance, release_group (null if it is published alone). p is
    corrected over all pairings. Indicators of one release group count once for a symbol: they saw the
    same move.
    """
    rows = curve.where((F.col("horizon") == horizon) & F.col("mean_abs_excess").isNotNull())
    rows = bh_adjust(rows.join(F.broadcast(indicators), "indicator").where("concept <> ''"), "abs_p_value", "p_sweep").where("abs_ratio is not null")
    token = F.coalesce(F.concat(F.lit("group:"), "release_group"), F.concat(F.lit("indicator:"), "indicator"))
    first = Window.partitionBy(token, "symbol").orderBy("indicator")
    seen = rows.withColumn("counts", F.row_number().over(first) == 1)
    once = lambda c: F.when(F.col("counts"), c)
    pooled = seen.groupBy("concept").agg(
        F.percentile(once(F.col("abs_ratio")), 0.5).alias("median_ratio"),
        F.count(once(F.lit(1))).alias("pairings"),
        F.count_if(F.col("counts") & (F.col("p_sweep") < alpha)).alias("significant"),
        F.sum(once(F.col("n"))).alias("releases"),
        F.avg(once(F.col("importance"))).alias("published"),
        F.count_distinct("indicator").alias("indicators"),
        F.max("abs_ratio").alias("best"),
        F.max_by("indicator", F.struct("abs_ratio", "indicator")).alias("best_indicator"),
    )
    # one row for each concept
    measured = Window.orderBy(F.col("median_ratio").desc_nulls_last(), "concept")
    published = Window.orderBy(F.col("published").desc_nulls_last(), "concept")
    ranked = pooled.withColumn("rank", F.row_number().over(measured)).withColumn("published_rank", F.row_number().over(published))
    return ranked.withColumn("disagreement", F.col("published_rank") - F.col("rank"))


def best_direction(fits: DataFrame, horizon: str = "+1d") -> DataFrame:
    """The best supported direction of each indicator: the fit with the smallest adjusted p."""
    known = fits.where((F.col("horizon") == horizon) & F.col("p_fdr").isNotNull() & F.col("beta").isNotNull())
    return known.groupBy("indicator").agg(
        F.min_by("symbol", F.struct("p_fdr", "symbol")).alias("symbol"), F.min_by("beta", F.struct("p_fdr", "symbol")).alias("beta"), F.min("p_fdr").alias("p_fdr")
    )
