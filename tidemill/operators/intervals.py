"""Which intervals hold a moment, and choices among intervals that rule each other out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import clock
from tidemill.operators.consolidation import components
from tidemill.operators.shared import settled

#: Dyadic levels of a time unit: with hours, the coarsest blocks are of some 470 days.
LEVELS = 14


def _floor(x: Column, level: int) -> Column:
    return F.floor(x / (1 << level)).cast("long")


def _ceil(x: Column, level: int) -> Column:
    return F.ceil(x / (1 << level)).cast("long")


def covering(start: Column, end: Column) -> Column:
    """The dyadic blocks (level, block) of which the whole numbers from start to before end consist: two a level at most,
    but for the coarsest level, whose blocks are all taken."""
    spots = []
    for level in range(LEVELS):
        a, b = _ceil(start, level), _floor(end, level)
        spot = lambda at, take, level=level: F.when(take, F.struct(F.lit(level).alias("level"), at.alias("block")))
        spots += [spot(a, (a < b) & (F.pmod(a, F.lit(2)) == 1)), spot(b - 1, (a < b) & (F.pmod(b, F.lit(2)) == 1))]
    a, b = _ceil(start, LEVELS), _floor(end, LEVELS)
    top = F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(LEVELS).alias("level"), x.alias("block"))))
    return F.concat(F.array_compact(F.array(*spots)), F.coalesce(top, F.array().cast("array<struct<level:int,block:bigint>>")))


def holding(at: Column) -> Column:
    """The dyadic blocks, one a level, that hold a whole number."""
    return F.array(*[F.struct(F.lit(level).alias("level"), _floor(at, level).alias("block")) for level in range(LEVELS + 1)])


def stabbed(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, unit_seconds: int = 3600) -> DataFrame:
    """Each row of points with each interval of its key that holds it: start <= at < end, a null end being open.

    An interval is a few dyadic blocks of time units, a moment lies in one block of every level, and both meet by an
    equi-join in the one block that they share. So an interval costs the logarithm of its length, however long it lives, and
    neither side is multiplied by the units between. Columns of the same name but by are refused.
    """
    shared = set(points.columns) & set(intervals.columns) - set(by)
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    unit = lambda c, f: f(clock.epoch(c) / unit_seconds).cast("long")
    # beyond the last moment nothing is asked
    last = F.lit(points.agg(F.max(at)).first()[0]).cast(points.schema[at].dataType)
    until = F.least(F.coalesce(F.col(end), last), last)
    held = intervals.where(F.col(start).isNotNull()).withColumn("__s", F.explode(covering(unit(F.col(start), F.floor), unit(until, F.floor) + 1)))
    asked = points.where(F.col(at).isNotNull()).withColumn("__s", F.explode(holding(unit(F.col(at), F.floor))))
    split = lambda df: df.withColumns({"__level": F.col("__s.level"), "__block": F.col("__s.block")}).drop("__s")
    met = split(asked).join(split(held), [*by, "__level", "__block"]).drop("__level", "__block")
    return met.where((F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end))))


def first_come(candidates: DataFrame, rivals: DataFrame) -> DataFrame:
    """The candidates (id, place) that stay when each, in order of place, falls to a rival before it that has stayed.

    rivals: id and rival, which comes before id. Candidates that are linked by rivals form groups, which are decided side by
    side; within one the choice is a fold in order. So a key with many candidates is spread over its groups.
    """
    pairs = settled(rivals.select("id", "rival").distinct())
    if pairs.isEmpty():
        return candidates
    group = components(pairs.select(F.col("id").alias("a"), F.col("rival").alias("b")))
    against = pairs.groupBy("id").agg(F.collect_list("rival").alias("against"))
    kind = candidates.schema["id"].dataType.simpleString()
    linked = settled(candidates.join(group, candidates["id"] == group["node"]).join(against, "id", "left"))
    row = F.struct("place", "id", F.coalesce("against", F.array().cast(f"array<{kind}>")).alias("against"))
    grouped = linked.groupBy("component").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    stay = F.aggregate("rows", F.array().cast(f"array<{kind}>"), lambda kept, r: F.when(F.arrays_overlap(kept, r["against"]), kept).otherwise(F.array_append(kept, r["id"])))
    kept = grouped.select(F.explode(stay).alias("id"))
    lost = linked.select("id").join(kept, "id", "left_anti")
    return candidates.join(lost, "id", "left_anti")
