"""Figures that screens show: feeds beside each other, sources by day, neighbours, the open book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import clock
from tidemill.operators.asof import asof_backward

#: A later source counts only if it is more current by more than this.
SAME_TIME = 5 * 60


def feed_difference(a: DataFrame, b: DataFrame, pip: Column) -> DataFrame:
    """For each symbol the bars that two feeds share, and how far apart their closes lie, in pips.

    Bars are (symbol, bar_ts, high, low, close), one a moment; without shared bars a symbol has no row.
    """
    left = a.select("symbol", "bar_ts", *[F.col(c).alias(f"{c}_a") for c in ("high", "low", "close")])
    right = b.select("symbol", "bar_ts", *[F.col(c).alias(f"{c}_b") for c in ("high", "low", "close")])
    d = left.join(right, ["symbol", "bar_ts"]).withColumn("d", (F.col("close_a") - F.col("close_b")) / pip)
    span = lambda side: (F.max(f"high_{side}") - F.min(f"low_{side}")) / pip
    return d.groupBy("symbol").agg(
        F.count("*").alias("shared"), F.avg("d").alias("mean"), F.percentile("d", F.lit(0.5)).alias("median"), F.stddev_samp("d").alias("sd"),
        F.max(F.abs("d")).alias("largest"), span("a").alias("range_a"), span("b").alias("range_b"),
    )


def best_source(days: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """For each key the source whose last row counts; days holds key columns, source and last_ts.

    Sources are taken as listed: the first that has rows is kept until a later one is more current by more
    than five minutes. Sources that are not listed do not count; equal rows of one source are one.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    seen = days.where(rank > 0).groupBy(*key, "source").agg(F.max("last_ts").alias("last_ts"))
    listed = F.sort_array(F.collect_list(F.struct(rank.alias("rank"), F.col("last_ts"), "source")))
    later = lambda held, x: F.unix_micros(F.to_timestamp_ltz(x["last_ts"])) > F.unix_micros(F.to_timestamp_ltz(held["last_ts"])) + SAME_TIME * 1_000_000
    # one row for each listed source
    best = seen.groupBy(*key).agg(listed.alias("s"))
    best = best.select(*key, F.aggregate(F.slice("s", 2, len(order)), F.col("s")[0], lambda held, x: F.when(later(held, x), x).otherwise(held)).alias("b"))
    return best.select(*key, F.col("b.source").alias("source"), F.col("b.last_ts").alias("last_ts"))


def co_timed(releases: DataFrame, most: int = 6) -> DataFrame:
    """The indicators that are published most often at the instants of each indicator; ties go by name.

    An instant has a row for each of its indicators, so pairs grow with what is published together.
    """
    r = releases.select("indicator", "ts").distinct()
    pairs = r.join(r.select(F.col("indicator").alias("neighbour"), "ts"), "ts").where("indicator <> neighbour")
    n = pairs.groupBy("indicator", "neighbour").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("indicator").orderBy(F.col("n").desc(), "neighbour"))
    return n.withColumn("place", place).where(F.col("place") <= most)


def neighbours_at_offset(grades: DataFrame, verdicts: DataFrame, releases: DataFrame, least: int = 2, most: int = 6) -> DataFrame:
    """Per indicator with a modal offset: the other indicators whose releases of at least that importance fall into the hours in
    which its spikes land, by their number, ties by name.

    The hours are those of its releases that were graded with that offset, moved by it. A neighbour is counted once for each of
    its releases, however many spikes share its hour.
    """
    hour = lambda ts, minutes=F.lit(0): F.floor((clock.epoch(ts) + minutes * 60) / 3600)
    modal = verdicts.where("modal_offset <> 0").select("indicator", "modal_offset")
    spikes = grades.where("status = 'offset'").join(modal, "indicator").where("offset_min = modal_offset")
    hours = spikes.select("indicator", hour(F.col("ts"), F.col("modal_offset")).alias("hour")).distinct()
    others = releases.where(F.col("importance") >= least).select(F.col("indicator").alias("neighbour"), hour(F.col("ts")).alias("hour"))
    n = hours.join(others, "hour").where("indicator <> neighbour").groupBy("indicator", "neighbour").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("indicator").orderBy(F.col("n").desc(), "neighbour"))
    return n.withColumn("place", place).where(F.col("place") <= most)


def source_at(ticks: DataFrame, clocks: DataFrame, order: list[str]) -> DataFrame:
    """For each clock (clock_id, symbol, clock_ts) the source whose last tick at or before it counts, and that tick's time.

    ticks: symbol, source, ts. Sources are taken as listed: a later one wins if it is more current by more than five minutes, and
    once the chosen one has a tick in the clock's market day no later one is looked at. A clock without a tick has no row.
    """
    each = clocks.select("clock_id", "symbol", "clock_ts", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("source")) for i, s in enumerate(order)])).alias("s")).select("clock_id", "symbol", "clock_ts", "s.*")
    met = asof_backward(each, ticks.select("symbol", "source", "ts"), ["symbol", "source"], "clock_ts", "ts", ["ts"]).where("ts is not null")
    listed = met.groupBy("clock_id", "symbol", "clock_ts").agg(F.sort_array(F.collect_list(F.struct("rank", "source", "ts"))).alias("s"))
    opened = clock.epoch_micros(clock.fx_day_start(F.col("clock_ts")))
    micros = lambda x: F.unix_micros(F.to_timestamp_ltz(x["ts"]))
    keep = lambda held, x: F.when((micros(held) < opened) & (micros(x) > micros(held) + SAME_TIME * 1_000_000), x).otherwise(held)
    best = listed.withColumn("b", F.aggregate(F.slice("s", 2, len(order)), F.col("s")[0], keep))
    return best.select("clock_id", "symbol", "clock_ts", F.col("b.source").alias("source"), F.col("b.ts").alias("last_ts"))


def last_of(rows: DataFrame, key: list[str], unit: str, ts: str, tie: str, take: list[str]) -> DataFrame:
    """The last row of each key and unit of time."""
    at = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("unit_ts")
    last = F.max_by(F.struct(*take), F.struct(ts, tie)).alias("r")
    return rows.groupBy(*key, at).agg(last).select(*key, "unit_ts", "r.*")


def open_book(positions: DataFrame, quotes: DataFrame, clock: str, pip_size: float, lot_units: int) -> DataFrame:
    """Open positions (symbol, side 1 or -1, lots, entry) valued at the last quote up to a clock.

    A long position is closed at the bid, a short one at the ask. Without a quote the values are null.
    """
    at = positions.withColumn("__clock", F.lit(clock).cast("timestamp_ntz"))
    marked = asof_backward(at, quotes, ["symbol"], "__clock", "ts", ["bid", "ask"], ["id"])
    move = F.col("side") * (F.when(F.col("side") > 0, F.col("bid")).otherwise(F.col("ask")) - F.col("entry"))
    mark = F.when(F.col("side") > 0, F.col("bid")).otherwise(F.col("ask")).alias("mark")
    return marked.select(*positions.columns, mark, (move / pip_size).alias("pips"), (move * F.col("lots") * lot_units).alias("profit"))


def curve_summary(curve: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """One row a curve: its peak, the last rung that holds after the release, the first later one that does not,
    and the last rung before the release at which the market is measurably quiet. Of equal peaks the earliest."""
    after = F.col("seconds") > 0
    holds = F.coalesce(F.col("abs_p_fdr") < alpha, F.lit(False))
    quiet = ~after & holds & (F.col("mean_abs_excess") < 0)
    marked = curve.withColumn("__last", F.max(F.when(after & holds, F.col("seconds"))).over(Window.partitionBy(*by)))
    peak = F.when(after & F.col("mean_abs_excess").isNotNull(), F.struct("mean_abs_excess", -F.col("seconds")))
    late = F.when(after & (F.col("seconds") > F.col("__last")), F.col("seconds"))
    return marked.groupBy(*by).agg(
        F.max("n").alias("n"), F.max_by("horizon", peak).alias("peak"), F.max_by("mean_abs_excess", peak).alias("peak_effect"), F.max_by("abs_ratio", peak).alias("peak_ratio"),
        F.max_by("horizon", F.when(after & holds, F.col("seconds"))).alias("last_significant"), F.min_by("horizon", late).alias("first_insignificant"),
        F.max_by("horizon", F.when(quiet, F.col("seconds"))).alias("quiet_before"), F.max_by("abs_ratio", F.when(quiet, F.col("seconds"))).alias("quiet_ratio"),
        F.coalesce(F.max(after & holds), F.lit(False)).alias("any_effect"),
    )


def event_scatter(impacts: DataFrame, curve: DataFrame, by: list[str], pip: float) -> DataFrame:
    """Each release's absolute move in pips beside the normal level: the mean move less the curve's effect."""
    moves = impacts.where("abs_ret is not null")
    mean = moves.groupBy(*by).agg((F.avg("abs_ret") / pip).alias("__mean"))
    level = mean.join(curve.select(*by, "mean_abs_excess"), by, "left").select(*by, (F.col("__mean") - F.col("mean_abs_excess") / pip).alias("normal"))
    return moves.select(*by, "ts", (F.col("abs_ret") / pip).alias("move"), "is_outlier").join(level, by)


def newest_version(stored: DataFrame, by: list[str], version: str, current: str) -> DataFrame:
    """Of each key the rows of the current version, else of the highest there is."""
    chosen = F.max(F.struct((F.col(version) == current).alias("now"), F.col(version).alias("version")))
    best = stored.groupBy(*by).agg(chosen.alias("__v")).select(*by, F.col("__v.version").alias(version))
    return stored.join(best, [*by, version], "left_semi")


def conversion_rate(asked: DataFrame, minutes: DataFrame, ts: str, invert: bool) -> DataFrame:
    """asked with rate: the close of the last minute complete at its time, of the first minute before any is.

    minutes: bar_ts and close of the one instrument that converts. Null without any minute.
    """
    done = minutes.select(F.lit(1).alias("__k"), (F.col("bar_ts") + F.expr("INTERVAL 1 MINUTE")).alias("__done"), F.col("close").alias("__close"))
    first = done.agg(F.min_by("__close", "__done").alias("__first"))
    met = asof_backward(asked.withColumn("__k", F.lit(1)), done, ["__k"], ts, "__done", ["__close"]).crossJoin(F.broadcast(first))
    close = F.coalesce("__close", "__first")
    return met.select(*asked.columns, (F.lit(1.0) / close if invert else close).alias("rate"))


def last_closed(asked: DataFrame, rows: DataFrame, by: list[str], cutoff: str, lower: str, take: list[str], seconds: int = 60) -> DataFrame:
    """asked with ``take`` of the last row that has closed by the cutoff and started at or after the lower bound."""
    target = asked.withColumn("__at", F.col(cutoff) - F.expr(f"INTERVAL {seconds} SECONDS"))
    met = asof_backward(target, rows.withColumnRenamed("bar_ts", "__row"), by, "__at", "__row", take)
    ok = F.col("asof_ts") >= F.col(lower)
    return met.select(*asked.columns, *[F.when(ok, F.col(c)).alias(c) for c in take])


def first_between(asked: DataFrame, rows: DataFrame, by: list[str], ts: str, start: str, end: str, take: list[str]) -> DataFrame:
    """asked with ``take`` of the key's first row from start to end, both included; of rows at one moment the
    first by ``take``. A look-up backwards on mirrored time, so it is bucketed as that is."""
    mirrored = lambda c: F.timestamp_micros(-F.unix_micros(F.to_timestamp_ltz(c))).cast("timestamp_ntz")
    one = rows.groupBy(*by, F.col(ts).alias("__t")).agg(F.min(F.struct(*take)).alias("__r")).select(*by, mirrored("__t").alias("__m"), F.col("__t"), "__r.*")
    met = asof_backward(asked.withColumn("__from", mirrored(start)), one, by, "__from", "__m", ["__t", *take])
    ok = F.col("__t") <= F.col(end)
    return met.select(*asked.columns, F.when(ok, F.col("__t")).alias("first_ts"), *[F.when(ok, F.col(c)).alias(c) for c in take])


def drawn_size(bars: DataFrame, most: int) -> DataFrame:
    """For each symbol the size at which its bars are drawn: as they are up to ``most`` candles, else the first of
    hours, four hours, days that fits, else weeks; and how many candles that makes."""
    day, hour = F.to_date("bar_ts"), F.date_trunc("hour", "bar_ts")
    four = F.struct(day, F.floor(F.hour("bar_ts") / 4))
    week = F.next_day(F.date_sub(day, 1), "Sun")
    n = bars.groupBy("symbol").agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(k) for k, c in (("1h", hour), ("4h", four), ("1D", day), ("1W", week))])
    size, candles = F.lit("1W"), F.col("1W")
    for name in ("1D", "4h", "1h"):
        size, candles = F.when(F.col(name) <= most, name).otherwise(size), F.when(F.col(name) <= most, F.col(name)).otherwise(candles)
    fits = F.col("n") <= most
    return n.select("symbol", F.when(fits, "as stored").otherwise(size).alias("size"), F.when(fits, F.col("n")).otherwise(candles).alias("candles"))


def placed(df: DataFrame, column: str, order: list[str], count: str, tie: str) -> DataFrame:
    """df with its place: by the column's values in the order given (others last), the larger count first.
    For reports of one row a check or an indicator: they are ordered as one group."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column)), F.lit(0)), F.lit(len(order) + 1))
    return df.withColumn("place", F.row_number().over(Window.orderBy(rank, F.col(count).desc(), tie)))


def group_names(labels: DataFrame, group: str, currency: str, label: str, order: str) -> DataFrame:
    """Name and key of each group of releases: the words that all labels share, as the first label has them, and
    "release"; all labels where they share none. Groups are the releases of one moment: some labels each."""
    g = labels.groupBy(group, currency).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(label).alias("l")))).alias("s"))
    g = g.withColumn("labels", F.transform("s", lambda x: x["l"]))
    words = lambda x: F.regexp_extract_all(x, F.lit("[A-Za-z]+"), 0)
    g = g.withColumn("first", words(F.get("labels", F.lit(0)))).withColumn("lower", F.transform("first", F.lower)).withColumn("all", F.transform("labels", lambda x: words(F.lower(x))))
    kept = F.filter(
        "first",
        lambda w, i: ~F.lower(w).isin("m", "y", "q") & (F.array_position("lower", F.lower(w)) == i + 1) & F.forall("all", lambda other: F.array_contains(other, F.lower(w))),
    )
    g = g.withColumn("kept", kept)
    name = F.when(F.size("kept") > 0, F.concat(F.array_join("kept", " "), F.lit(" release"))).otherwise(F.array_join("labels", " + "))
    stem = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return g.select(group, name.alias("name"), F.substring(F.concat(F.lower(currency), F.lit("_"), stem), 1, 100).alias("key"))
