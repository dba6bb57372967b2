"""Windows around releases and what price normally does at their hour of the week, for bars of any length.

Every symbol is cut into blocks of a year. A block gets the bars and releases that its look-ups can reach, and the last bar
before them; inside it ordered arrays are searched week by week for all releases at once, and a release that has
its weeks drops out of the search. So no window is spread over its 48 weeks, and a task's size depends on the bars and
release times of two years and a bounded number of moments, not on a symbol's history.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import clock
from tidemill.operators import asof

DAY = 86_400
MICROS = 1_000_000
BLOCK = 364 * DAY
SHIFTS = (0, -1, 1, -2, 2)


@dataclass(frozen=True)
class BaselineRule:
    weeks: int = 12
    lookback: int = 48
    least: int = 3


class Prices:
    """A symbol's bars in order of time (seconds), looked up as of a moment."""

    def __init__(self, starts: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> None:
        self.starts, self.opens, self.closes = starts, opens, closes

    def asof(self, seconds: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.starts, seconds, side="right") - 1
        return np.where(at >= 0, values[np.maximum(at, 0)], np.nan) if len(values) else np.full(len(seconds), np.nan)

    def returns(self, moments: np.ndarray, seconds: int) -> np.ndarray:
        """Log returns of the windows from moments (microseconds), or into them for windows before; NaN where there is none."""
        here, there = moments // MICROS, moments // MICROS + seconds
        a, b = self.asof(here, self.opens), self.asof(there, self.closes if seconds >= 0 else self.opens)
        fine = (a > 0) & (b > 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.log(b / a) if seconds >= 0 else np.log(a / b)
        return np.where(fine, r, np.nan)


def held(releases: np.ndarray, moments: np.ndarray, seconds: int) -> np.ndarray:
    """How many of the releases (sorted, microseconds) the windows at moments hold. After a moment both ends count; before it the
    window ends where the moment's own bar opens, so what is released then does not."""
    first, last = np.minimum(moments, moments + seconds * MICROS), np.maximum(moments, moments + seconds * MICROS)
    return np.searchsorted(releases, last, side="left" if seconds < 0 else "right") - np.searchsorted(releases, first, side="left")


def samples(prices: Prices, releases: np.ndarray, moments: np.ndarray, seconds: int, rule: BaselineRule) -> np.ndarray:
    """For each moment its baseline returns, nearest week first, NaN behind them."""
    found, n = np.full((len(moments), rule.weeks), np.nan), np.zeros(len(moments), int)
    own = np.searchsorted(releases, moments, side="right") - np.searchsorted(releases, moments, side="left")
    allowed = held(releases, moments, seconds) - (own if seconds >= 0 else 0)
    first = prices.starts[0] * MICROS if len(prices.starts) else np.iinfo(np.int64).max
    for week in range(1, rule.lookback + 1):
        # moments before the first bar have no price, whatever their shift
        open_ = np.flatnonzero((n < rule.weeks) & (moments + (max(SHIFTS) - 7 * week) * DAY * MICROS >= first))
        if not len(open_):
            break
        for shift in SHIFTS:
            m = moments[open_] + (shift - 7 * week) * DAY * MICROS
            fits = (m + max(seconds, 0) * MICROS < moments[open_]) & (m + min(seconds, 0) * MICROS >= first)
            if shift:
                fits &= (m // (DAY * MICROS) + 3) % 7 < 5
            fits[fits] = held(releases, m[fits], seconds) <= allowed[open_[fits]]
            value = np.full(len(m), np.nan)
            value[fits] = prices.returns(m[fits], seconds)
            hit = np.isfinite(value)
            at = open_[hit]
            found[at, n[at]] = value[hit]
            n[at] += 1
            open_ = open_[~hit]
    return found


def _reachable(seconds: Column, back: int, ahead: int) -> Column:
    """The blocks whose look-ups, from back seconds before them to ahead seconds behind, can reach a moment."""
    return F.explode(F.sequence(F.floor((seconds - ahead) / BLOCK), F.floor((seconds + back) / BLOCK)))


def range_tables(values: np.ndarray, longest: int, pick) -> list[np.ndarray]:
    """Level j holds the extreme of the 2**j values from each place on, as far as windows of longest values need it."""
    levels = [values]
    while (2 << (len(levels) - 1)) <= min(longest, len(values)):
        half = 1 << (len(levels) - 1)
        levels.append(pick(levels[-1][:-half], levels[-1][half:]))
    return levels


def range_extreme(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray, pick) -> np.ndarray:
    """The extreme of the values from first to before last, NaN for empty stretches."""
    out, n = np.full(len(first), np.nan), last - first
    for j, level in enumerate(levels):
        at = np.flatnonzero((n >= 1 << j) & ((n < 2 << j) | (j + 1 == len(levels))))
        out[at] = pick(level[first[at]], level[last[at] - (1 << j)])
    return out


#: Rows that a group answers.
MOMENTS = 200_000


def _dealt(bars: DataFrame, asked: DataFrame, back: int, ahead: int, columns: list[str], most: int) -> DataFrame:
    """Bars and rows of asked (symbol, kind, t, indicator, seconds) by symbol, block of a year and part: the bars that look-ups reach, and
    the last one before them. Kind 0 is a bar; kind 1 is a day of an indicator's releases, in ``times``. Moments (kind 2) of a block are
    dealt to parts of about ``most`` rows, and each part gets the block's bars and releases."""
    null = [F.lit(None).cast("double").alias(c) for c in columns]
    no_times = F.lit(None).cast("array<bigint>").alias("times")
    moments = asked.withColumn("block", F.explode(F.sequence(F.floor((F.col("t") / MICROS - F.col("ahead")) / BLOCK), F.floor((F.col("t") / MICROS + F.col("back")) / BLOCK))))
    wanted = moments.where("kind = 2").groupBy("symbol", "block").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    own = moments.where("kind = 2").join(wanted, ["symbol", "block"])
    own = own.select("symbol", "block", "kind", "t", "indicator", "seconds", *null, no_times, F.pmod(F.xxhash64("indicator", "t", "seconds"), F.col("parts")).cast("int").alias("part"))
    known = moments.where("kind = 1").groupBy("symbol", "block", "kind", "indicator", F.floor(F.col("t") / (DAY * MICROS)).alias("day")).agg(F.collect_list("t").alias("times"))
    known = known.select("symbol", "block", "kind", F.lit(0).cast("long").alias("t"), "indicator", F.lit(None).cast("int").alias("seconds"), *null, "times")
    plain = bars.select("symbol", "bar_ts", *[F.col(c).cast("double").alias(c) for c in columns])
    at = clock.epoch(F.col("bar_ts"))
    row = lambda block: (
        "symbol", block.alias("block"), F.lit(0).alias("kind"), clock.epoch_micros(F.col("bar_ts")).alias("t"), F.lit(None).cast("string").alias("indicator"), F.lit(None).cast("int").alias("seconds"), *columns, no_times,
    )
    near = plain.select(*row(_reachable(at, back, ahead)))
    starts = wanted.select("symbol", "block", clock.at_seconds(F.col("block") * BLOCK - back).alias("from_ts"))
    last = asof.asof_backward(starts, plain, ["symbol"], "from_ts", "bar_ts", ["bar_ts", *columns], bucket_micros=30 * asof.DAY)
    before = last.where("bar_ts is not null").select(*row(F.col("block")))
    shared = near.union(before).union(known).join(wanted, ["symbol", "block"])
    return shared.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").unionByName(own)


def _groups(mixed: DataFrame):
    """A group for each symbol, block and part, in as many tasks as a shuffle has: they compute much on few bytes, and adaptive execution
    would put them together by their bytes."""
    n, key = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["symbol", "block", "part"]
    return mixed.repartition(n, *key).groupBy(*key)


def _moments(rows: DataFrame, kind: int, seconds: Column, back: int = 0, ahead: int = 0) -> DataFrame:
    return rows.select("symbol", F.lit(kind).alias("kind"), clock.epoch_micros(F.col("ts")).alias("t"), "indicator", seconds.cast("int").alias("seconds"), F.lit(back).alias("back"), F.lit(ahead).alias("ahead"))


def _prices(group: pd.DataFrame) -> tuple[Prices, pd.DataFrame]:
    bar = group[group.kind == 0].sort_values("t").drop_duplicates("t")
    return Prices(bar.t.to_numpy() // MICROS, bar.open.to_numpy(), bar.close.to_numpy()), bar


def measured(bars: DataFrame, asked: DataFrame, ladder: dict[str, int]) -> DataFrame:
    """asked (indicator, symbol, ts; equal rows count each) with a row for every rung: horizon, seconds, ret, n_bars, realized_vol,
    anchor, top and bottom of the closed window of bars.

    ret is the log return from the price before the moment, or into it for rungs before. Moments before a symbol's first bar have no
    anchor and no bars.
    """
    reach = max(abs(s) for s in ladder.values()) + 2 * DAY
    mixed = _dealt(bars, _moments(asked.distinct(), 2, F.lit(None)), reach, reach, ["open", "high", "low", "close"], max(1, MOMENTS // len(ladder)))

    def measure(group: pd.DataFrame) -> pd.DataFrame:
        prices, bar = _prices(group)
        starts = bar.t.to_numpy()
        with np.errstate(invalid="ignore", divide="ignore"):
            squares = np.log(bar.close.to_numpy() / bar.open.to_numpy()) ** 2
        sums = np.concatenate([[0], np.cumsum(np.where(np.isfinite(squares), squares, 0).astype(np.longdouble))])
        own = group[group.kind == 2]
        t = own.t.to_numpy()
        anchor = prices.asof(t // MICROS, prices.opens)
        known = np.isfinite(anchor)
        spans = {}
        for name, seconds in ladder.items():
            a, z = np.minimum(t, t + seconds * MICROS), np.maximum(t, t + seconds * MICROS)
            first, last = np.searchsorted(starts, a, side="left"), np.searchsorted(starts, z, side="right")
            spans[name] = first, np.where(known, last, first)
        longest = max((int((z - a).max(initial=0)) for a, z in spans.values()), default=0)
        tops, bottoms = range_tables(bar.high.to_numpy(), longest, np.maximum), range_tables(bar.low.to_numpy(), longest, np.minimum)
        null = lambda x: pd.Series(x, index=own.index).astype(object).where(np.isfinite(x), None)
        out = []
        for name, (first, last) in spans.items():
            out.append(pd.DataFrame({
                "indicator": own.indicator, "symbol": own.symbol, "t": t, "horizon": name, "seconds": ladder[name], "ret": null(prices.returns(t, ladder[name])), "n_bars": last - first,
                "realized_vol": np.sqrt(np.maximum((sums[last] - sums[first]).astype(float), 0.0)), "anchor": null(anchor),
                "top": null(range_extreme(tops, first, last, np.maximum)), "bottom": null(range_extreme(bottoms, first, last, np.minimum)),
            }))
        return pd.concat(out)

    kind = "indicator string, symbol string, t long, horizon string, seconds int, ret double, n_bars long, realized_vol double, anchor double, top double, bottom double"
    found = _groups(mixed).applyInPandas(measure, kind)
    return asked.withColumn("t", clock.epoch_micros(F.col("ts"))).join(found, ["indicator", "symbol", "t"]).drop("t")


def matched_baseline(bars: DataFrame, releases: DataFrame, pairs: DataFrame, windows: DataFrame, rule: BaselineRule = BaselineRule()) -> DataFrame:
    """windows (indicator, symbol, ts, seconds, usable) with baseline_mean, baseline_sd, baseline_abs_mean and baseline_n.

    The same hour of the preceding weeks, at most ``weeks`` of them from ``lookback``. A moment whose window holds more of the
    indicator's releases than the event's own does besides the event is replaced by the same hour one day before or
    after, then two (not on weekends); no window reaches the event.
    """
    reach = 31 * DAY
    back, ahead = (7 * rule.lookback + 3) * DAY + reach, reach
    asked = _moments(windows.where("usable").select("symbol", "indicator", "ts", "seconds").distinct(), 2, F.col("seconds"))
    known = _moments(releases.select("indicator", "ts").join(pairs.select("indicator", "symbol"), "indicator"), 1, F.lit(None), back, ahead)
    mixed = _dealt(bars, asked.union(known), back, ahead, ["open", "close"], MOMENTS)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        prices, _ = _prices(group)
        times = {k: np.sort(np.concatenate(g.times.to_list())) for k, g in group[group.kind == 1].groupby("indicator")}
        out = []
        for (indicator, seconds), g in group[group.kind == 2].groupby(["indicator", "seconds"]):
            moments = g.t.to_numpy()
            v = samples(prices, times.get(indicator, np.zeros(0, np.int64)), moments, int(seconds), rule)
            n = np.isfinite(v).sum(axis=1)
            enough = n >= rule.least
            v = np.where(np.isfinite(v), v, 0.0)
            safe = np.maximum(n, 1)
            mean = v.sum(axis=1) / safe
            used = np.arange(rule.weeks) < n[:, None]
            sd = np.sqrt((np.where(used, v - mean[:, None], 0.0) ** 2).sum(axis=1) / np.maximum(n - 1, 1))
            nulls = lambda x: pd.Series(x).where(pd.Series(enough)).astype(object).where(pd.Series(enough), None)
            out.append(pd.DataFrame({
                "indicator": indicator, "symbol": g.symbol.iloc[0], "t": moments, "seconds": int(seconds), "baseline_n": n,
                "baseline_mean": nulls(mean), "baseline_sd": nulls(sd), "baseline_abs_mean": nulls(np.abs(v).sum(axis=1) / safe),
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=["indicator", "symbol", "t", "seconds", "baseline_n", "baseline_mean", "baseline_sd", "baseline_abs_mean"])

    kind = "indicator string, symbol string, t long, seconds int, baseline_n int, baseline_mean double, baseline_sd double, baseline_abs_mean double"
    stats = _groups(mixed).applyInPandas(search, kind)
    named = windows.withColumn("t", clock.epoch_micros(F.col("ts"))).join(stats, ["indicator", "symbol", "t", "seconds"], "left").drop("t")
    return named.withColumn("baseline_n", F.coalesce("baseline_n", F.lit(0)))
