"""Growing files and late ticks, over several triggers with restarts between."""

from __future__ import annotations

import io
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.streaming import days, tail

TICK = "id long, symbol string, ts_ms long, bid double, ask double"


def test_parts_of_a_file_give_each_line_once():
    rng = random.Random(1)
    for text in (b"", b"\n\n", b"no end", "\n".join("x" * rng.randint(0, 40) for _ in range(200)).encode() + b"\n", b"y" * 500 + b"\n" + b"z\n"):
        stop = tail.whole_lines(io.BytesIO(text), len(text))
        assert stop == text.rfind(b"\n") + 1
        for size in (1, 7, 64, 10_000):
            got = [x for _, a, z, begin in tail.parts_of({}, {"f": stop}, size) for x in tail.lines_of(io.BytesIO(text[:stop]), a, z, begin)]
            assert got == [x for x in text[:stop].split(b"\n") if x]
    assert tail.parts_of({"a": 5, "b": 9, "gone": 3}, {"a": 8, "b": 4}, 100) == [("a", 5, 8, 5), ("b", 0, 4, 0)]


@pytest.fixture()
def growing(spark, tmp_path):
    spark.dataSource.register(tail.GrowingCsv)
    folder = tmp_path / "live"
    folder.mkdir()

    def trigger():
        stream = spark.readStream.format("growing_csv").schema(TICK).option("partBytes", "50").load(str(folder))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        there = os.path.isdir(tmp_path / "out")
        return sorted((tuple(r) for r in spark.read.schema(TICK).parquet(str(tmp_path / "out")).collect()), key=str) if there else []

    return folder, trigger


def test_a_growing_file_is_read_once(growing):
    folder, trigger = growing
    line = lambda i: f"{i},EUR,{1000 + i},1.{i},1.{i}5"
    row = lambda i: (i, "EUR", 1000 + i, float(f"1.{i}"), float(f"1.{i}5"))
    day = folder / "2024-03-04.csv"
    day.write_text("id,symbol,ts_ms,bid,ask\n" + line(1) + "\n" + line(2) + "\n" + line(3)[:7])  # the last line is cut
    assert trigger() == sorted([row(1), row(2)], key=str)
    assert trigger() == sorted([row(1), row(2)], key=str)  # a restart with nothing new
    with day.open("a") as f:
        f.write(line(3)[7:] + "\n" + line(4) + "\n5,EUR,bad\n")
    (folder / "2024-03-05.csv").write_text(line(6) + "\r\n")
    (folder / "notes.txt").write_text("not a feed\n")
    want = [row(1), row(2), row(3), row(4), (5, "EUR", None, None, None), row(6)]
    assert trigger() == sorted(want, key=str)
    day.write_text(line(7) + "\n")  # replaced by a shorter file: read from its start
    assert trigger() == sorted([*want, row(7)], key=str)


def test_late_ticks_replace_their_day_once(spark, tmp_path):
    rng, start = random.Random(3), datetime(2024, 3, 4, 22)
    ticks = [(i, rng.choice("AB"), start + timedelta(seconds=rng.randint(0, 9 * 3600)), 1 + i / 100, 1 + i / 100 + 0.01) for i in range(300)]
    kind = "id long, symbol string, ts timestamp_ntz, bid double, ask double"
    broken = [(900, None, start, 1.0, 1.1), (901, "A", None, 1.0, 1.1), (902, "A", start, None, 1.1), (903, "A", start, 1.2, 1.1), (904, "B", start, float("nan"), 1.1), (905, "B", start, -1.0, 1.1)]
    parts = [ticks[0::3] + broken, ticks[1::3], [], ticks[2::3]]
    table = days.Days(spark, str(tmp_path / "days"), 3600)
    sizes = []
    for n, part in enumerate(parts):
        table.apply(spark.createDataFrame(part, kind), n)
        if n == 1:  # the batch runs again after a failure, in another order
            before = sorted(map(tuple, table.candles().collect())), sorted(map(tuple, table.frames().collect()))
            table.apply(spark.createDataFrame(part[::-1], kind), n)
            assert before == (sorted(map(tuple, table.candles().collect())), sorted(map(tuple, table.frames().collect())))
        sizes.append(table.frames().where(F.col("batch") == n).count())
    from tidemill.operators.bars import ticks_to_bars

    want = sorted(map(tuple, ticks_to_bars(spark.createDataFrame(ticks, kind), 3600).select(*days.CANDLE).collect()))
    assert sorted(map(tuple, table.candles().select(*days.CANDLE).collect())) == want
    assert sorted(map(tuple, days.added_up(table.frames()).select(*days.CANDLE).collect())) == want
    assert sizes[2] == 0 and all(sizes[n] for n in (0, 1, 3))


def test_months_are_computed_again_only_when_they_change(spark, tmp_path):
    from tidemill.sources.months import MonthStore

    rows = [(f"2024-0{m}", k, float(k * m)) for m in (1, 2, 3) for k in range(20)] + [(None, 1, 1.0)]
    kind = "m string, k int, v double"
    store, runs = MonthStore(spark, str(tmp_path / "months")), []

    def derive(own):
        runs.append(sorted({r["m"] for r in own.select("m").distinct().collect()}))
        return own.groupBy(F.col("m").alias("month")).agg(F.sum("v").alias("total"))

    def refresh(data):
        return store.refresh(spark.createDataFrame(data, kind), F.col("m"), derive)

    read = lambda: {r["month"]: r["total"] for r in store.read("total double").collect()}
    assert store.read("total double").count() == 0 and refresh([]) == []
    assert refresh(rows) == ["2024-01", "2024-02", "2024-03"] and store.latest() == 1
    files = sorted(p for p in (tmp_path / "months").rglob("*") if p.is_file())
    assert refresh(rows[::-1]) == [] and files == sorted(p for p in (tmp_path / "months").rglob("*") if p.is_file())  # in another order: nothing to do
    rows[25] = ("2024-02", 5, 11.5)
    assert refresh(rows) == ["2024-02"] and runs[-1] == ["2024-02"]
    assert read() == {m: sum(v for x, _, v in rows if x == m) for m in ("2024-01", "2024-02", "2024-03")}
    assert store.sweep() == 1 and store.sweep() == 0 and len(read()) == 3
    assert refresh([r for r in rows if r[0] != "2024-01"]) == [] and sorted(read()) == ["2024-02", "2024-03"]
    (tmp_path / "months" / "manifest" / "n=9").mkdir()  # a manifest that was never finished
    assert sorted(read()) == ["2024-02", "2024-03"]
