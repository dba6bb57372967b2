from __future__ import annotations

import io
import json
import lzma
import struct
import zipfile
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.sources import feeds, store

T0 = datetime(2024, 9, 6, 12, 30)


def test_weekly_feed(spark):
    entries = [
        {"title": "CPI", "country": "USD", "date": "2024-09-06T08:30:00-04:00", "impact": "High", "forecast": "3.2%", "previous": "227K"},
        {"title": "CPI", "country": "XXX", "date": "2024-09-06T08:30:00-04:00"},
        {"title": "GDP", "country": "eur", "date": "2024-09-06T08:30:00"},
        {"title": "", "country": "USD", "date": "2024-09-06T08:30:00Z"},
    ]
    raw = spark.createDataFrame([(json.dumps(entries), datetime(2024, 9, 1)), (json.dumps(entries[:1]), datetime(2024, 9, 7))], "payload string, captured_at timestamp")
    got = feeds.weekly_feed(raw).collect()
    assert [(r["currency"], r["scheduled_ts"], r["importance"], float(r["forecast"]), float(r["previous"])) for r in got] == [("USD", T0, 3, 3.2, 227000.0)] * 2
    assert sorted(r["forecast_target"] for r in got) == ["forecast_point_in_time", "forecast_stored"]
    assert got[0]["reference_period"] == "release:2024-09-06T12:30" and got[0]["event_key"] == "USD|CPI"


def test_terminal_export(spark, tmp_path):
    head = "event_id;event_name;currency;importance;server_time;server_gmt_offset;period;revision;actual_value;forecast_value;prev_value;revised_prev_value"
    rows = ["7;CPI;USD;HIGH;2024.09.06 15:30;10800;2024.08.01 00:00:00;1;3200000;-9223372036854775808;;NULL", ";Talk;EUR;2;1725625800;0;0;;-100000;1;2;3", "9;CPI;ZZZ;HIGH;2024.09.06 15:30;0;0;0;1;1;1;1", "9;Bad;USD;HIGH;never;0;0;0;1;1;1;1"]
    path = tmp_path / "calendar.csv"
    path.write_text("\n".join([head, *rows]))
    got = {r["event"]: r for r in feeds.terminal_claims(feeds.terminal_export(spark, str(path))).collect()}
    assert set(got) == {"CPI", "Talk"}
    a, b = got["CPI"], got["Talk"]
    assert (a["release_ts"], a["reference_period"], a["period_start"], a["revision"], float(a["actual"]), a["forecast"], a["prev"], a["revised_prev"], a["importance"]) == (T0, "2024-08", date(2024, 8, 1), 1, 3.2, None, None, None, 3)
    assert (b["release_ts"], b["event_key"], b["reference_period"], float(b["actual"]), b["importance"]) == (T0, "EUR|Talk", "release:2024-09-06T12:30", -0.1, 2)
    path.write_text("event_id;event_name\n1;2")
    with pytest.raises(ValueError, match="missing columns: actual_value"):
        feeds.terminal_export(spark, str(path))


def test_period_series(spark):
    doc = {"series": {"docs": [{"provider_code": "A", "dataset_code": "B", "series_code": "C", "series_name": "n", "period": ["2024-Q1", "2024-Q2"], "value": [1.5, "NA"]}, {"series_code": "D", "period": ["2024"], "value": [1]}]}}
    series = spark.createDataFrame([("A/B/C", "usd")], "series_id string, currency string")
    got = feeds.period_series(spark.createDataFrame([(json.dumps(doc),)], "payload string"), series).collect()
    assert [(r["currency"], r["reference_period"], r["period_start"], float(r["actual"])) for r in got] == [("USD", "2024-Q1", date(2024, 1, 1), 1.5)]


def test_embedded_arrays(spark):
    page = 'x days: = [{"a": "odd ] \\" [", "b": [1, [2]]}]; rest ]'
    got = feeds.embedded_arrays(spark.createDataFrame([(page,), ("none",), (None,)], "page string"), "days:").collect()
    assert [r["payload"] for r in got] == ['[{"a": "odd ] \\" [", "b": [1, [2]]}]', None, None]


def test_zipped_and_packed_files(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("DAT.csv", "20240906 073000;1.1;1.2;1.0;1.15;0\n")
    got = feeds.zipped_minutes(spark.createDataFrame([("s/HISTDATA_EURUSD_M1_202409.zip", z.getvalue())], "path string, content binary")).collect()
    assert [(r["symbol"], r["bar_ts"], r["high"]) for r in got] == [("EURUSD", T0, 1.2)]
    pack = lambda raw: lzma.compress(raw, format=lzma.FORMAT_ALONE)
    candles = struct.pack(">5if", 60, 110000, 110500, 109000, 111000, 5.0) + struct.pack(">5if", 120, 1, 1, 1, 1, 0.0)
    files = spark.createDataFrame([("EURUSD", T0, pack(candles)), ("USDJPY", T0, b"")], "symbol string, start timestamp_ntz, content binary")
    got = feeds.packed_candles(files).collect()
    assert [(r["bar_ts"], r["open"], r["high"], r["low"], r["close"]) for r in got] == [(T0 + timedelta(minutes=1), 1.1, 1.11, 1.09, 1.105)]
    ticks = spark.createDataFrame([("USDJPY", T0, pack(struct.pack(">3I2f", 1500, 150010, 150000, 1.0, 2.0)))], "symbol string, start timestamp_ntz, content binary")
    assert [(r["ts"], r["ask"], r["bid"]) for r in feeds.packed_ticks(ticks).collect()] == [(T0 + timedelta(milliseconds=1500), 150.01, 150.0)]


def test_month_store(spark, tmp_path):
    path = str(tmp_path / "bars")
    make = lambda rows: spark.createDataFrame([("X", "s", "h1", t, p, p, p, p) for t, p in rows], "symbol string, source string, timeframe string, bar_ts timestamp_ntz, open double, high double, low double, close double")
    first = make([(datetime(2024, 1, 31, 23), 1.0), (datetime(2024, 2, 1, 0), 2.0)])
    for _ in range(2):
        store.upsert_months(spark, path, first)
    store.upsert_months(spark, path, make([(datetime(2024, 2, 1, 0), 3.0), (datetime(2024, 2, 1, 1), 4.0)]))
    got = store.read_range(spark, path, "X", "s", "h1", "2024-01-31 23:00:00", "2024-02-01 01:00:00").orderBy("bar_ts").collect()
    assert [r["close"] for r in got] == [1.0, 3.0, 4.0] and got[0]["tick_count"] is None
    plan = store.read_range(spark, path, "X", "s", "h1", "2024-02-01 00:00:00", "2024-02-01 01:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan


def test_ticks_survive_compaction(spark):
    t = spark.createDataFrame([("X", T0, 1.10001, 1.10009, 0), ("X", T0, 1.2, 1.3, 1), ("X", T0, 1.2, 1.30001, 3)], "symbol string, ts timestamp_ntz, bid double, ask double, flag int")
    got = sorted((r["bid"], r["ask"]) for r in store.expand_ticks(store.compact_ticks(t, 100_000.0), 100_000.0).collect())
    assert got == [(1.10001, 1.10009), (1.2, 1.30001)]


def test_ledgers(spark):
    ticks = spark.createDataFrame([("X", T0)] * 3 + [("Y", T0)], "symbol string, ts timestamp_ntz")
    minutes = spark.createDataFrame([("X", T0, 3), ("Z", T0, 1)], "symbol string, bar_ts timestamp_ntz, tick_count int")
    assert {r["symbol"] for r in store.stale_days(ticks, minutes).collect()} == {"Y", "Z"}
    wanted = spark.createDataFrame([("X", 1), ("X", 2), ("X", 3)], "symbol string, month int")
    ledger = spark.createDataFrame([("X", 1, 95, 100), ("X", 2, 10, 100)], "symbol string, month int, bar_count int, expected int")
    assert {r["month"] for r in store.months_to_fetch(wanted, ledger).collect()} == {2, 3}
    runs = spark.createDataFrame([("a", i) for i in range(5)], "source string, started int").withColumn("x", F.lit(1))
    assert {r["started"] for r in store.keep_latest(runs, "source", "started", 2).collect()} == {0, 1, 2}


def test_pages_go_on_to_the_next_marker(spark):
    page = 'days: [oops; days: no array; days: [1, [2]] tail'
    got = feeds.embedded_arrays(spark.createDataFrame([(page,)], "page string"), "days:").first()
    assert got["payload"] == "[1, [2]]"


def test_parts_are_replaced_and_logs_grow(spark, tmp_path):
    path, log = str(tmp_path / "curves"), str(tmp_path / "log")
    frame = lambda rows: spark.createDataFrame(rows, "version string, indicator int, n int")
    store.replace_parts(frame([("a", 1, 1), ("a", 1, 2), ("a", 2, 3)]), path, ["version", "indicator"])
    store.replace_parts(frame([("a", 1, 9), ("b", 1, 4)]), path, ["version", "indicator"])
    got = spark.read.parquet(path).collect()
    assert sorted((r["version"], r["indicator"], r["n"]) for r in got) == [("a", 1, 9), ("a", 2, 3), ("b", 1, 4)]
    for n in (1, 2):
        store.append_log(frame([("a", n, n)]), log)
    assert sorted(r["n"] for r in spark.read.parquet(log).collect()) == [1, 2]
    assert [r["sample"] for r in store.preview(frame([("b", 2, None), ("a", 1, 1)]), ["version"]).collect()] == ['{"version":"a","indicator":1,"n":1}', '{"version":"b","indicator":2,"n":null}']
