"""Every registered query runs, and equals its SQL where it has one."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tidemill.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows(columns, values):
    """Column names in order, and the rows; nulls and NaN are alike."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], [[plain(r[i]) for i in order] for r in values]


def alike(a, b):
    """Equal, or doubles that differ by one step of the sixth digit: both sides round sums to it."""
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1.1e-6 + 1e-9 * abs(a))


def same(got, want):
    """Whether rows pair off; those without an equal partner are compared in order of what is no double."""
    left, right = Counter(map(str, got)), Counter(map(str, want))
    key = lambda r: str([x if not isinstance(x, float) else round(x, 3) for x in r])
    got = sorted((r for r in got if left[str(r)] != right[str(r)]), key=key)
    want = sorted((r for r in want if left[str(r)] != right[str(r)]), key=key)
    return len(got) == len(want) and all(len(x) == len(y) and all(map(alike, x, y)) for x, y in zip(got, want))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    values = [tuple(r) for r in got.collect()]
    if name in ORACLES:
        wanted = duck.execute(ORACLES[name])
        names, mine = rows(got.columns, values)
        other_names, others = rows([d[0] for d in wanted.description], wanted.fetchall())
        assert names == other_names and same(mine, others), (sorted(map(str, mine))[:5], sorted(map(str, others))[:5])


def test_entry_module(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_else_imports_the_text_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for p in glob.glob(f"{root}/tidemill/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in p:
            assert "tidemill.llm" not in open(p).read(), p
