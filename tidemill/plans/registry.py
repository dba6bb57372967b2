"""How queries get their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


# Common table expressions of the SQL side: the same views as in sources.tables
TICKS = """ticks AS (SELECT event_id AS id, event_type AS symbol, ts, 100.0::DOUBLE + value AS bid,
  100.0::DOUBLE + value + (CAST(json_extract_string(props, '$.k') AS INT) + 1) / 1000.0::DOUBLE AS ask FROM events)"""
H1 = (
    TICKS
    + """, h1 AS (SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS bar_ts, first(bid ORDER BY ts, id) AS open, max(bid) AS high,
  min(bid) AS low, last(bid ORDER BY ts, id) AS close, avg(ask - bid) AS spread_mean, last(ask - bid ORDER BY ts, id) AS spread_last,
  count(*) AS tick_count FROM ticks GROUP BY ALL)"""
)
D1 = """deals AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate::TIMESTAMP AS bar_ts, l_extendedprice / l_quantity AS price, l_quantity AS volume,
  l_orderkey AS k1, l_partkey AS k2, l_suppkey AS k3, l_linenumber AS k4, l_extendedprice AS k5 FROM lineitem),
d1 AS (SELECT symbol, bar_ts, first(price ORDER BY k1, k2, k3, k4, k5) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY k1, k2, k3, k4, k5) AS close, sum(volume) AS volume, count(*) AS tick_count FROM deals GROUP BY ALL)"""
RELEASES = """days AS (SELECT o_orderpriority AS indicator, o_orderdate::TIMESTAMP AS ts, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(24,6) AS actual
  FROM orders GROUP BY ALL),
releases AS (SELECT indicator, ts, substr(indicator, 1, 1)::INT AS importance, actual,
  avg(actual::DOUBLE) OVER (PARTITION BY indicator ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS forecast,
  lag(actual) OVER (PARTITION BY indicator ORDER BY ts) AS previous FROM days)"""
CLAIMS = """claims AS (SELECT substr(o_orderpriority, 1, 1) || '|' || strftime(o_orderdate, '%Y-%m-%d') AS identity, 'actual_first_print' AS field,
  CASE o_orderstatus WHEN 'F' THEN 'agency_schedule' WHEN 'O' THEN 'mt5_calendar' WHEN 'P' THEN 'forexfactory_pages' END AS source,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS rank, o_orderkey AS seq, o_totalprice::DECIMAL(24,6) AS value FROM orders)"""
PAIRS = """pairs(symbol, indicator) AS (VALUES ('AF','1-URGENT'),('AF','2-HIGH'),('AO','2-HIGH'),('AO','3-MEDIUM'),('NF','3-MEDIUM'),
  ('NF','4-NOT SPECIFIED'),('NO','4-NOT SPECIFIED'),('NO','5-LOW'),('RF','5-LOW'),('RF','1-URGENT'),('RO','1-URGENT'),('RO','3-MEDIUM'))"""
NY = "timezone('America/New_York', timezone('UTC', {0}))"
FROM_NY = "timezone('UTC', timezone('America/New_York', {0}))"
