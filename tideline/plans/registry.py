"""Where queries and their DuckDB SQL are registered under one name."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The synthetic event table as a tape with two clocks, for the SQL side; ``sources.tape`` is the Spark side.
TAPE = """tape AS (
  SELECT event_id AS seq, event_type AS asset, user_id AS contract, value AS premium, ts::TIMESTAMP AS executed_at,
    ts::TIMESTAMP + to_seconds((event_id * 7919) % 400) AS created_at, epoch_us(ts::TIMESTAMP) AS executed_us,
    epoch_us(ts::TIMESTAMP) + ((event_id * 7919) % 400) * 1000000 AS created_us, ts::DATE AS session_date,
    CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS direction,
    (props::JSON ->> 'k')::INTEGER AS strike, event_id % 2 = 0 AS is_call FROM events)"""
#: Hourly bars of the tape, and the dense hourly grid with the last close carried forward.
BARS = TAPE + """, bars AS (
  SELECT asset, session_date, hour(executed_at) AS bar, min_by(premium, executed_us) AS open, max(premium) AS high,
    min(premium) AS low, max_by(premium, executed_us) AS close, count(*) AS volume FROM tape GROUP BY 1, 2, 3)"""
GRID = BARS + """, cells AS (
  SELECT asset, session_date, bar FROM (SELECT DISTINCT asset, session_date FROM bars) CROSS JOIN (SELECT unnest(range(24)) AS bar)),
grid AS (
  SELECT asset, session_date, bar, b.close IS NOT NULL AS observed,
    last_value(b.close IGNORE NULLS) OVER w AS close, b.high, b.low, coalesce(b.volume, 0) AS volume
  FROM cells LEFT JOIN bars b USING (asset, session_date, bar)
  WINDOW w AS (PARTITION BY asset, session_date ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
returns AS (
  SELECT *, ln(close / lag(close) OVER (PARTITION BY asset, session_date ORDER BY bar)) AS r FROM grid)"""


def query(name: str, sql: str | None = None, dates: list[str] | None = None):
    """Register a query, and its SQL where SQL can express it. Columns of dates are returned as ISO text on both
    sides, since clients show dates in different types."""

    def keep(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            frame = function(spark, sf_dir)
            return frame.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else frame

        QUERIES[name] = functools.update_wrapper(run, function)
        if sql is not None:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'{c}::VARCHAR AS {c}' for c in dates)}) FROM ({sql})" if dates else sql
        return function

    return keep


def r6(column: Column | str) -> Column:
    """Six decimals, so that sums in another order compare equal."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6) + F.lit(0.0)


def s6(sql: str) -> str:
    """The same in SQL."""
    return f"(round({sql}, 6) + 0.0)"
