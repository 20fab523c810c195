"""Every registered query runs, and equals its DuckDB SQL where it has one."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__
from tideline.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return value
    return round(float(value), 5) + 0.0


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in frame.collect())
    assert got == sorted(repr([plain(v) for v in r]) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_query_lets_dates_out(spark, sf):
    for name in ("scan_project", "two_clock_window", "panel_merge"):
        assert "date" not in dict(QUERIES[name](spark, sf).dtypes).values()
