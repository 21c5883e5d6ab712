"""Every query with SQL against DuckDB, on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

NAMES = [n for n in entry.oracle_sql() if not n.startswith("op")]


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)[:10]
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(value(r[i]) for i in order)) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), columns)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith(("op", "pipeline"))])
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
