from __future__ import annotations

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from paperlane.plans import registry

NAMES = sorted(registry.queries())


def plain(value):
    if value is None or value is pd.NA or value != value:
        return None
    if isinstance(value, bool):
        return str(value)
    return round(float(value), 6) if isinstance(value, (int, float)) or hasattr(value, "dtype") and value.dtype.kind in "if" else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, duck, name):
    got = registry.queries()[name](spark, small)
    if name not in registry.oracle_sql():
        first = rows(got.toPandas())  # no result to compare with: at least two runs give the same rows
        assert got.columns and first == rows(registry.queries()[name](spark, small).toPandas())
        return
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
