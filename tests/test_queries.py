"""Registered queries against the SQL that says the same, over the smallest tables.

TEST_ALL_QUERIES takes those of every module, else those whose operators no other test runs.
"""

import datetime as dt
import decimal
import os
from pathlib import Path

import pandas as pd
import pytest

from datakiln.queries import collected, pipelines, schemas, search

duckdb = pytest.importorskip("duckdb")
TABLES = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
QUERIES = collected() if os.environ.get("TEST_ALL_QUERIES") else schemas.QUERIES | pipelines.QUERIES | search.QUERIES


def plain(value):
    """One form for what the engines write differently: numbers to nine digits, stamps as text, no value as None."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list | tuple):
        return str([plain(v) for v in value])
    if value is None or value is pd.NA or value != value:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int | float | decimal.Decimal):
        return f"{float(value):.9g}"
    return str(value)[:19] if isinstance(value, dt.date) else str(value)


def rows_of(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def tables():
    if not TABLES.exists():
        pytest.skip(f"no tables at {TABLES}")
    held = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        held.execute(f"create view {path.stem} as select * from '{path}'")
    return held


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_says_what_its_sql_says(spark, tables, name):
    run, sql = QUERIES[name]
    got, want = run(spark, str(TABLES)).toPandas(), tables.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)
