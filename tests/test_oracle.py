"""Every query against its SQL on the smallest driver tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("PREPKIT_TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return str(pd.Timestamp(value))
    return value


def rows_of(columns, rows):
    return sorted([tuple(plain(v) for v in row) for row in rows],
                  key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_query_has_sql():
    assert set(entry.core_queries()) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.core_queries()))
def test_query_matches_sql(spark, duck, name):
    result = entry.queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    expected = duck.sql(entry.oracle_sql()[name])
    assert columns == sorted(expected.columns)
    order = [expected.columns.index(c) for c in columns]
    mine = rows_of(columns, [tuple(r) for r in result.select(*columns).collect()])
    theirs = rows_of(columns, [tuple(r[i] for i in order) for r in expected.fetchall()])
    assert mine == theirs


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
