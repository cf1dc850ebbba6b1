"""Every registered query against its SQL on the smallest data folder."""

import math
import os

import duckdb
import pandas as pd
import pytest
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]

    def plain(value):
        if value is None or (isinstance(value, float) and math.isnan(value)) or value is pd.NA:
            return None
        return value.item() if hasattr(value, "item") else value

    values = [tuple(plain(v) for v in row) for row in frame.itertuples(index=False)]
    return sorted(values, key=repr)


def kind(column: pd.Series) -> str:
    """Type of a column; numbers with nulls are floats to one side and nullable whole numbers to the other."""
    return "number" if column.isna().any() and str(column.dtype) in ("float64", "Int64") else str(column.dtype)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [kind(got[c]) for c in sorted(got)] == [kind(want[c]) for c in sorted(want)] or not len(got)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
