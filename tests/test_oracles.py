"""Every registered query against its SQL twin on the smallest given tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="given tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    if isinstance(value, str) or isinstance(value, bool):
        return value
    number = float(value)
    return None if math.isnan(number) else number


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(plain, row))) for row in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, database, name):
    found = contract.queries()[name](spark, str(TABLES)).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert len(found) > 0
        return
    wanted = database.execute(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns and frame.count() > 0
