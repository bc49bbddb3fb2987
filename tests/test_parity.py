"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry_points
from rejoinder.plans import oracles
from rejoinder.plans.queries import QUERIES as CORE

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

QUERIES = dict(CORE)
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(float(value))
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert mine == theirs
    assert mine


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry_points.entry(spark).columns[0] == "session_id"
