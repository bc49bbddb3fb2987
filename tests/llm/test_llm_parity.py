"""The registered queries of the subpackage against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import pytest

from rejoinder.llm.oracles import ORACLES
from rejoinder.llm.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert mine == theirs and mine
