"""The training-data queries that have SQL against it, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from reelquery.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(DATA + "/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    mine = sorted(repr([r[c] for c in columns]) for r in df.collect())
    theirs = sorted(repr(list(r)) for r in found.fetchall())
    assert mine == theirs and mine
