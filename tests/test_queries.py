"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from reelquery.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(DATA + "/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = sql.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    theirs = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in found.fetchall())
    assert mine == theirs and mine
