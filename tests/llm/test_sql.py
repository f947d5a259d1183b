"""Queries of the training-data operators that have SQL give the SQL's rows."""

import glob
import os

import duckdb
import pytest

from strandframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns) and len(want)
    rows = lambda frame: sorted(tuple("null" if str(x) in ("nan", "<NA>", "None") else str(int(x)) if isinstance(x, float) else str(x) for x in r) for r in frame[names].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)
