"""Every query with SQL gives the SQL's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandframe import queries
from strandframe.operators import qc

#: Their SQL lists what is drawn for the table sizes of another scale.
SIZED = {"sample_fraction", "sample_exact", "sample_pairs_fraction", "sample_pairs_exact", "length_distribution"}


def rows(frame):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT", "None"):
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return str(bool(x))
        return repr(round(float(x), 6)) if not isinstance(x, str) else x

    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(tuple(map(value, r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - SIZED))
def test_query(spark, sf, duck, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(queries.ORACLE_SQL[name]).df())


def test_contaminants_of_all_keys(spark, sf, duck, monkeypatch):
    """The SQL has no cap, so keys beyond any cap count too."""
    monkeypatch.setattr(qc.sequence_keys, "__defaults__", (50,))
    assert rows(queries.QUERIES["contaminant_hits"](spark, sf).toPandas()) == rows(duck.execute(queries.ORACLE_SQL["contaminant_hits"]).df())


def test_tiles_of_every_read(spark, tmp_path):
    """The SQL takes no sample, so reads beyond the first 10,000 count too."""
    con = duckdb.connect()
    con.execute(f"copy (select range doc_id, 'a' source from range(12000)) to '{tmp_path}/documents.parquet' (format parquet)")
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    assert rows(queries.QUERIES["tile_quality"](spark, str(tmp_path)).toPandas()) == rows(con.execute(queries.ORACLE_SQL["tile_quality"]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
