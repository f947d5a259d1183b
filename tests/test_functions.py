"""Functions by name in SQL text."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions import reads as R
from strandframe.functions import sql
from strandframe.operators import transform


def test_functions_in_sql_text(spark):
    assert {"norm_id", "revcomp", "names_match", "tail_kept", "mate_overlap"} <= set(sql.register(spark))
    headers = ["r/1", "r/2", "r", "r 1:N:0", "r 2:N:0", "r\tx/1", "r  y/2", "", " x", "r/1 2:N", "q/2"]
    d = spark.createDataFrame([(a, b) for a in headers for b in headers], "a string, b string")
    got = spark.sql("select a, b, norm_id(a) n, mate_marks(a) m, names_match(a, b) s from {d}", d=d).collect()
    want = d.select("a", "b", R.normalised_id(F.col("a")).alias("n"), R.mate_marks(F.col("a")).alias("m"), R.names_match(F.col("a"), F.col("b")).alias("s")).collect()
    assert sorted(got) == sorted(want) and len({r["s"] for r in got}) == 2
    seqs = spark.createDataFrame([("acgtNRacg",), ("",), (None,), ("NN",)], "s string")
    assert spark.sql("select revcomp(s) r, round(gc_fraction(s), 6) g from {d}", d=seqs).collect() == [("CGTNNACGT", 0.571429), ("", None), (None, None), ("NN", None)]


def test_functions_on_batches(spark):
    sql.register(spark)
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("ACGTN", k=n)), "".join(rng.choices("#+5?I", k=n)), rng.choice([2, 4]), rng.choice([10, 20])) for i, n in enumerate([0, 1, 5, 30, 60] * 8)]
    d = spark.createDataFrame(rows, "i int, s string, q string, w int, least int").repartition(2)
    got = {r["i"]: r["kept"] for r in spark.sql("select i, tail_kept(s, q, w, least) kept from {d}", d=d).collect()}
    of = transform.Reads.of
    assert got == {i: int(transform.tail_kept(of([s]), of([q]), w, least)[0]) for i, s, q, w, least in rows}
    frag = "".join(rng.choices("ACGT", k=50))
    mates = spark.createDataFrame([(frag, frag[::-1].translate(str.maketrans("ACGT", "TGCA"))), ("ACGT", "T")], "a string, b string")
    assert [r["o"] and tuple(r["o"]) for r in spark.sql("select mate_overlap(a, b) o from {d}", d=mates).collect()] in ([(0, 50), None], [(0, 50), (None, None)])
    with pytest.raises(Exception):
        spark.sql("select revcomp(1, 2)").collect()
