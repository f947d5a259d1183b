"""Reports, checks of pairs, writer rules, contaminants and grades, against tabulated values."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from strandframe.functions import reads as R
from strandframe.operators import qc, sample, validate
from strandframe.plans import documents, process, tables
from strandframe.sources import contaminants, fastq

#: Two published adapters.
A1, A2 = "GATCGGAAGAGCTCGTATGCCGTCTTCTGCTTG", "CAAGCAGAAGACGGCATACGAGCTCTTCCGATCT"


def source(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return fastq.read_fastq(spark, str(tmp_path / name))


def test_number_and_length_text():
    numbers = {0.0: "0.0", 1.0: "1.0", 0.001: "0.001", 0.0001: "1.0E-4", 1e7: "1.0E7", 12345678.5: "1.23456785E7", 9999999.0: "9999999.0", -2.5: "-2.5", 1 / 3: "0.3333333333333333", math.inf: "Infinity"}
    assert {x: tables.number_text(x) for x in numbers} == numbers and tables.number_text(None) == "NaN"
    lengths = {0: "0 bp", 999: "999 bp", 1000: "1 kbp", 14350: "14.3 kbp", 1_050_000: "1 Mbp", 1_150_000: "1.1 Mbp", 2_500_000_000: "2.5 Gbp"}
    assert {n: tables.length_text(n) for n in lengths} == lengths


def test_text_folders():
    assert tables.text_folders(["a/x.fastq.gz", "y.fq", "z.txt.gz"]) == ["x_fastqc", "y_fastqc", "z_fastqc"]
    for bad in (["x.fq", "x.fastq.gz"], ["a\tb"]):
        with pytest.raises(ValueError):
            tables.text_folders(bad)


def test_contaminant_list_and_hits(spark, tmp_path):
    (tmp_path / "list").write_text(f"# note\n\n  \t \nfirst\t\t\t{A1}\r\nthree\tfields\there\nsecond\t{A2.lower()}\t\n")
    listed = contaminants.read_contaminants(spark, str(tmp_path / "list"))
    assert [tuple(r) for r in listed.orderBy("place").collect()] == [(4, "first", A1), (6, "second", A2)]
    one, two = A1[:15] + "A" + A1[16:30], A1[:10] + "C" + A1[11:20] + "A" + A1[21:30]
    want = {A1[:8]: ("first", 100, 8), A1[:19]: ("first", 100, 19), A1[:21]: ("first", 100, 21), one: ("first", 96, 30), A2[:33]: ("first", 100, 33)}
    keys = spark.createDataFrame([(k, 1) for k in [*want, A1[:7], A1[:20], two]], "key string, n int")
    got = {r["key"]: (r["name"], r["identity"], r["bases_matched"]) for r in qc.contaminant_hits(keys, listed).collect()}
    assert {k: got.get(k) for k in want} == want and set(got) == set(want)
    (tmp_path / "wrong").write_text("x\tACGU\n")
    with pytest.raises(Exception, match="line 1"):
        contaminants.read_contaminants(spark, str(tmp_path / "wrong")).collect()


def plain_hit(key, listed):
    """The best hit by trying every offset."""
    found = []
    for place, (name, bases) in enumerate(listed, 1):
        back = bases[::-1].translate(str.maketrans("ACGT", "TGCA"))
        if 8 <= len(key) <= 19:
            found += [((len(key), 100, -place), (name, 100, len(key)))] * (key in bases or key in back)
            continue
        best = None
        for strand, s in enumerate((bases, back)):
            for shift in range(21 - len(s), len(key) - 20):
                agree = "".join("01"[key[i] == s[i - shift]] for i in range(max(0, shift), min(len(key), len(s) + shift)))
                for run in re.findall("(1*0?1*)(?:0|$)", agree):
                    size = len(run.rstrip("0"))
                    if size >= 21:
                        now = (size, -strand, -shift, (size - ("0" in run)) * 100 // size)
                        best = max(best or now, now)
        if best:
            found.append(((best[0], best[3], -place), (name, best[3], best[0])))
    return max(found)[1] if found else None


def test_contaminant_hits_by_every_offset(spark):
    rng = random.Random(9)
    some = lambda n: "".join(rng.choices("ACGT", k=n))
    long = some(70)
    listed = [("long", long), ("part", long[20:55]), ("short", long[:7]), ("ten", some(10)), ("poly", "A" * 40)]
    turned = long[::-1].translate(str.maketrans("ACGT", "TGCA"))
    keys = {"", long[:7], "A" * 30, "A" * 9 + "C" + "A" * 25, listed[3][1][1:], "T" * 12}
    for _ in range(400):
        n = rng.randint(8, 45)
        at = rng.randint(0, 70 - n)
        key = list(rng.choice([long, turned])[at : at + n])
        for _ in range(rng.randint(0, 2)):
            key[rng.randrange(n)] = rng.choice("ACGTN")
        keys.add((some(rng.choice([0, 3, 8])) + "".join(key) + some(rng.choice([0, 5])))[:50])
    want = {(k, *hit) for k in keys if (hit := plain_hit(k, listed))}
    got = qc.contaminant_hits(spark.createDataFrame([(k, 7) for k in keys], "key string, n int"), contaminants.contaminants(spark, listed)).collect()
    assert len(want) > 100 and sorted(want) == sorted((r["key"], r["name"], r["identity"], r["bases_matched"]) for r in got) and {r["n"] for r in got} == {7}


def plain_deviation(bins):
    top = max(range(101), key=lambda b: (bins[b], -b))
    low = high = top
    while high <= 100 and bins[high] > bins[top] * 0.9:
        high += 1
    while low >= 0 and bins[low] > bins[top] * 0.9:
        low -= 1
    mode = top if low < 0 or high > 100 else sum(range(low + 1, high)) / (high - low - 1)
    total = sum(bins)
    s = math.sqrt(sum((b - mode) ** 2 * n for b, n in enumerate(bins)) / (total - 1))
    return sum(abs(total * math.exp(-((b - mode) ** 2) / (2 * s * s)) / (s * math.sqrt(2 * math.pi)) - n) for b, n in enumerate(bins)) / total * 100


@pytest.mark.parametrize("peaks", [{50: 100, 51: 95, 52: 60, 40: 3}, {0: 9, 3: 2}, {100: 9, 99: 8.5, 90: 2}, {20: 7, 80: 7}])
def test_gc_deviation(spark, peaks):
    bins = [float(peaks.get(b, 0)) for b in range(101)]
    frame = spark.createDataFrame(list(enumerate(bins)), "bin int, reads double")
    assert qc.gc_deviation(frame).first()[0] == pytest.approx(plain_deviation(bins), abs=1e-5)


def test_gc_deviation_of_one_bin(spark):
    assert qc.gc_deviation(spark.createDataFrame([(b, 5.0 if b == 40 else 0.0) for b in range(101)], "bin int, reads double")).first()[0] is None


def tiled(spark, headers):
    return spark.createDataFrame([(i, h, "ACGT", "IIII"[: 4 if i else 2]) for i, h in enumerate(headers)], "idx long, header string, seq string, qual string")


def test_tile_rules(spark):
    seven, five = "a:b:c:d:{}:1:2", "a:b:{}:1:2"
    assert {r["tile"] for r in qc.tile_quality(tiled(spark, [seven.format(7), seven.format(8)])).collect()} == {7, 8}
    assert {r["tile"] for r in qc.tile_quality(tiled(spark, [five.format(3), five.format("+4")])).collect()} == {3, 4}
    rows = {(r["tile"], r["first"]): r["mean"] for r in qc.tile_quality(tiled(spark, [five.format(3), five.format(4)])).collect()}
    assert rows[3, 4] == 0.0 and rows[4, 4] == 40.0
    for bad in ([five.format(3), five.format("x")], ["a:b:c", "a:b:c"], ["a:b:3:::", "a:b:3:::"]):
        assert qc.tile_quality(tiled(spark, bad)).count() == 0


def test_pair_checks(spark, tmp_path):
    good1, good2 = "@a/1\nAC\n+\nII\n", "@a/2\nGT\n+\nII\n"
    side = lambda n, t: source(spark, tmp_path, n, t)
    cases = [
        (good1, good2, None),
        (good1 + "@b/1\nA\n+\nI\n", good2, ("P002", 1, 1, 1, 0)),
        (good1, good2 + "@b/2\nA\n+\nI\n", ("P002", 1, 2, 0, 1)),
        (good1, "@c/2\nGT\n+\nII\n", ("P001", 0, None, None, None)),
        ("@a/1\nAX\n+\nII\n", "@a/2\nGT\n-\nII\n", ("S001", 0, 2, None, None)),
        ("@a/1\nA.\n+\nII\n", "@c/2\nGT\n+\nI \n", ("S002", 0, 1, None, None)),
        (good1 + "@b/1\nA!\n+\nII\n", good2, ("P002", 1, 1, 1, 0)),
    ]
    for i, (a, b, want) in enumerate(cases):
        row = process.check_pairs(side(f"{i}a.fq", a), side(f"{i}b.fq", b)).first()
        assert (row and (row["code"], row["idx"], row["mate"], row["last1"], row["last2"])) == want
    row = process.check_interleaved(side("i.fq", good1 + good2 + "@b/1\nA\n+\nI\n")).first()
    assert (row["code"], row["idx"], row["mate"], row["last1"], row["last2"]) == ("P002", 1, 1, 2, 1)
    assert process.check_interleaved(side("j.fq", good1 + good2)).first() is None


def test_documents(spark, tmp_path):
    records = source(spark, tmp_path, "a.fq", "@a\nACGN\n+\nIIII\n").unionByName(source(spark, tmp_path, "b.fq", "@a\nA.\n+\nI\n"))
    records = records.withColumn("src", F.regexp_extract("src", "[^/]*$", 0))
    check = json.loads(documents.check_document(["a.fq", "b.fq", "empty\\\n"], records))
    assert [r["status"] for r in check["results"]] == ["ok", "error", "ok"] and check["results"][1]["error"] == {"code": "S005", "record_index": 0, "byte_offset": 8, "line_in_record": 4}
    assert check["results"][2]["input"] == "empty\\\\\\x0A"
    found = json.loads(documents.stats_document(["a.fq", "b.fq", "none"], records))["results"]
    assert found[0]["a"] == 1 and found[0]["mean_length"] == 4 and found[0]["n"] == 1 and found[1]["status"] == "error" and found[2]["reads"] == 0 and found[2]["min_length"] is None
    a, b = source(spark, tmp_path, "p.fq", "@x/1\nA\n+\nI\n"), source(spark, tmp_path, "q.fq", "@y/2\nA\n+\nI\n")
    error = json.loads(documents.pair_check_document(["p", "q"], a, b))["results"][0]["error"]
    assert error["code"] == "P001" and error["first_tokens"] == ["x/1", "y/2"] and error["mate_markers"] == [[1], [2]]


def test_writer_rules(spark, tmp_path):
    rows = [(0, "@a", "AC", "II"), (1, "", "A", "I"), (2, "@b", "A", "II"), (3, "c", "A\n", "I\n"), (4, "d", "A", "\r"), (5, " e", "A", "I"), (6, "@f", "", "")]
    made = spark.createDataFrame(rows, "idx long, header string, seq string, qual string")
    assert {r["idx"]: r["reason"] for r in validate.unwritable(made).collect()} == {1: "empty name", 2: "length mismatch", 3: "line feed in a field", 4: "carriage return at an end", 5: "empty name"}
    with pytest.raises(Exception, match="unwritable record 4"):
        fastq.write_fastq(made.where("idx in (0, 4)"), str(tmp_path / "out"), ["idx"])
    pairs = spark.createDataFrame([(0, "a", "A", "I", "a", "C", "I"), (1, "b", "A", "I", "b", "C", "\r")], "idx long, h1 string, s1 string, q1 string, h2 string, s2 string, q2 string")
    assert tuple(documents.unwritable_pair(pairs).first()) == (1, 2, "carriage return at an end")
    tags = spark.createDataFrame([("+a/1 x", "@a/1 x"), ("+", "@a"), ("+z", "@a")], "p string, h string").select(R.tag_plus(F.col("p"), F.col("h"), F.lit(":T")))
    assert [r[0] for r in tags.collect()] == ["+a:T/1 x", "+", "+z"]


def test_whole_sources_before_exact_sampling(spark, tmp_path):
    good, bad = source(spark, tmp_path, "g.fq", "@a\nA\n+\nI\n"), source(spark, tmp_path, "b.fq", "@a\nA\n+\nII\n")
    assert sample.checked(good) is good
    with pytest.raises(ValueError, match="S005"):
        sample.checked(bad)
    with fastq.unchanged(spark, str(tmp_path / "g.fq")):
        good.count()
    with pytest.raises(RuntimeError), fastq.unchanged(spark, str(tmp_path / "g.fq")):
        (tmp_path / "g.fq").write_text("@a\nAC\n+\nII\n")


def test_quality_control_text(spark):
    reads = spark.createDataFrame([(i, f"r:1:2:3:{i % 2}:0:0", "ACGTACGTAC", "IIIIIIIIII") for i in range(120)], "idx long, header string, seq string, qual string")
    text = tables.qc_text(reads, "x.fq", "##made here", contaminants.contaminants(spark, [("known", "TTACGTACGTACTT")]))
    titles = [line for line in text.splitlines() if line.startswith(">>") and line != ">>END_MODULE"]
    assert titles == [
        ">>Basic Statistics\tpass", ">>Per base sequence quality\tpass", ">>Per tile sequence quality\tpass", ">>Per sequence quality scores\tpass", ">>Per base sequence content\tfail", ">>Per sequence GC content\tfail",
        ">>Per base N content\tpass", ">>Sequence Length Distribution\tpass", ">>Sequence Duplication Levels\tfail", ">>Overrepresented sequences\tfail", ">>Adapter Content\twarn",
    ]
    for line in ("Total Bases\t1.2 kbp", "Sequence length\t10", "10\t40.0\t40.0\t40.0\t40.0\t40.0\t40.0", "40\t120.0", "ACGTACGTAC\t120\t100.0\tknown (100% over 10bp)", "1\t10\t0.0", "#Total Deduplicated Percentage\t0.8333333333333334"):
        assert line in text.splitlines()


def test_summary_of_a_run(spark):
    rows = [(i, f"r{i}", "ACGTACGTAC" * 3, "I" * 30, f"r{i}", "GTACGTACGT" * 3, "I" * 30) for i in range(4)]
    pairs = spark.createDataFrame(rows, "idx long, h1 string, s1 string, q1 string, h2 string, s2 string, q2 string")
    with process.Run(pairs, process.Options(pair_duplication=True)) as run:
        out = json.loads(documents.qc_summary(run, ["go", "a\tb"]))
    assert out["summary"]["before_filtering"]["total_reads"] == 8 and out["filtering_result"] == {"passed_filter_reads": 8, "low_quality_reads": 0, "too_many_N_reads": 0, "too_short_reads": 0, "too_long_reads": 0}
    assert out["duplication"]["rate"] == 0.75 and out["read1_after_filtering"]["q40_bases"] == 120 and out["read1_after_filtering"]["quality_curves"]["mean"] == [40.0] * 30
    assert out["command"] == "go a\\x09b" and "insert_size" not in out
