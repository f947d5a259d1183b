"""Whole runs over files: outputs, reports, failures and what they leave behind."""

import gzip
import json
import random

import pytest

from strandframe.operators import filters, transform
from strandframe.plans import process, report
from strandframe.sources import fastq

ADAPTERS = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"


def files(tmp_path, first, second):
    for name, text in (("a.fastq", first), ("b.fastq", second)):
        (tmp_path / name).write_text(text)
    return str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq")


def outs(tmp_path, name="out"):
    return str(tmp_path / f"{name}1"), str(tmp_path / f"{name}2")


def text_of(folder):
    data = [p.read_bytes() for p in sorted(folder.glob("part-*"))]
    return b"".join(gzip.decompress(d) if d[:2] == b"\x1f\x8b" else d for d in data).decode()


def json_of(folder):
    return json.loads("".join(p.read_text() for p in folder.glob("part-*")))


def mates(n, seed=1):
    """Fragments of 30 to 120 bases read from both ends, with adapters."""
    rng, first, second = random.Random(seed), "", ""
    for i in range(n):
        frag = "".join(rng.choices("ACGT", k=rng.randrange(30, 120)))
        back = frag[::-1].translate(str.maketrans("ACGT", "TGCA"))
        for k, (s, a) in enumerate(((frag, ADAPTERS[0]), (back, ADAPTERS[1])), 1):
            seq = (s + a + "A" * 60)[:60]
            rec = f"@r:1:2:3:{i % 2}:{i}:7/{k}\n{seq}\n+{f'r:1:2:3:{i % 2}:{i}:7/{k}' if i % 3 == 0 else ''}\n{''.join(rng.choices('#5IIIIII', k=60))}\n"
            first, second = (first + rec, second) if k == 1 else (first, second + rec)
    return first, second


def test_a_tag_is_repeated_in_plus_lines(spark, tmp_path):
    first = "@p1/1 x\nAACCGGTTACGTAAAA\n+p1/1 x\nIIIIIIIIIIIIIIII\n@p2/1\nAACCGGTNACGTCC\n+\nIIIIIIIIIIIIII\n@p3/1\nAACC\n+other\nIIII\n"
    second = "@p1/2\nTTGGCCAAACGTCCCC\n+\nIIIIIIIIIIIIIIII\n@p2/2\nTTGGCCAAACGTGG\n+p2/2\nIIIIIIIIIIIIII\n@p3/2\nTTGGCCAAACGTG\n+\nIIIIIIIIIIIII\n"
    out = report.process_files(spark, files(tmp_path, first, second), outs(tmp_path), process.Options(umi_length=8, umi_skip=4))
    assert text_of(tmp_path / "out1") == "@p1:AACCGGTT_TTGGCCAA/1 x\nAAAA\n+p1:AACCGGTT_TTGGCCAA/1 x\nIIII\n@p2:AACCGGTN_TTGGCCAA/1\nCC\n+\nII\n"
    assert text_of(tmp_path / "out2") == "@p1:AACCGGTT_TTGGCCAA/2\nCCCC\n+\nIIII\n@p2:AACCGGTN_TTGGCCAA/2\nGG\n+p2:AACCGGTN_TTGGCCAA/2\nII\n"
    assert out["umi"] == {"ambiguous_pairs": 1, "short_pairs": 1} and out["pairs"] == {"read": 3, "written": 2, "dropped": 1}
    assert out["filtering"]["dropped_pairs"]["too_short"] == 1 and out["status"] == "ok"


def test_report_of_a_run(spark, tmp_path):
    ins, n = files(tmp_path, *mates(150)), 150
    options = process.Options(trim=transform.Trim(4, 20, 10, *ADAPTERS), filter=filters.Filter(min_length=40), pair_duplication=True, gzip=True, gzip_preset="fast")
    out = report.process_files(spark, ins, outs(tmp_path), options, qc_summary=str(tmp_path / "qc_summary"))
    assert [i["size"] for i in out["inputs"]] == [(tmp_path / f).stat().st_size for f in ("a.fastq", "b.fastq")] and all(i["mtime_ns"] for i in out["inputs"])
    assert out["options"]["gzip_preset"] == "fast" and out["options"]["trim_tail_window"] == 4 and out["options"]["umi_length"] is None
    with process.Run(fastq_pairs(spark, ins), options) as run:
        rows = run.decided.orderBy("idx").collect()
        steps = {(r["mate"], r["step"]): (r["reads"], r["bases"]) for r in filters.step_counts(run.decided).collect()}
    kept = [r for r in rows if r["reason_pair"] is None]
    assert out["pairs"] == {"read": n, "written": len(kept), "dropped": n - len(kept)} and 0 < len(kept) < n
    assert {(k + 1, s): (v["reads"], v["bases"]) for k, t in enumerate(out["trimming"]) for s, v in t.items()} == steps
    for k in (1, 2):
        text = text_of(tmp_path / f"out{k}").splitlines()
        assert text[1::4] == [r[f"s{k}"] for r in kept] and text[3::4] == [r[f"q{k}"] for r in kept] and text[0::4] == [r[f"h{k}"] for r in kept]
        assert all(p in ("+", "+" + h[1:]) for h, p in zip(text[0::4], text[2::4]))
        raw, retained = (out["mates"][p][k - 1] for p in ("raw", "retained"))
        assert raw["reads"] == n and retained["bases"] == sum(len(r[f"s{k}"]) for r in kept)
    assert sum(out["inserts"]["histogram"]) + out["inserts"]["unknown"] == out["inserts"]["pairs"] <= n and out["inserts"]["overlapping"] > 50
    assert out["pair_duplication"] == {"pairs": n, "duplicates": 0, "rate": 0.0}
    assert "summary" in json.loads("\n".join(p.read_text() for p in (tmp_path / "qc_summary").glob("part-*")))
    with pytest.raises(Exception, match="exists"):
        report.process_files(spark, ins, outs(tmp_path))


def test_quality_control_of_a_run(spark, tmp_path):
    (tmp_path / "known").write_text(f"adapter one\t{ADAPTERS[0]}\n")
    more = {k: str(tmp_path / k) for k in ("report", "qc_tables", "contaminants")} | {"contaminants": str(tmp_path / "known")}
    out = report.process_files(spark, files(tmp_path, *mates(20)), outs(tmp_path), **more)
    assert json_of(tmp_path / "report") == json.loads(json.dumps(out))
    assert set(out["qc"]) == {"raw"} and out["qc"]["raw"][0]["base_quality"]["grade"] in ("pass", "warn", "fail") and len(out["qc"]["raw"][1]["base_quality"]["rows"]) == 60
    assert len(out["qc"]["raw"][0]["overrepresented"]["rows"]) == 20 and all("source" in r for r in out["qc"]["raw"][0]["overrepresented"]["rows"])
    assert [f["path"] for f in out["qc_table_files"]] == [f"{tmp_path}/qc_tables/raw/{n}_fastqc" for n in "ab"]
    text = text_of(tmp_path / "qc_tables" / "raw" / "a_fastqc")
    assert text.startswith("##Quality control\n>>Basic Statistics\tpass") and text.count(">>END_MODULE") == 11


def fastq_pairs(spark, ins):
    from strandframe.operators import validate

    return validate.zip_pairs(*(fastq.read_fastq(spark, i) for i in ins), plus=True)


def test_copies_and_limits(spark, tmp_path):
    first, second = mates(7)
    ins = files(tmp_path, first, second)
    out = report.process_files(spark, ins, outs(tmp_path))
    assert (text_of(tmp_path / "out1"), text_of(tmp_path / "out2")) == (first, second)
    assert out["filtering"] is None and out["inserts"] is None and out["trimming"][0] == dict.fromkeys(process.STEPS) and out["qc"] is None and out["input_complete"]
    out = report.process_files(spark, ins, outs(tmp_path, "few"), process.Options(max_pairs=3))
    assert text_of(tmp_path / "few1") == "".join(f"{x}\n" for x in first.splitlines()[:12]) and not out["input_complete"] and out["pairs"]["read"] == 3
    # A failure behind the limit isn't met.
    ins = files(tmp_path, first + "@x\nAC\n+\nI\n", second + "@x\nAC\n+\nII\n")
    assert report.process_files(spark, ins, outs(tmp_path, "cut"), process.Options(max_pairs=7))["status"] == "ok"


@pytest.mark.parametrize(
    "first, second, code, failed",
    [
        ("@a/1\nAC\n+\nII\n@b/1\nAC\n+\nI\n", "@a/2\nAC\n+\nII\n@b/2\nAC\n+\nII\n", "S005", "a.fastq"),
        ("@a/1\nAC\n+\nII\n", "@a/2\nA.\n+\nII\n", "S002", "b.fastq"),
        ("@a/1\nAC\n+\nII\n", "@a/2\nAC\n+\nII\n@b/2\nAC\n+\nII\n", "P002", None),
        ("@" + "a" * 200 + "/1\nAC\n+\nII\n", "@b/2\nAC\n+\nII\n", "P001", None),
    ],
)
def test_failing_inputs_leave_no_outputs(spark, tmp_path, first, second, code, failed):
    out = report.process_files(spark, files(tmp_path, first, second), outs(tmp_path), report=str(tmp_path / "report"))
    assert out["status"] == "error" and out["error"]["code"] == code and json_of(tmp_path / "report")["error"] == out["error"]
    assert (out["failed_input"] is None) if failed is None else out["failed_input"].endswith(failed)
    assert not out["input_complete"] and out["pairs"] is None and not any((tmp_path / f"out{k}").exists() for k in (1, 2))
    if code == "P001":
        assert out["error"]["first_tokens"][0] == "a" * 128


def test_what_cannot_be_written_comes_last(spark, tmp_path):
    """A record whose quality ends in a carriage return reads as valid only without its line end, so a pair is made here."""
    pairs = spark.createDataFrame([(0, "@a", "A", "I", "+", "@a", "C", "I", "+"), (1, "@b", "A", "I", "+", "@b", "C", "\r", "+")], "idx long, h1 string, s1 string, q1 string, p1 string, h2 string, s2 string, q2 string, p2 string")
    with process.Run(pairs, process.Options()) as run, pytest.raises(Exception, match="unwritable record 1"):
        run.write(*outs(tmp_path))
    assert not any((tmp_path / f"out{k}").exists() for k in (1, 2))
    with process.Run(pairs.where("idx = 0"), process.Options()) as run:
        counts = run.write(*outs(tmp_path))
    assert (counts["read"], counts["written"]) == (1, 1) and text_of(tmp_path / "out2") == "@a\nC\n+\nI\n"


@pytest.mark.parametrize(
    "options, more, said",
    [
        ({"umi_skip": 3}, {}, "umi_skip"), ({"gzip_preset": "fast"}, {}, "gzip_preset"), ({"gzip": True, "gzip_preset": "best"}, {}, "fast"), ({"pair_duplication": True}, {}, "pair_duplication"),
        ({"max_pairs": 3}, {"qc_tables": "x"}, "max_pairs"), ({"max_pairs": 3}, {"qc_summary": "x"}, "max_pairs"), ({}, {"contaminants": "x"}, "contaminants"),
    ],
)
def test_option_rules(options, more, said):
    every = {"report": None, "qc_tables": None, "qc_summary": None, "contaminants": None} | more
    with pytest.raises(ValueError, match=said):
        report.check_outputs(process.Options(**options), ("a", "b"), **every)
    none = dict.fromkeys(every)
    for outputs in (("a", "a"), ("a.gz", "b")):
        with pytest.raises(ValueError):
            report.check_outputs(process.Options(), outputs, **none)
    report.check_outputs(process.Options(gzip=True, pair_duplication=True), ("a.gz", "b.gz"), **none | {"report": "r", "contaminants": "c"})


def test_counts_and_statistics_of_several_inputs(spark, tmp_path):
    from pyspark.sql import functions as F

    texts = {"a": "@r\nACGTN?\n+\n!5?I~!\n", "b": "@r\nA\n+\nII\n", "c": "@r\nA.\n+\nII\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    records = fastq.read_fastq(spark, [str(tmp_path / n) for n in texts]).withColumn("src", F.regexp_extract("src", "[^/]*$", 0))
    results = json.loads(report.count_document(["a", "b", "c", "none"], records))["results"]
    assert [(r["status"], r.get("reads")) for r in results] == [("ok", 1), ("error", None), ("ok", 1), ("ok", 0)] and results[1]["error"]["code"] == "S005"
    blocks = report.stats_texts(["a", "b", "none"], records).split("\n\n")
    assert blocks[0].startswith("a:\nreads: 1\nbases: 6\n") and "mean_quality: 30.500000" in blocks[0] and blocks[1] == "b:\nerror: S005 in record 0, line 4, byte 7" and "mean_length: -" in blocks[2]
    assert report.stats_texts(["a"], records).startswith("reads: 1\n")
