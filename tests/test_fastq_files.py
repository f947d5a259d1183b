"""The data source: ranges, gzip by content, and outputs that are whole or not there."""

import gzip
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandframe.sources import fastq, fastq_files


def plain_records(data):
    """Record number, four lines and offsets, by a loop over lines."""
    lines, at = [], 0
    for raw in data.splitlines(keepends=True) if b"\r" not in data.replace(b"\r\n", b"") else [x + b"\n" for x in data.split(b"\n")[:-1]] + ([data.rsplit(b"\n", 1)[-1]] if not data.endswith(b"\n") and data else []):
        text = raw[:-1].removesuffix(b"\r") if raw.endswith(b"\n") else raw
        lines.append((text.decode("latin-1"), at, at + len(raw)))
        at += len(raw)
    out = []
    for i in range(0, len(lines), 4):
        four = lines[i : i + 4] + [(None, None, None)] * (4 - len(lines[i : i + 4]))
        out.append((i // 4, *(x[0] for x in four), *(x[1] for x in four), max(x[2] for x in four if x[2] is not None)))
    return out


def made(rng, n, end):
    """Records whose quality may begin with an at sign or a plus, and plus lines with text."""
    out = b""
    for i in range(n):
        k = rng.choice([0, 1, 7, 30, 200])
        feed = rng.choice([b"\n", b"\r\n"])
        seq, qual = bytes(rng.choices(b"ACGTN", k=k)), bytes(rng.choices(b"@+I!", k=k))
        out += b"@r%d x" % i + feed + seq + feed + b"+" + (b"r%d x" % i if i % 5 == 0 else b"") + feed + qual + feed
    return out + end


def read(spark, path, **more):
    cols = ["idx", *fastq_files.FIELDS, *fastq_files.OFFSETS, "end_offset"]
    return sorted(tuple(r) for r in fastq.read_fastq(spark, path, **more).select(*cols).collect())


@pytest.mark.parametrize("end", [b"", b"@last", b"@last\nAC", b"@last\nAC\n+\nII", b"@last\nAC\n+\nII\r", b"\n", b"\n\n\n\n\n"])
def test_ranges_do_not_change_positions(spark, tmp_path, monkeypatch, end):
    data = made(random.Random(len(end)), 40, end)
    (tmp_path / "a.fq").write_bytes(data)
    want = plain_records(data)
    for block, split in ((1 << 20, 1 << 20), (64, 100), (64, 1000), (1 << 20, 3)):
        if split == 3:
            ranges = [(f"file://{tmp_path}/a.fq", a, min(a + 3, len(data))) for a in range(0, len(data), 3)]
            monkeypatch.setattr(fastq_files, "BLOCK", block)
            before, got = 0, []
            for r in ranges:
                for batch in fastq_files.FileRange(*r, before).records():
                    got += [tuple(x.values())[1:] for x in batch.to_pylist()]
                before += fastq_files.count_lines(*r)
            assert got == want
        else:
            assert read(spark, str(tmp_path / "a.fq"), split_bytes=split) == want
    with gzip.open(tmp_path / "hidden.txt", "wb") as f:  # not told by its name
        f.write(data)
    assert read(spark, str(tmp_path / "hidden.txt")) == want


def test_small_blocks(monkeypatch, tmp_path):
    data = made(random.Random(5), 60, b"@z\nAC\n")
    (tmp_path / "a").write_bytes(data)
    with gzip.open(tmp_path / "b", "wb") as f:
        f.write(data)
    for size in (1, 7, 50):
        monkeypatch.setattr(fastq_files.blocks_at, "__defaults__", (size,))
        monkeypatch.setattr(fastq_files, "BLOCK", size)
        for name in ("a", "b"):
            got = [tuple(x.values())[1:] for b in fastq_files.FileRange(f"file://{tmp_path}/{name}").records() for x in b.to_pylist()]
            assert got == plain_records(data)


def test_gzip_members(spark, tmp_path):
    one, two = b"@a\nAC\n+\nII\n@b\nA", b"CGT\n+\nIIII\n"
    path = tmp_path / "x.fastq"
    members = gzip.compress(one) + gzip.compress(b"") + gzip.compress(two)
    path.write_bytes(members)
    assert read(spark, str(path)) == plain_records(one + two)
    damaged = bytearray(members)
    damaged[len(gzip.compress(one)) - 6] ^= 1  # a checksum
    for bad in (bytes(damaged), members + b"\0" * 8, members + b"@c\n", members[:-3], members[:12], members + b"\x1f\x8b"):
        path.write_bytes(bad)
        with pytest.raises(Exception, match="gzip"):
            read(spark, str(path))
    path.write_bytes(b"")
    assert read(spark, str(path)) == []


def test_plain_load(spark, tmp_path):
    for name, k in (("b.fq", 3), ("a.fq", 5), ("_hidden", 2)):
        (tmp_path / name).write_bytes(made(random.Random(k), k, b""))
    spark.dataSource.register(fastq_files.FastqSource)
    rows = spark.read.format("fastq").load(str(tmp_path)).groupBy("src").agg(F.max("idx").alias("last")).collect()
    assert {os.path.basename(r["src"]): r["last"] for r in rows} == {"a.fq": 4, "b.fq": 2}
    both = fastq.read_fastq(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq")], split_bytes=50)
    assert sorted((os.path.basename(r["src"]), r["idx"]) for r in both.collect()) == [("a.fq", i) for i in range(5)] + [("b.fq", i) for i in range(3)]
    plan = both._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan
    by_lines = fastq.records_of_lines(fastq.read_lines(spark, str(tmp_path / "a.fq")))
    assert sorted(map(tuple, by_lines.collect())) == sorted(map(tuple, fastq.read_fastq(spark, str(tmp_path / "a.fq")).select(*by_lines.columns).collect()))


def text_of(folder):
    data = b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))
    return gzip.decompress(data) if data[:2] == fastq_files.GZIP_MAGIC else data


@pytest.mark.parametrize("preset", [None, "fast", "even", "dense"])
def test_ordered_outputs(spark, tmp_path, preset):
    rows = [(i, f"a{i}\n" * (i % 4 + 1), f"b{i}\n") for i in range(500)]
    d = spark.createDataFrame(rows, "idx long, a string, b string").repartition(7).orderBy("idx").select("a", "b")
    fastq.write_texts(d, [str(tmp_path / "a"), f"file://{tmp_path}/b"], preset is not None, preset or "even")
    assert [text_of(tmp_path / c) for c in "ab"] == ["".join(r[k] for r in rows).encode() for k in (1, 2)]
    parts = [sorted(p.name for p in (tmp_path / c).iterdir()) for c in "ab"]
    assert parts[0] == parts[1] and all(n.startswith("part-") for n in parts[0])
    if preset:
        assert all(p.read_bytes()[4:8] == b"\0\0\0\0" for p in (tmp_path / "a").iterdir())  # no time: the same bytes each time
        assert sum(len(zlib.decompress(p.read_bytes(), 31)) for p in (tmp_path / "b").iterdir()) == sum(len(r[2]) for r in rows)


def test_nothing_stays_of_a_failed_run(spark, tmp_path):
    rows = [(i, "x\n", "y\n") for i in range(300)]
    good = spark.createDataFrame(rows, "idx long, a string, b string").repartition(5).orderBy("idx")
    bad = good.select(F.when(F.col("idx") == 250, F.raise_error(F.lit("unwritable"))).otherwise(F.col("a")).alias("a"), "b")
    with pytest.raises(Exception, match="unwritable"):
        fastq.write_texts(bad, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert not (tmp_path / "a").exists() and not (tmp_path / "b").exists()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "mine").write_text("x")
    for paths in ([tmp_path / "a", tmp_path / "b"], [tmp_path / "c", tmp_path / "c"]):
        with pytest.raises(Exception, match="exists|differ"):
            fastq.write_texts(good.select("a", "b"), list(map(str, paths)))
    assert not (tmp_path / "a").exists() and not (tmp_path / "c").exists() and (tmp_path / "b" / "mine").read_text() == "x"
    with pytest.raises(ValueError):
        fastq.write_texts(good.select("a"), [str(tmp_path / "d")], True, "best")
    fastq.write_texts(good.limit(0).select("a"), [str(tmp_path / "none")])
    assert list((tmp_path / "none").iterdir()) == []
