"""Rules of records, names, sampling and transforms, against tabulated values."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandframe import queries
from strandframe.functions import reads as R
from strandframe.operators import filters, inserts, qc, sample, stats, transform, validate
from strandframe.plans import process
from strandframe.sources.fastq import read_fastq, write_fastq


def fastq(spark, tmp_path, text, name="a.fastq"):
    path = tmp_path / name
    data = text if isinstance(text, bytes) else text.encode("latin-1")
    path.write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    return read_fastq(spark, str(path))


@pytest.mark.parametrize(
    "text, want",
    [
        ("@r\n.\nx\n \n", ("S001", 0, 3, 5)),
        ("@ description\nA\n+\n!\n", ("S003", 0, 1, 0)),
        ("@r\n.\n+\n\x7f\n", ("S002", 0, 2, 3)),
        ("@r\n.\n+\n", ("S004", 0, 4, 7)),
        ("@r\n.\n+\n!!\n", ("S005", 0, 4, 7)),
        ("@a\nACGT\n+\nIIII\n@b\nAC.X\n+\nIIII\n", ("S002", 1, 2, 20)),
        ("@a\nACGT\n+\n!! !\n", ("S006", 0, 4, 12)),
        ("@a\r\nAC\r\n+\r\nII\r\n@b\r\nA\r\n+\r\nI\r", ("S005", 1, 4, 25)),
    ],
)
def test_first_failure(spark, tmp_path, text, want):
    row = validate.first_violation(validate.violations(fastq(spark, tmp_path, text))).first()
    assert (row["code"], row["idx"], row["line"], row["offset"]) == want


@pytest.mark.parametrize("name", ["a.fastq", "a.fastq.gz"])
def test_round_trip(spark, tmp_path, name):
    text = "@a x\nACGT\n+\nIIII\n@b\n\n+\n\n@c\nNN\n+c\n!!\n"
    records = fastq(spark, tmp_path, text, name)
    assert validate.violations(records).count() == 0
    write_fastq(records, str(tmp_path / "out"), ["idx"])
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == text
    with pytest.raises(Exception):
        write_fastq(records, str(tmp_path / "out"), ["idx"])


def test_splits_do_not_change_positions(spark, tmp_path):
    text = "".join(f"@r{i}\n{'ACGT' * (i % 7)}\n+\n{'IIII' * (i % 7)}\n" for i in range(300))
    whole = fastq(spark, tmp_path, text).orderBy("idx").collect()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert fastq(spark, tmp_path, text).orderBy("idx").collect() == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["off_header"] for r in whole[:2]] == [0, 8]


def test_stats(spark):
    d = spark.createDataFrame([("AaCcGgTtNnR?", "!5?I~!!!!!!!"), ("", "")], "seq string, qual string")
    r = stats.read_stats(d).first()
    assert (r["reads"], r["bases"], r["mean_length"], r["gc_fraction"], r["mean_quality"], r["q20_bases"], r["q30_bases"], r["other_bases"]) == (2, 12, 6.0, 0.5, 15.25, 4, 3, 2)
    none = stats.read_stats(d.limit(0)).first()
    assert none["reads"] == 0 and none["mean_length"] is None and none["gc_fraction"] is None


@pytest.mark.parametrize(
    "a, b, illumina, exact",
    [("r/1", "r/2", True, False), ("r", "r", True, True), ("r/2", "r/1", False, False), ("r 1:N:0", "r 2:N:0", True, True), ("r 1:N", "r", False, True), ("r/1", "q/2", False, False), ("r/1", "r", False, False), ("r x/1", "r x/2", True, True)],
)
def test_names(spark, a, b, illumina, exact):
    r = spark.range(1).select(R.names_match(F.lit(a), F.lit(b)).alias("i"), R.names_match(F.lit(a), F.lit(b), "exact").alias("e")).first()
    assert (r["i"], r["e"]) == (illumina, exact)


def test_generator(spark):
    assert sample.tempered(sample.twist(sample.seeded(5489)))[0] == 14514284786278117030
    like = spark.range(1)
    got = lambda df: sorted(r["idx"] for r in df.collect())
    assert got(sample.fraction_indexes(like, 16, 0.5)) == [0, 2, 4, 5, 10, 11, 13, 14, 15]
    assert [got(sample.exact_indexes(like, 5, k)) for k in (0, 1, 2, 3, 5)] == [[], [4], [2, 4], [1, 3, 4], [0, 1, 2, 3, 4]]
    assert got(sample.fraction_indexes(like, 16, 0.1)) == [4, 11]
    assert got(sample.exact_indexes(like, 16, 3)) == [4, 10, 11]
    assert got(sample.exact_indexes(like, 16, 2, (1 << 64) - 1)) == [8, 15]


def test_cycle_groups(spark):
    assert [qc.cycle_groups(spark, n).select("first").distinct().count() for n in (75, 76, 151, 335, 1310)] == [75, 43, 38, 42, 36]


def test_gc_bins(spark):
    d = spark.createDataFrame([(0, "GCGAAAAAAA", "I" * 10)], "idx long, seq string, qual string")
    got = {r["bin"]: r["reads"] for r in qc.read_gc(d).where("reads > 0").collect()}
    assert got[25] == 0.5 and got[35] == 0.5 and got[30] == 1.0


def test_duplication(spark):
    seqs = [s for s, n in zip("ABCDEFGH", (7, 5, 3, 2, 2, 1, 1, 1)) for _ in range(n)]
    d = spark.createDataFrame([(i, s * 60) for i, s in enumerate(seqs)], "idx long, seq string")
    rows = {r["level"]: r for r in qc.duplication_levels(d).collect()}
    assert rows["1"]["left_percent"] == pytest.approx(100 * 8 / 22)
    assert rows["1"]["percent"] == pytest.approx(100 * 3 / 22) and rows["7"]["percent"] == pytest.approx(100 * 7 / 22)


def test_capped_duplication():
    n = qc.corrected(100_000, 150_000, 1, 50_000)
    assert n > 50_000 and qc.corrected(150_000, 150_000, 1, 50_000) == 50_000


def test_insert_summary(spark):
    d = spark.createDataFrame([(40, 2), (60, 2), (100, 1), (-1, 2)], "insert_size int, n_pairs long")
    r = inserts.insert_summary(d).first()
    assert (r["known"], r["unknown"], r["peak"], r["median"]) == (5, 2, 40, 60)


def test_umi(spark):
    d = spark.createDataFrame([("a/1 x", "AACCGGTTACGTAAAA", "I" * 16, "a/2", "TTGGCCAAACGTCCCC", "I" * 16)], "h1 string, s1 string, q1 string, h2 string, s2 string, q2 string")
    r = transform.move_umi(d, 8, 4).first()
    assert r["h1"] == "a:AACCGGTT_TTGGCCAA/1 x" and r["s1"] == "AAAA" and r["h2"] == "a:AACCGGTT_TTGGCCAA/2"


def test_filters(spark):
    o = filters.Filter(min_length=5, max_n=1, low_quality=10, max_low_percent=40)
    rows = [("", "", "too_short"), ("ACGTA", "IIIII", None), ("ACG", "III", "too_short"), ("NNACGT", "IIIIII", "too_many_n"), ("NNACGT", "######", "low_quality"), ("nnACGT", "IIIIII", None)]
    d = spark.createDataFrame(rows, "s string, q string, want string").withColumn("got", filters.read_reason(F.col("s"), F.col("q"), o))
    assert all(r["want"] == r["got"] for r in d.collect())


def test_primes():
    a, b = inserts.hash_primes()
    assert len(a) == len(b) == 512 and a[0] == 10007 and b[0] == 20011


def starts(read, adapter):
    at = int(transform.adapter_starts(transform.Reads.of([read]), adapter)[0])
    return None if at == transform.NONE else at


def overlap(a, b):
    offset, length = transform.find_overlaps(transform.Reads.of([a]), transform.Reads.of([b]))
    return (int(offset[0]), int(length[0])) if length[0] >= 0 else None


def test_adapter_and_overlap():
    assert starts("ACGTACGTAC" + "AGATCGGAAGAGC", "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA") == 10
    assert starts("ACGTACGTAC", "TTTTTTTT") is None
    frag = "ACGGTTCAGTTACGCATTGCAACGTGATCCAGTTACGATCCA"
    back = frag[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert overlap(frag, back) == (0, len(frag))
    assert overlap(frag + "AGATC", back + "AGATC") == (-5, len(frag))
    assert overlap("A" * 20, "T" * 20) is None


def plain_shift(a, b):
    for o in range(len(a) - 30):
        common = min(len(a) - o, len(b))
        if sum(x != y for x, y in zip(a[o : o + min(common, 50)], b)) <= min(5, common // 5):
            return o


def plain_overlap(a, b):
    b = "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(c, "N") for c in reversed(b.upper()))
    if (o := plain_shift(a, b)) is not None:
        return o, min(len(a) - o, len(b))
    if (o := plain_shift(b, a)) is not None:
        return -o, min(len(b) - o, len(a))


def plain_gap(longer, other, longest):
    found = 0
    for n in range(8, longest + 1):
        best = min((sum(longer[i] != other[i] for i in range(g)) + sum(longer[i + 1] != other[i] for i in range(g, n)) for g in range(1, n)), default=99)
        found = n if best <= n // 8 - 1 else found
    return found


def plain_adapter(r, a):
    n, m = len(r), len(a)
    for p in range(-4 if m >= 16 else -3 if m >= 12 else -2 if m >= 8 else 0, n - 4):
        shared = [(r[p + i], a[i]) for i in range(max(0, -p), min(m, n - p))]
        if sum(x != y for x, y in shared) <= min(n - p, m) // 8:
            return p
    if n > 5 and (g := plain_gap(r, a, min(n - 1, m))):
        return 0 if g == min(n - 1, m) else n - 1 - g
    if n > 4 and (g := plain_gap(a, r, min(n, m - 1))):
        return 0 if g == min(n, m - 1) else n - g


def plain_tail(s, q, w, least):
    if len(s) <= w:
        return 0
    ends = [e for e in range(w, len(s)) if sum(map(ord, q[e - w + 1 : e + 1])) >= w * (33 + least)]
    kept = 1 if not ends else len(s) if ends[-1] == len(s) - 1 else ends[-1] - w + 2
    return len(s[:kept].rstrip("N"))


def plain_poly_g(s, least):
    other, first, scanned = 0, len(s), 0
    for scanned, c in enumerate(reversed(s)):
        first, other = (len(s) - 1 - scanned, other) if c == "G" else (first, other + 1)
        if other > 5 or (other > (scanned + 1) // 8 and scanned + 1 >= least):
            break
    else:
        scanned = len(s)
    return first if scanned >= least else len(s)


ADAPTERS = [("AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"), ("CTGTCTCTTATACACATCT", "CTGTCTCTTATACACATCT"), ("ACGTT", "GGGGACCA")]


def made_pairs(seed, adapters):
    """Pairs of fragments read from both ends, with errors, gaps, Ns, poly-G ends, empty and short mates."""
    rng = random.Random(seed)
    base = lambda n, of="ACGT": "".join(rng.choice(of) for _ in range(n))
    rows = [("", ""), ("", base(40)), (base(40), ""), ("G" * 12, "G" * 12), (adapters[0], adapters[1]), ("N" * 9, base(9))]
    for _ in range(150):
        frag = base(rng.choice([0, 2, 3, 20, 30, 31, 45, 60, 75, 120]))
        back = frag[::-1].translate(str.maketrans("ACGT", "TGCA"))
        mates = []
        for text, adapter in ((frag, adapters[0]), (back, adapters[1])):
            mate = list((text + adapter + base(40))[: rng.choice([5, 24, 40, 60, 80])])
            for _ in range(rng.choice([0, 0, 1, 3, 6])):
                if mate:
                    mate[rng.randrange(len(mate))] = rng.choice("ACGTN")
            if mate and rng.random() < 0.3:
                del mate[rng.randrange(len(mate))]
            mates.append("".join(mate) + "G" * rng.choice([0, 0, 9, 12]) + "N" * rng.choice([0, 0, 3]))
        rows.append(tuple(mates))
    return rows


@pytest.mark.parametrize("adapters", ADAPTERS)
def test_batches_of_pairs_match_the_plain_rules(adapters):
    rows = made_pairs(4, adapters)
    first, second = (transform.Reads.of([r[k] for r in rows]) for k in (0, 1))
    offset, length = transform.find_overlaps(first, second)
    assert [(o, n) if n >= 0 else None for o, n in zip(offset.tolist(), length.tolist())] == [plain_overlap(*r) for r in rows]
    for k, mates in ((0, first), (1, second)):
        got = [None if x == transform.NONE else x for x in transform.adapter_starts(mates, adapters[k]).tolist()]
        assert got == [plain_adapter(r[k], adapters[k]) for r in rows]
        rng = random.Random(k)
        quals = ["".join(chr(rng.randrange(33, 74)) for _ in r[k]) for r in rows]
        assert transform.tail_kept(mates, transform.Reads.of(quals), 4, 20).tolist() == [plain_tail(r[k], q, 4, 20) for r, q in zip(rows, quals)]
        assert transform.poly_g_kept(mates, 10).tolist() == [plain_poly_g(r[k], 10) for r in rows]


def test_long_reads_in_small_chunks(monkeypatch):
    rng = random.Random(8)
    frag = "".join(rng.choice("ACGT") for _ in range(5000))
    back = frag[::-1].translate(str.maketrans("ACGT", "TGCA"))
    monkeypatch.setattr(transform, "CELLS", 1 << 10)
    monkeypatch.setattr(transform, "MATRIX_BYTES", 1 << 9)
    got = transform.by_groups([[frag, "ACGT", frag], [back[:3000], None, "T" * 40]], lambda a, b: dict(zip("ol", transform.find_overlaps(a, b))))
    assert got["o"].tolist()[0] == 2000 and got["l"].tolist() == [3000, -1, -1]


def pair_frame(spark, rows):
    return spark.createDataFrame([(i, f"r{i}", a, "I" * len(a), f"r{i}", b, "I" * len(b)) for i, (a, b) in enumerate(rows)], "idx long, h1 string, s1 string, q1 string, h2 string, s2 string, q2 string")


def test_a_run_without_options_is_a_copy(spark):
    rows = made_pairs(5, ADAPTERS[0])
    with process.Run(pair_frame(spark, rows), process.Options()) as run:
        kept = {r["idx"]: (r["s1"], r["s2"], r["reason_pair"]) for r in run.decided.collect()}
        # A read without bases is too short whatever the options.
        assert kept == {i: (a, b, None if a and b else "too_short") for i, (a, b) in enumerate(rows)}
        assert run.insert_sizes().count() == 0


def test_insert_sizes_of_a_run(spark):
    """Inserts of known sizes; the tail is cut before mates are compared."""
    rng = random.Random(2)
    frag = "".join(rng.choice("ACGT") for _ in range(90))
    end = "TTGACCAGTACGATACCGGATTACAGCCATTGCAAGTCCATGACTTAGCAA"
    rows, want = [], []
    for insert, n1, n2, size in ((40, 50, 50, 40), (31, 50, 50, 31), (30, 50, 50, -1), (50, 50, 50, 50), (60, 50, 50, 60), (69, 50, 50, 69), (70, 50, 50, -1), (45, 50, 40, 50), (45, 40, 50, 40)):
        back = frag[:insert][::-1].translate(str.maketrans("ACGT", "TGCA"))
        rows.append(((frag[:insert] + end)[:n1], (back + end)[:n2]))
        want.append(size)
    pairs = pair_frame(spark, rows)
    trim = transform.Trim(adapter1=ADAPTERS[1][0], adapter2=ADAPTERS[1][1])
    with process.Run(pairs, process.Options(trim=trim)) as run:
        got = {r["insert_size"]: r["n_pairs"] for r in run.insert_sizes().collect()}
    assert got == {s: want.count(s) for s in want}
    low = pairs.where("idx = 4").withColumn("q1", F.expr("concat(substr(q1, 1, 44), repeat('#', 6))"))  # the tail takes six bases
    tail = transform.Trim(tail_window=1, tail_quality=20, adapter1=ADAPTERS[1][0], adapter2=ADAPTERS[1][1])
    with process.Run(low, process.Options(trim=tail)) as run:
        assert run.insert_sizes().first()["insert_size"] == 60
    with process.Run(low.withColumn("q2", F.expr("repeat('#', 50)")), process.Options(trim=transform.Trim(4, 30, None, *ADAPTERS[1]))) as run:
        assert {r["n_pairs"] for r in run.insert_sizes().collect()} <= {1}


@pytest.mark.parametrize("name", ["filter_counts", "qc_summary_retained", "filter_reasons", "trim_all_steps"])
def test_plans_stay_small(spark, sf, name):
    """A filter on reasons must not copy the trimming rules into itself."""
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000
