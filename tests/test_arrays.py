"""Counts in arrays, capped keys, the closed correction and the generator's jumps, against plain loops."""

import collections
import math
import random

import numpy as np
import pytest

from strandframe import queries
from strandframe.functions import arrays
from strandframe.operators import inserts, qc, sample, stats

READ = "idx long, header string, seq string, qual string"


def reads_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, f"a:b:c:d:{i % 3 + 1}:1:2", s, q) for i, (s, q) in enumerate(rows)], READ).repartition(parts)


def some_reads(rng, n, longest):
    sizes = [rng.choice([0, 1, longest, rng.randrange(longest)]) for _ in range(n)]
    return [("".join(rng.choice("ACGTNacgtnRY") for _ in range(k)), "".join(chr(33 + rng.randrange(94)) for _ in range(k))) for k in sizes]


def test_base_counts(spark, monkeypatch):
    rows = some_reads(random.Random(1), 60, 2500)  # three blocks of cycles
    monkeypatch.setattr(arrays, "HELD", 2)
    want = collections.Counter((c + 1, b.upper() if b.upper() in "ACGTN" else "?", ord(q) - 33) for s, qs in rows for c, (b, q) in enumerate(zip(s, qs)))
    assert {(r["cycle"], r["base"], r["q"]): r["n"] for r in qc.per_cycle(reads_of(spark, rows)).collect()} == want
    assert qc.per_cycle(reads_of(spark, rows).limit(0)).count() == 0


def test_numbers_of_reads(spark):
    rows = some_reads(random.Random(2), 50, 90) + [("ACG", "II"), ("", "")]
    d = reads_of(spark, rows).unionByName(spark.createDataFrame([(99, "h", None, None)], READ))
    got = {r["idx"]: r for r in arrays.with_numbers(d, ["idx"]).collect()}
    for i, (s, q) in enumerate(rows):
        want = [len(s), *(s.upper().count(b) for b in "ACGTN"), sum(ord(c) - 33 for c in q), sum(c >= "5" for c in q), sum(c >= "?" for c in q)]
        assert [got[i][c] for c in arrays.NUMBERS] == want
    assert got[99]["len"] == 0
    total = stats.read_stats(d).first()
    assert total["bases"] == sum(len(s) for s, _ in rows) and total["quality_sum"] == sum(ord(c) - 33 for _, q in rows for c in q)


def plain_groups(cycles):
    """Nine single cycles, then groups that end before multiples of the width."""
    width = next(w for w in (1, *(d * 10**e for e in range(5) for d in (2, 5, 10))) if cycles <= 75 or (w > 1 and 9 + -(-(cycles - 9) // w) < 75))
    out, at = [], 1
    while at <= cycles:
        last = at if width == 1 or at <= 9 else min(cycles, at // width * width + width - 1)
        out.append((at, last))
        at = last + 1
    return out


@pytest.mark.parametrize("cycles, groups, last", [(75, 75, (75, 75)), (76, 43, (76, 76)), (151, 38, (150, 151)), (335, 42, (330, 335)), (1310, 36, (1300, 1310)), (30_000, None, None)])
def test_groups_of_long_reads(spark, cycles, groups, last):
    found = sorted({(r["first"], r["last"]) for r in qc.cycle_groups(spark, cycles).collect()})
    assert found == plain_groups(cycles) and (groups is None or (len(found), found[-1]) == (groups, last))


def test_base_quality_of_long_reads(spark):
    rows = some_reads(random.Random(3), 400, 160)
    got = {(r["first"], r["last"]): r for r in qc.base_quality(qc.per_cycle(reads_of(spark, rows)), None).collect()}
    columns = [sorted(ord(q[c]) - 33 for _, q in rows if len(q) > c) for c in range(max(len(s) for s, _ in rows))]
    groups = plain_groups(len(columns))
    assert set(got) == set(groups) and len(columns) > 75
    for a, b in groups:
        part = columns[a - 1 : b]
        assert got[a, b]["mean"] == pytest.approx(sum(sum(c) / len(c) for c in part) / len(part), rel=1e-12)
        enough = [c for c in part if len(c) > 100]
        for name, p in qc.PERCENTILES.items():
            picked = [next(q for k, q in enumerate(c, 1) if sum(x <= q for x in c) >= len(c) * p // 100) for c in enough]
            assert (got[a, b][name] is None) == (not picked) and (not picked or got[a, b][name] == pytest.approx(sum(picked) / len(picked)))


@pytest.mark.parametrize("q30, median, upper", [(50, None, None), (51, 10, 30), (52, 30, 30)])
def test_percentiles_need_over_100_reads(spark, q30, median, upper):
    r = qc.base_quality(qc.per_cycle(reads_of(spark, [("A", "+")] * 50 + [("A", "?")] * q30)), None).first()
    assert (r["p50"], r["p75"]) == (median, upper) and r["mean"] == pytest.approx((500 + 30 * q30) / (50 + q30))


def test_tiles_of_many_reads(spark):
    """Of reads with a quality the first 10,000 count, then every tenth."""
    rng = random.Random(4)
    rows = [("A" * k, chr(33 + i % 40) * k) for i, k in enumerate(rng.choices([0, 3, 5], k=26_000))]
    got = {(r["tile"], r["first"]): r["mean"] for r in qc.tile_quality(reads_of(spark, rows), None).collect()}
    full = [(i, q) for i, (_, q) in enumerate(rows) if q]
    used = [x for rank, x in enumerate(full, 1) if rank <= 10_000 or (rank - 10_000) % 10 == 0]
    assert len(used) < len(full)
    for tile in (1, 2, 3):
        for c in range(5):
            scores = [ord(q[c]) - 33 for i, q in used if len(q) > c and i % 3 + 1 == tile]
            assert got[tile, c + 1] == pytest.approx(sum(scores) / len(scores), rel=1e-12)


@pytest.mark.parametrize("cap, width", [(50, 8), (400, 64), (100_000, 16), (1, 4)])
def test_first_keys(spark, monkeypatch, cap, width):
    monkeypatch.setattr(qc, "KEY_RANGE", width)
    rng = random.Random(cap)
    rows = [(rng.choice(["acgt", "ACGT", "G" * 60, "".join(rng.choices("ACGT", k=5))]), "") for _ in range(3000)]
    d = reads_of(spark, rows, 5)
    first, n = {}, collections.Counter()
    for i, (s, _) in enumerate(rows):
        key = s.upper()[:50]
        n[key] += 1
        first.setdefault(key, i)
    want = sorted((i, k, n[k]) for k, i in first.items())[:cap]
    assert sorted((r["first_idx"], r["key"], r["n"]) for r in qc.sequence_keys(d, cap).collect()) == want
    assert qc.sequence_keys(d.limit(0), cap).count() == 0


def test_duplication_above_the_cap(spark):
    """100,000 keys that are stored, one that isn't, and half of the first again: tabulated values."""
    key = lambda i: "".join("ACGT"[i >> 2 * k & 3] for k in range(10))
    order = [*range(100_000), *range(50_000)]
    d = spark.createDataFrame([(i, key(k)) for i, k in enumerate(order)], "idx long, seq string")
    rows = {r["level"]: r for r in qc.duplication_levels(d, digits=None).collect()}
    assert rows["1"]["left_percent"] == pytest.approx(70.00002000011865, rel=1e-12) and rows["1"]["percent"] == pytest.approx(40.0000400002373, rel=1e-12)
    more = spark.createDataFrame([(i, key(k)) for i, k in enumerate([*range(100_001), *range(50_000)])], "idx long, seq string")
    assert {r["key"] for r in qc.first_keys(more).where("first_idx > 99990").collect()} == {key(i) for i in range(99_991, 100_000)}


def stepwise(limit, total, level, observed):
    """The correction term by term."""
    if limit == total or total - observed < limit:
        return float(observed)
    least, unseen = 1 - observed / (observed + 0.01), 1.0
    for i in range(limit):
        unseen *= (total - level - i) / (total - i)
        if unseen < least:
            return float(observed)
    return observed / (1 - unseen)


def test_correction_in_closed_form(monkeypatch):
    rng = random.Random(5)
    cases = [(100_000, 150_000, 1, 50_000), (100_000, 150_000, 2, 50_000), (100_000, 300_000, 3, 10), (1000, 10**6, 40, 7), (50_000, 10**8, 1500, 10), (100_000, 10**9, 9, 5), (5, 5, 1, 1), (10, 100, 95, 1), (90_000, 10**6, 30, 60)]
    cases += [(rng.randrange(1, 3000), rng.randrange(3000, 10**6), rng.randrange(1, 4000), rng.randrange(1, 1000)) for _ in range(200)]
    for terms in (qc.TERMS, 64):  # also with nearly all terms integrated
        monkeypatch.setattr(qc, "TERMS", terms)
        for case in cases:
            assert qc.corrected(*case) == pytest.approx(stepwise(*case), rel=1e-9)
    assert qc.corrected(10**9, 10**12, 700, 3) == pytest.approx(3 / (1 - math.exp(700 * math.log1p(-1e-3))), rel=1e-6)


def test_pair_duplicates(spark):
    cases = [("ACGTACGT", "TTGGCCAA", 0), ("ACGTACGT", "TTGGCCAA", 1), ("TTGGCCAA", "ACGTACGT", 0), ("ACGTACGT", "TTGGCCAT", 0), ("ACGTAC", "GTTTGGCCAA", 1), ("acgtNNNN", "TTGGCCAA", 0), ("NNNNnnnn", "TTGGCCAA", 1), ("", "", 0), ("", "", 1)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "idx long, s1 string, s2 string").repartition(4)
    got = {r["idx"]: r for r in inserts.pair_duplicates(d).collect()}
    assert [int(got[i]["duplicate"]) for i in range(9)] == [c[2] for c in cases]
    assert (got[7]["hash1"], got[7]["hash2"]) == (0, 0)
    long = "ACGTN" * 300
    one = spark.createDataFrame([(0, long, "AC")], "idx long, s1 string, s2 string")
    value = {"A": 7, "C": 74, "G": 31, "T": 222}
    want = [sum(row[i % 512] * (value.get(b, 13) + i) for i, b in enumerate(long + "AC")) % 2**32 for row in inserts.hash_primes()]
    r = inserts.hashed_pairs(one).first()
    assert [r["hash1"], r["hash2"]] == want


def test_jumps_of_the_generator():
    state = sample.seeded(7)
    after = [state]
    for _ in range(40):
        after.append(sample.twist(after[-1]))
    assert sample.minimal_polynomial().bit_length() - 1 == sample.DEGREE
    for blocks in (1, 2, 7, 39):
        [jump] = sample.jump_polynomials(312 * blocks, 1)
        assert (sample.twist(sample.jumped(state, jump)) == sample.twist(after[blocks])).all()
    # Beyond 10^9 draws: the same place by other ways.
    span = 312 * sample.SPAN_BLOCKS
    doubled = sample.jump_polynomials(span, 8)
    [whole] = sample.jump_polynomials(span * 70, 1)
    assert span * 70 > 10**9
    for order in ((1, 2, 6), (6, 1, 2)):
        there = state
        for k in order:
            there = sample.jumped(there, doubled[k])
        assert (sample.twist(there) == sample.twist(sample.jumped(state, whole))).all()


def test_spans_of_draws(spark, monkeypatch):
    like = spark.range(1)
    whole = sorted(map(tuple, sample.draws(like, 5000).collect()))
    monkeypatch.setattr(sample, "SPAN_BLOCKS", 2)
    monkeypatch.setattr(sample, "BATCH_BLOCKS", 1)
    assert sorted(map(tuple, sample.draws(like, 5000).collect())) == whole and len(whole) == 5000
    assert np.allclose([u for _, u in whole], queries.reference_draws(11, 5000), rtol=0, atol=0)
    assert sample.draws(like, 0).count() == 0
