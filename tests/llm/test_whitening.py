"""Whitening against eigenvectors of the covariance matrix, on small fixtures."""

import math

import numpy as np
import pytest

from strandframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component string"


def made(spark, rows, parts=7):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + [3, -2, 0, 1, 0, 5]
    out = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]
    out += [(300 + i, out[0][1]) for i in range(150)]  # a third are copies
    out += [(7, out[7][1]), (None, out[8][1]), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [math.nan] * 6), (903, [math.inf] * 6), (904, [1.0, 2.0]), (905, [])]
    return out + [(906, [-0.0] * 6)]


def test_whitening(spark, rows):
    got = whitening.whiten(made(spark, rows)).collect()
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * c) for c in v] for _, v in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    power, vectors = np.linalg.eigh(centred.T @ centred / n)
    power, vectors = power[::-1], vectors[:, ::-1]
    want = (x - sums / n) @ vectors[:, :4] / np.sqrt(power[:4])
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n}
    sign = {}
    left = {}
    for k, (i, _) in enumerate(kept):
        left.setdefault(i, []).append(k)
    for r in got:
        c, k = r["component"] - 1, left[r["vec_id"]][0]
        assert abs(abs(r["whitened"]) - abs(want[k, c])) < 1e-9
        if abs(want[k, c]) > 1e-6:
            assert sign.setdefault(c, r["whitened"] * want[k, c] > 0) == (r["whitened"] * want[k, c] > 0)
        assert abs(r["explained"] / (power[c] / power.sum()) - 1) < 1e-9
        assert r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], sums))
        assert r["identity_error"] < 1e-9


def test_tree_of_many_partitions(spark, rows):
    """More than FAN_IN squared factors: the tree has three levels, and gives what one partition gives."""
    few, many = (whitening.whiten(made(spark, rows[:300], p)) for p in (1, 40))
    key = lambda r: (r["vec_id"], r["component"])
    for a, b in zip(sorted(few.collect(), key=key), sorted(many.collect(), key=key)):
        assert abs(a["whitened"] - b["whitened"]) < 1e-9 and a["deviation"] == b["deviation"]
    parts = spark.range(0, 300, 1, 300).selectExpr("id as part", "cast(cast(id as string) as binary) as value")
    assert whitening.tree_merge(parts, lambda values: str(sum(map(int, values))).encode()) == str(sum(range(300))).encode()
    assert whitening.tree_merge(parts.limit(0), b"".join) is None


def test_edges(spark, rows):
    assert whitening.whiten(made(spark, [])).count() == 0
    assert whitening.whiten(made(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(made(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in one)
    line = whitening.whiten(made(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and len(line) == 10
    assert all(abs(r["explained"] - (r["component"] == 1)) < 1e-12 and r["identity_error"] < 1e-9 for r in line)
    far = whitening.whiten(made(spark, [(0, [0.0]), (1, [1e9]), (2, [3e6])])).collect()
    assert next(r for r in far if r["vec_id"] == 1)["deviation"] is None and all(math.isfinite(r["whitened"]) for r in far)


def test_exact_numbers():
    model = whitening.Whitening(3, (10**18, -7), np.eye(2), np.ones(2), np.ones(2))
    x = np.array([[10**18 // 3, 5], [0, 0], [10**18 // 3 + 10**9 - 1, 5], [10**18 // 3 + 2 * 10**9, 5]])
    assert model.deviations(x).to_pylist() == [d if (d := (3 * a - 10**18) ** 2 + (3 * b + 7) ** 2) < 2**63 else None for a, b in x.tolist()]
    assert np.allclose(model.centred(x)[0], [-1 / 3, 5 + 7 / 3], rtol=1e-15)
