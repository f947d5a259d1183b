"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from strandframe.llm import runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_runs string, start int"


def brute_force(words, exponent=4, shortest=6):
    """(start, end, period) of all runs: stretches where words q apart are equal, for every q."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        at = 0
        while at < len(words) - q:
            begin = at
            while at < len(words) - q and words[at] == words[at + q]:
                at += 1
            if at - begin + q >= max(shortest, exponent * q) and at > begin:
                found.setdefault((begin, at + q), q)
            at += 1
    return sorted((i, j, q) for (i, j), q in found.items())


def some_words(rng):
    letters, words = rng.randrange(1, 6), []
    for _ in range(rng.randrange(0, 7)):
        kind = rng.randrange(3)
        if kind == 0:
            words += [rng.randrange(letters) for _ in range(rng.randrange(25))]
        elif kind == 1:
            words += [rng.randrange(letters) for _ in range(rng.randrange(1, 8))] * rng.randrange(1, 9)
        elif words:
            at = rng.randrange(len(words))
            words += words[at : at + rng.randrange(1, 40)] * rng.randrange(1, 6)
    return words


@pytest.mark.parametrize("exponent, shortest", [(4, 6), (2, 2), (3, 8), (5, 6)])
def test_all_runs(exponent, shortest):
    rng = random.Random(exponent)
    for _ in range(250):
        texts = [some_words(rng) for _ in range(rng.randrange(1, 4))]
        texts.append(texts[0])
        want, off = [], 0
        for t in texts:
            want += [(i + off, j + off, q) for i, j, q in brute_force(t, exponent, shortest)]
            off += len(t)
        codes = np.array([w for t in texts for w in t], np.int32)
        got = runs.runs_of(codes, np.repeat(np.arange(len(texts)), [len(t) for t in texts]), exponent, shortest)
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[2]))


def test_longest_previous_factors():
    rng = random.Random(9)
    for _ in range(60):
        s = np.array([*(w for w in some_words(rng)), 1000])
        factor, source = runs.Suffixes(s).previous_factors()
        common = lambda a, b: next((k for k in range(len(s) - b) if s[a + k] != s[b + k]), len(s) - b)
        for i in range(len(s)):
            assert factor[i] == max((common(a, i) for a in range(i)), default=0)
            assert factor[i] == 0 or (source[i] < i and common(int(source[i]), i) == factor[i])


def report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = sorted(((i, j - i, q) for i, j, q in brute_force(words)), key=lambda r: (r[0], r[2]))
    gone = {k for i, m, q in found for k in range(i + q, i + m)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None,) * 3
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = digest(" ".join(w for k, w in enumerate(words) if k not in gone))
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join("%d,%d,%d\n" % r for r in found)), kept)


def test_report(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(" \t\n\r  ") * rng.randrange(1, 3) + f"w{w}é" for w in some_words(rng)) for _ in range(60)]
    texts += [None, "", " \n\t ", "x", "日本 " * 500, "a b " * 2000 + "c " * 900, " ".join(str(rng.randrange(300)) for _ in range(3000))]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[3]), (None, "a " * 8), (None, None)]
    d = spark.createDataFrame([(i, t, "en", "s", 1, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in runs.run_report(d).collect()]
    assert sorted(got, key=repr) == sorted((report(i, t) for i, t in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 12 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    assert runs.run_report(d.limit(0)).collect() == []


def test_query(spark, sf):
    from strandframe.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = [r for r in docs if len(r["text"] or "") < 20_000]
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in short:
        assert got[r["doc_id"]] == report(r["doc_id"], r["text"])


def test_chunks(monkeypatch, spark):
    """Texts are worked through in chunks; what a run is doesn't depend on them."""
    rows = [(i, "a b c " * (i % 7) + f"w{i} " * (i % 9), "", "", 1, "", 1) for i in range(200)]
    d = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    whole = runs.word_runs(d).collect()
    monkeypatch.setattr(runs, "CHUNK_CHARS", 50)
    batch = runs.pa.array([r[1] for r in rows])
    assert sum(len(t) for _, t in runs.texts_of(batch)) == len(rows) and len(list(runs.texts_of(batch))) > 50
    assert [(r["doc_id"], [tuple(x) for x in r["runs"]]) for r in whole] == [(i, [(s, e - s, q) for s, e, q in brute_force(t.split())]) for i, t, *_ in rows]
    with pytest.raises(ValueError):
        runs.word_runs(d, exponent=1)
