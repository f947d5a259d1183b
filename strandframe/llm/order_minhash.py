"""Order MinHash fingerprints: signatures that are sensitive to edit distance.

For each component of the signature the few smallest k-mers under the component's hash are selected, where equal k-mers
of a text are numbered by occurrence; they are put back in text order and the tuple is hashed. Two texts agree in a
component if they share these k-mers and their order, so the share of equal components falls with edits and moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import whole_text

K = 8
TUPLE = 2
COMPONENTS = 32
ROWS_PER_RANGE = 2000
MOST_RANGES = 20_000

_seeds = np.random.default_rng(20240607)
XORS = _seeds.integers(0, 1 << 63, 256, dtype=np.uint64)[:, None]
ODDS = (_seeds.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1))[:, None]
STEPS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * STEPS[0]
    x = (x ^ (x >> np.uint64(29))) * STEPS[1]
    return x ^ (x >> np.uint64(32))


def numbered_kmers(text: str, k: int = K) -> np.ndarray:
    """A 64-bit hash of every (k-mer, occurrence number) in text order; a shorter text is one k-mer."""
    h = mix(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1))
    width = 1
    if len(h) < k:
        h = np.array([len(h), *h.tolist()], np.uint64)
        return mix(np.array([int(np.bitwise_xor.reduce(h * (np.arange(len(h), dtype=np.uint64) * np.uint64(2) + np.uint64(1))))], np.uint64))
    full = h
    while width * 2 <= k:
        h = h[: len(h) - width] * STEPS[2] + mix(h[width:])
        width *= 2
    if width < k:
        h = h[: len(full) - k + 1] * STEPS[0] + mix(h[k - width : len(full) - width + 1])
    n = len(h)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    key = np.sort((mix(h) >> bits << bits) | np.arange(n, dtype=np.uint64))  # groups equal k-mers, in text order
    at = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.empty(n, bool)
    new[0], new[1:] = True, (key[1:] >> bits) != (key[:-1] >> bits)
    place = np.arange(n)
    occurrence = np.empty(n, np.uint64)
    occurrence[at] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return mix(h + occurrence * STEPS[1])


def signature(text: str, k: int = K, size: int = TUPLE, components: int = COMPONENTS) -> np.ndarray:
    """``components`` unsigned 16-bit values; equal texts have equal signatures."""
    g = numbered_kmers(text, k)
    n = len(g)
    v = (g ^ XORS[:components]) * ODDS[:components]
    pick = min(size, n)
    limit = np.uint64(min((1 << 64) - 1, (12 + 6 * pick) * (1 << 64) // n))
    rows, cols = np.nonzero(v <= limit)
    counts = np.bincount(rows, minlength=components)
    if counts.min() >= pick:
        order = np.lexsort((cols, v[rows, cols], rows))
        first = np.cumsum(counts) - counts
        chosen = cols[order[first[:, None] + np.arange(pick)]]
    else:
        chosen = np.argsort(v, axis=1, kind="stable")[:, :pick]
    tokens = g[np.sort(chosen, axis=1)]
    out = np.full(components, np.uint64(pick))
    for j in range(pick):
        out = mix(out * STEPS[2] + tokens[:, j])
    return (out >> np.uint64(48)).astype(np.uint16)


def as_text(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = TUPLE, components: int = COMPONENTS) -> DataFrame:
    """doc_id and fingerprint (hex) of every whole text; null texts count as empty. One narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [as_text(signature(t or "", k, size, components)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def number_of(col: str, kind: str) -> Column:
    """A number that never falls as ids grow; of text the first six bytes."""
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(col, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(col).cast("double")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt to ranges of ids so that each row's follower in descending order of ids comes right behind it.

    Columns: part, extra, doc_id, h, text, sorted within partitions. The first row of each range is also sent, marked
    extra, to the range before it; so whole texts are shuffled once and no task sees all rows. Only one row per range
    (at most MOST_RANGES) reaches the driver.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).withColumn("id_", number_of("doc_id", docs.schema[id_col].dataType.simpleString()))
    n, numbered = d.agg(F.count("*"), F.count("id_")).first()
    ranges = min(MOST_RANGES, max(1, -(-numbered // ROWS_PER_RANGE)))
    cuts = sorted(set(d.where("id_ is not null").approxQuantile("id_", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    deal = Bucketizer(splits=[-float("inf"), *(cuts or [0.0]), float("inf")], inputCol="id_", outputCol="part_", handleInvalid="keep")
    # Rows without an id come after all others, in ranges of the hash of their text.
    rest = min(MOST_RANGES, max(1, -(-(n - numbered) // ROWS_PER_RANGE)))
    last = len(cuts) + 1 + F.floor((0.5 - F.xxhash64("text") / 2.0**64) * (rest * 0.999999)).cast("int")
    d = (deal.transform(d) if cuts else d.withColumn("part_", F.lit(0.0))).withColumn("part", F.when(F.col("id_").isNull(), last).otherwise(len(cuts) - F.col("part_").cast("int")))
    d = d.withColumn("h", F.xxhash64("text")).select("part", "doc_id", "h", "text")
    heads = d.groupBy("part").agg(F.max(F.struct("doc_id", "h")).alias("head")).orderBy("part").collect()
    rows = [(r["part"], r["head"]["doc_id"], r["head"]["h"], heads[i - 1]["part"]) for i, r in enumerate(heads)]
    of = docs.sparkSession.createDataFrame(rows, f"part int, id_ {docs.schema[id_col].dataType.simpleString()}, h_ long, to int")
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_"))
    d = d.join(F.broadcast(of), "part", "left")  # a row per range
    own = F.struct(F.col("part"), F.lit(False).alias("extra"))
    more = F.struct(F.col("to").alias("part"), F.lit(True).alias("extra"))
    d = d.select(F.explode(F.when(same, F.array(own, more)).otherwise(F.array(own))).alias("x"), "doc_id", "h", "text").select("x.*", "doc_id", "h", "text")
    return d.repartition(max(len(heads), 1), "part").sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), F.desc("h"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = TUPLE, components: int = COMPONENTS) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is replaced by the start of the next document.

    The next document is the one with the next smaller id; after the last comes the first. Rows of equal id follow by a
    hash of their text; rows without an id come last. Null texts count as empty. A single row follows itself. Repeated rows
    are reported as often as they occur. Further columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, id, text, signature of the row that waits for its follower

        def report(row: tuple, text: str, sign: np.ndarray) -> tuple:
            _, doc_id, own, s = row
            third = len(own) // 3
            edited = own[: len(own) - third] + text[:third]
            e = signature(edited, k, size, components)
            sha = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
            return doc_id, len(own), sha, as_text(s), as_text(e), likeness(s, e), likeness(s, sign)

        for b in batches:
            out = []
            for part, extra, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("part", "extra", "doc_id", "text"))):
                if extra and (held is None or held[0] != part):
                    continue  # a repeated extra row
                s = signature(text, k, size, components)
                if held is not None and held[0] == part:
                    out.append(report(held, text, s))
                held = None if extra else (part, doc_id, text, s)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    kind = docs.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    text_names = ["edited_sha256", "fingerprint", "edited_fingerprint"]
    schema = pa.schema([("doc_id", id_type), ("n_chars", pa.int64()), *((c, pa.string()) for c in text_names), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    sql = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).drop("h").mapInArrow(run, sql)
