"""Insert sizes from mate overlaps, and pair duplication by two hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import flat, places, sums

#: Fixed values of the histogram and the hashes.
LARGEST = 512
HASH_ROW, HASH_START, HASH_GAP = 512, 10_000, 10_000
BASE_VALUES = {"A": 7, "C": 74, "G": 31, "T": 222}
OTHER_VALUE = 13


def insert_sizes(trimmed: DataFrame, length1: Column | None = None, length2: Column | None = None) -> DataFrame:
    """Pairs by insert size; -1 stands for unknown. Needs ov_offset, ov_length and the lengths of the compared mates (of s1 and s2)."""
    length1, length2 = (F.length("s1"), F.length("s2")) if length1 is None else (length1, length2)
    size = F.when(F.col("ov_offset") > 0, length1 + length2 - F.col("ov_length")).otherwise(F.col("ov_length"))
    size = F.when(size < LARGEST, size).otherwise(-1)
    return trimmed.groupBy(F.coalesce(size, F.lit(-1)).alias("insert_size")).agg(F.count("*").alias("n_pairs"))


def insert_summary(sizes: DataFrame) -> DataFrame:
    """Known and unknown pairs, the smallest most frequent size, and the median: one pass over at most 513 rows of counts."""
    row = F.struct(F.col("insert_size").cast("long").alias("size"), F.col("n_pairs").alias("n"))
    all_ = sizes.agg(F.array_sort(F.collect_list(F.when(F.col("insert_size") >= 0, row))).alias("k"), F.coalesce(F.sum(F.when(F.col("insert_size") < 0, F.col("n_pairs"))), F.lit(0)).alias("unknown"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    d = all_.withColumn("known", total(F.col("k"))).withColumn("half", F.col("known") - F.floor(F.col("known") / 2))
    reached = F.filter(F.transform("k", lambda x, i: F.struct(x["size"].alias("size"), total(F.slice("k", F.lit(1), i + 1)).alias("upto"))), lambda x: x["upto"] >= F.col("half"))
    peak = F.array_max(F.transform("k", lambda x: F.struct(x["n"].alias("n"), (-x["size"]).alias("m"))))["m"]
    return d.select("known", "unknown", (-peak).alias("peak"), F.get(reached, F.lit(0))["size"].alias("median"))


@cache
def hash_primes() -> tuple[list[int], list[int]]:
    """Two rows of primes: the next prime after every step of the gap, in turn for either row."""
    rows: tuple[list[int], list[int]] = ([], [])
    small = [p for p in range(2, 4000) if all(p % q for q in range(2, int(p**0.5) + 1))]
    number = HASH_START
    for i in range(2 * HASH_ROW):
        number += 1
        while any(number % p == 0 for p in small if p * p <= number):
            number += 1
        rows[i % 2].append(number)
        number += HASH_GAP
    return rows


def hashed_pairs(pairs: DataFrame) -> DataFrame:
    """idx, hash1, hash2: over the joined mates the sum of prime x (value of the base + place), modulo 2^32, for either row.

    One narrow stage over the bytes of many pairs; an empty pair's hashes are 0.
    """
    names = ["idx", "hash1", "hash2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        primes = np.array(hash_primes(), np.uint64)
        values = np.full(256, OTHER_VALUE, np.uint64)
        values[[ord(b) for b in BASE_VALUES]] = list(BASE_VALUES.values())
        for batch in batches:
            joined, at = flat(batch.column(1))
            place = places(at)
            term = values[joined] + place.astype(np.uint64)
            found = [(sums(row[place % HASH_ROW] * term, at) & np.uint64(0xFFFFFFFF)).astype(np.int64) for row in primes]  # 2^64 is a multiple of 2^32
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], names)

    kind = pairs.schema["idx"].dataType.simpleString()
    return pairs.select("idx", F.concat(*(F.coalesce(c, F.lit("")) for c in ("s1", "s2"))).alias("both")).mapInArrow(run, f"idx {kind}, hash1 long, hash2 long")


def pair_duplicates(pairs: DataFrame) -> DataFrame:
    """Adds ``duplicate``: an earlier pair has the first hash and an earlier pair has the second one.

    The least index of each hash value that several pairs have is an aggregation with partial sums, so a value that many
    pairs share is not gathered anywhere; hashes that occur once take no part in what is joined back. The hashes are
    kept (24 bytes a pair, on disk where memory is short) until the session ends or its cache is cleared.
    """
    hashed = hashed_pairs(pairs).persist(StorageLevel.MEMORY_AND_DISK)
    out = hashed
    for r in (1, 2):
        first = hashed.groupBy(f"hash{r}").agg(F.min("idx").alias(f"first{r}"), F.count("*").alias("n")).where("n > 1").drop("n")
        out = out.join(first, f"hash{r}", "left")
    later = lambda r: F.coalesce(F.col("idx") > F.col(f"first{r}"), F.lit(False))
    return out.select("idx", "hash1", "hash2", (later(1) & later(2)).alias("duplicate"))
