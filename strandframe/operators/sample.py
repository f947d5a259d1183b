"""Reproducible sampling in the order of records, by the 64-bit Mersenne Twister.

Draws depend on each other, but the generator is linear over bits: stepping it n words ahead is the polynomial x^n modulo
the generator's minimal polynomial, applied to the state. Each task finds the state of its own span of draws from a few
such polynomials (one for each power of two of spans), so no one steps through the draws of others. An exact sample is the
state of a reservoir of K slots after all draws, which is one aggregation: the last record that was put into each slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .validate import first_violation, violations

#: Fixed values of the 64-bit Mersenne Twister.
WORDS, MIDDLE = 312, 156
MATRIX = np.uint64(0xB5026F5AA96619E9)
UPPER, LOWER = np.uint64(0xFFFFFFFF80000000), np.uint64(0x7FFFFFFF)
INIT = 6364136223846793005
TEMPER = [(29, 0x5555555555555555), (-17, 0x71D67FFFEDA60000), (-37, 0xFFF7EEE000000000), (43, 0xFFFFFFFFFFFFFFFF)]

#: Fixed value: the degree of its minimal polynomial, 312 words less the 31 bits that no later word depends on.
DEGREE = 64 * WORDS - 31

DEFAULT_SEED = 11
#: Blocks of 312 draws in the span of one task, about 16 million draws; and in one batch of them.
SPAN_BLOCKS, BATCH_BLOCKS = 53_248, 128


def seeded(seed: int) -> np.ndarray:
    state = [seed & (1 << 64) - 1]
    for i in range(1, WORDS):
        state.append((INIT * (state[-1] ^ (state[-1] >> 62)) + i) & (1 << 64) - 1)
    return np.array(state, np.uint64)


def twist(state: np.ndarray) -> np.ndarray:
    """The next block of words. The second half needs the first, so two vector steps make a block."""
    new = np.empty_like(state)

    def step(high: np.ndarray, low: np.ndarray, far: np.ndarray) -> np.ndarray:
        x = (high & UPPER) | (low & LOWER)
        return far ^ (x >> np.uint64(1)) ^ np.where(x & np.uint64(1), MATRIX, np.uint64(0))

    half = WORDS - MIDDLE
    new[:half] = step(state[:half], state[1 : half + 1], state[MIDDLE:])
    new[half:-1] = step(state[half:-1], state[half + 1 :], new[: MIDDLE - 1])
    new[-1:] = step(state[-1:], new[:1], new[MIDDLE - 1 : MIDDLE])
    return new


def tempered(words: np.ndarray) -> np.ndarray:
    x = words.copy()
    for shift, mask in TEMPER:
        x ^= (x >> np.uint64(shift) if shift > 0 else x << np.uint64(-shift)) & np.uint64(mask)
    return x


@lru_cache(1)
def minimal_polynomial() -> int:
    """The polynomial over bits, as a number (bit i belongs to x^i), that every bit of the words in turn satisfies.

    Berlekamp and Massey's algorithm finds it from twice as many bits as its degree.
    """
    state, bits = seeded(DEFAULT_SEED), []
    while len(bits) < 2 * DEGREE:
        state = twist(state)
        bits += (state & np.uint64(1)).tolist()
    # The newest bit seen is the lowest, so that a discrepancy is the parity of one product.
    now, before, length, gap, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits[: 2 * DEGREE]):
        seen = seen << 1 | bit
        if not (now & seen).bit_count() & 1:
            gap += 1
        elif 2 * length <= n:
            now, before, length, gap = now ^ before << gap, now, n + 1 - length, 1
        else:
            now, gap = now ^ before << gap, gap + 1
    return int(bin(now)[2:].zfill(length + 1)[::-1], 2)  # a recurrence is its polynomial in the mirror


def reduced(polynomial: int) -> int:
    """The remainder modulo the minimal polynomial."""
    modulus = minimal_polynomial()
    degree = modulus.bit_length() - 1
    while (over := polynomial.bit_length() - 1 - degree) >= 0:
        polynomial ^= modulus << over
    return polynomial


def squared(polynomial: int) -> int:
    """Squares modulo the minimal polynomial: over bits, squaring puts a zero after every bit."""
    return reduced(int(bin(polynomial)[2:].replace("0", "00").replace("1", "01"), 2))


def jump_polynomials(words: int, doublings: int) -> list[int]:
    """x^words modulo the minimal polynomial, and its successive squares: jumps by 1, 2, 4, ... times that many words."""
    power = 1
    for digit in bin(words)[2:]:
        power = squared(power)
        if digit == "1":
            power = reduced(power << 1)
    out = [power]
    while len(out) < doublings:
        out.append(squared(out[-1]))
    return out


def jumped(state: np.ndarray, polynomial: int) -> np.ndarray:
    """The state after as many words as the polynomial stands for: the sum of the states that its bits name."""
    words, need = [state], polynomial.bit_length() + WORDS
    while sum(map(len, words)) < need:
        words.append(twist(words[-1]))
    line = np.concatenate(words)
    terms = np.flatnonzero(np.frombuffer(bin(polynomial)[:1:-1].encode(), np.uint8) == ord("1"))
    out = np.zeros(WORDS, np.uint64)
    for at in range(0, len(terms), 1024):
        out ^= np.bitwise_xor.reduce(np.lib.stride_tricks.sliding_window_view(line, WORDS)[terms[at : at + 1024]], axis=0)
    return out


def draws(like: DataFrame, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """idx 0 to n-1 and the draw ``u`` in [0, 1) that belongs to it: the top 53 bits of each word."""
    size = WORDS * SPAN_BLOCKS
    spans = -(-n // size)
    jumps = jump_polynomials(size, (spans - 1).bit_length()) if spans > 1 else []

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in batch.column(0).to_pylist():
                state = seeded(seed)
                for k, jump in enumerate(jumps):
                    if span >> k & 1:
                        state = jumped(state, jump)
                stop = min((span + 1) * size, n)
                for at in range(span * size, stop, WORDS * BATCH_BLOCKS):
                    words = []
                    for _ in range(min(BATCH_BLOCKS, -(-(stop - at) // WORDS))):
                        state = twist(state)
                        words.append(state)
                    u = (tempered(np.concatenate(words)) >> np.uint64(11)).astype(float)[: stop - at] * 2.0**-53
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(u))), pa.array(u)], ["idx", "u"])

    return like.sparkSession.range(0, spans, 1, max(1, spans)).mapInArrow(replay, "idx long, u double")


def fraction_indexes(like: DataFrame, n: int, fraction: float, seed: int = DEFAULT_SEED) -> DataFrame:
    """Indexes that are kept by one draw each; 0 and 1 draw nothing."""
    if fraction <= 0 or fraction >= 1:
        return like.sparkSession.range(0, n if fraction >= 1 else 0).withColumnRenamed("id", "idx")
    return draws(like, n, seed).where(F.col("u") < fraction).select("idx")


def exact_indexes(like: DataFrame, n: int, k: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """The indexes of a reservoir sample of k out of n."""
    if k == 0 or k >= n:
        return like.sparkSession.range(0, n if k else 0).withColumnRenamed("id", "idx")
    order = F.col("idx") + 1
    slot = F.when(order <= k, F.col("idx")).otherwise(F.least(F.floor(F.col("u") * order), F.col("idx")))
    last = draws(like, n, seed).withColumn("slot", slot).where(F.col("slot") < k).groupBy("slot").agg(F.max("idx").alias("idx"))
    return last.select("idx")


def keep(units: DataFrame, indexes: DataFrame) -> DataFrame:
    """The chosen units (reads or pairs)."""
    return units.join(indexes, "idx", "left_semi")


def checked(records: DataFrame, alphabet: str | None = None) -> DataFrame:
    """The records, once all of them are valid: exact sampling chooses from whole sources only.

    A ValueError names the first failure of a source; one row for each failing source reaches the driver.
    """
    bad = sorted(first_violation(violations(records, alphabet)).collect(), key=lambda r: r["src"])
    if bad:
        raise ValueError("; ".join(f"{r['src']}: {r['code']} in record {r['idx']}, line {r['line']}, byte {r['offset']}" for r in bad))
    return records
