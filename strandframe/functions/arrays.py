"""Numbers of many reads at a time, from the bytes of Arrow columns; nothing is unfolded to a row for each base.

Reads are strings of bytes. Where a sequence and its quality differ in length, both are taken to end with the shorter one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Letters that are told apart, in this order; all others are one class.
LETTERS = "ACGTN"
OTHER = "?"
#: Codes of quality bytes that are told apart; bytes beyond ASCII are not qualities and count as the last one.
CODES = 128
#: Cycles that are counted in one dense array, and how many such arrays a task holds before it passes them on.
BLOCK, HELD = 1024, 16

_CLASS = np.full(256, len(LETTERS), np.int64)
for _i, _b in enumerate(LETTERS):
    _CLASS[[ord(_b), ord(_b.lower())]] = _i
CLASSES = [*LETTERS, OTHER]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins, with the end as one more entry. Nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def places(starts: np.ndarray) -> np.ndarray:
    """For each byte its place within its text."""
    return np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum over each text; whole numbers wrap around as their type does."""
    upto = np.zeros(len(values) + 1, values.dtype if values.dtype == np.uint64 else np.int64)
    np.cumsum(values, out=upto[1:])
    return upto[starts[1:]] - upto[starts[:-1]]


def both(seq: pa.Array, qual: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of sequences and of qualities side by side, and where each read begins."""
    s, at_s = flat(seq)
    q, at_q = flat(qual)
    if (at_s != at_q).any():
        size = np.minimum(np.diff(at_s), np.diff(at_q))
        s, q = (x[places(at) < np.repeat(size, np.diff(at))] for x, at in ((s, at_s), (q, at_q)))
        at_s = np.append(0, np.cumsum(size))
    return s, q, at_s


NUMBERS = ["len", *(b.lower() for b in LETTERS), "q", "q20", "q30"]


def with_numbers(reads: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and for each read ``len``, its count of each letter in either case, the sum of its scores ``q``, and
    how many scores are at least 20 and 30. One narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, at = flat(batch.column(0))
            q, at_q = flat(batch.column(1))
            kind = _CLASS[s]
            numbers = [np.diff(at), *(sums(kind == i, at) for i in range(len(LETTERS)))]
            numbers += [sums(q, at_q) - 33 * np.diff(at_q), sums(q >= 53, at_q), sums(q >= 63, at_q)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *map(pa.array, numbers)], [*keep, *NUMBERS])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in reads.select(*keep).schema] if keep else []
    return reads.select("seq", "qual", *keep).mapInArrow(run, ", ".join([*kinds, *(f"{c} long" for c in NUMBERS)]))


def base_counts(reads: DataFrame) -> DataFrame:
    """cycle (from 1), base, q, n: histograms by cycle, letter and score of each task's reads, for Spark to add up."""
    names = ["cycle", "base", "q", "n"]

    def rows(block: int, counts: np.ndarray) -> pa.RecordBatch:
        cell = np.flatnonzero(counts)
        cycle, kind, code = np.unravel_index(cell, (BLOCK, len(CLASSES), CODES))
        base = pa.DictionaryArray.from_arrays(pa.array(kind.astype(np.int8)), CLASSES).dictionary_decode()
        arrays = [pa.array((block * BLOCK + cycle + 1).astype(np.int32)), base, pa.array((code - 33).astype(np.int32)), pa.array(counts[cell])]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            s, q, at = both(batch.column(0), batch.column(1))
            cycle = places(at)
            cell = (cycle % BLOCK * len(CLASSES) + _CLASS[s]) * CODES + np.minimum(q, CODES - 1)
            block = cycle // BLOCK
            for b in range(int(block.max(initial=-1)) + 1):
                counts = np.bincount(cell[block == b] if block.any() else cell, minlength=BLOCK * len(CLASSES) * CODES)
                held[b] = held[b] + counts if b in held else counts
                if len(held) > HELD:
                    yield from (rows(*x) for x in held.items())
                    held = {}
        yield from (rows(*x) for x in held.items())

    return reads.select("seq", "qual").mapInArrow(run, "cycle int, base string, q int, n long")


def tile_sums(reads: DataFrame) -> DataFrame:
    """tile, cycle, q (sum of scores), n of each batch of reads (tile, qual), for Spark to add up; tile may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, at = flat(batch.column(1))
            if not len(q):
                continue
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            width = int(np.diff(at).max())
            cell = np.repeat(coded.indices.to_numpy(), np.diff(at)) * np.int64(width) + places(at)
            n = np.bincount(cell)
            total = np.bincount(cell, weights=q).astype(np.int64) - 33 * n  # below 2^53, so the sum is exact
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(full // width)), pa.array((full % width + 1).astype(np.int32)), pa.array(total[full]), pa.array(n[full])], ["tile", "cycle", "q", "n"])

    return reads.select("tile", "qual").mapInArrow(run, "tile int, cycle int, q long, n long")
