"""Whitening of embeddings by a tall-skinny QR (TSQR), without forming a covariance matrix.

1. Every entry becomes a whole number, so sums are exact. The fit list holds each distinct vector once: one grouping, with
   equal vectors combined before the shuffle.
2. Exact sums by dimension give the centre S/n. It is taken off as a whole part and a remainder, x - S//n - (S mod n)/n,
   so that nothing cancels.
3. Each partition reduces its centred rows to an upper triangular R factor, a block at a time; R factors merge in a tree
   of FAN_IN at a time, so no task and not the driver gets more than FAN_IN factors of dimensions squared.
4. The singular values and right vectors of the last R are those of all centred rows: eigenvalues are their squares over n.
5. How far the whitened fit list is from unit covariance is measured by means and centred products that merge in the same tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialise, stored

SCALE = 256
COMPONENTS = 4
FAN_IN = 16
BLOCK = 4096
LONGEST = 2**63 - 1


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id and x (array of long) of the rows whose vector is neither null nor holds null or non-finite entries."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    entries = F.col(vector_col).cast("array<double>")
    kept = rows.select(F.col(id_col).alias("vec_id"), entries.alias("v_")).where(F.col("v_").isNotNull() & F.forall("v_", finite))
    return kept.select("vec_id", F.transform("v_", lambda c: F.floor(c * scale)).alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def tree_merge(parts: DataFrame, combine: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One value out of those of all partitions (part, value), FAN_IN at a time; None where there are none.

    Each level is checkpointed, so a lost executor costs at most the level at hand.
    """

    def step(tables: pa.Table) -> pa.Table:
        tables = tables.sort_by("part")
        value = combine(tables.column("value").to_pylist())
        return pa.table({"part": pa.array([tables.column("part")[0].as_py() // FAN_IN], pa.int64()), "value": pa.array([value], pa.binary())})

    parts = materialise(parts)
    while (last := parts.agg(F.max("part")).first()[0]) is not None and last > 0:
        parts = materialise(parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("group_")).applyInArrow(step, "part long, value binary"))
    row = parts.first()
    return None if row is None else bytes(row["value"])


def per_partition(fit: DataFrame, dims: int, start: Callable[[], object], fold: Callable[[object, np.ndarray], object], ends: Callable[[object], bytes]) -> DataFrame:
    """(part, value) of every partition that has rows: the fold of its blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, any_rows = start(), False
        for batch in batches:
            x = matrix(batch.column(0), dims)
            for at in range(0, len(x), BLOCK):
                state, any_rows = fold(state, x[at : at + BLOCK]), True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([ends(state)], pa.binary())], ["part", "value"])

    return fit.select("x").mapInArrow(run, "part long, value binary")


def exact_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows and sums by dimension, exact at any size: halves of 32 bits are added apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dims, 0
        for batch in batches:
            x = matrix(batch.column(0), dims)
            low, high = (x & 0xFFFFFFFF).sum(0).tolist(), (x >> 32).sum(0).tolist()
            total, n = [t + (h << 32) + lo for t, h, lo in zip(total, high, low)], n + len(x)
        arrays = [pa.array(range(dims), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array([n] * dims, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["dim", "s", "n"])

    rows = fit.select("x").mapInArrow(run, "dim int, s decimal(38,0), n long").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    rows.sort(key=lambda r: r["dim"])
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: n rows with sums S, unit eigenvectors (rows) by falling eigenvalue, and the measured error.

    Components whose eigenvalue is zero to double precision have no whitened values.
    """

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column per component; NaN where the eigenvalue is zero."""
        with np.errstate(divide="ignore"):
            factor = np.where(self.eigenvalues > 0, 1 / np.sqrt(self.eigenvalues), np.nan)
        return (self.centred(x) @ self.vectors.T) * factor

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Exact sum over dimensions of (n*x - S)^2; null where it is beyond a long."""
        near, rest = x - self.whole, self.rest
        size = ((self.n * near.astype(np.float64) - rest) ** 2).sum(1)
        with np.errstate(over="ignore"):
            out = ((self.n * near - rest) ** 2).sum(1)
        good = size < 0.999 * LONGEST
        values = out.tolist()
        for i in np.flatnonzero(~good).tolist():
            exact = sum((self.n * a - b) ** 2 for a, b in zip(near[i].tolist(), rest.tolist())) if size[i] < 1.001 * LONGEST else LONGEST + 1
            values[i] = exact if exact <= LONGEST else None
        return pa.array(values, pa.int64())


def stacked_r(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(blocks), mode="r")


def merged_moments(moments: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and centred products of the union; nothing is multiplied before it is centred."""
    n, mean, products = moments[0]
    for m, other, more in moments[1:]:
        gap = other - mean
        products = products + more + np.outer(gap, gap) * (n * m / (n + m))
        mean, n = mean + gap * (m / (n + m)), n + m
    return n, mean, products


def fit_whitening(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """TSQR over the column x of the fit list (every vector of ``dims`` whole numbers); None where it has no entries."""
    n, sums = exact_sums(fit, dims) if dims else (0, [])
    if not n:
        return None
    centre = Whitening(n, tuple(sums), np.zeros((0, dims)), np.zeros(0), np.zeros(0))

    def to_bytes(r: np.ndarray) -> bytes:
        return r.astype("<f8").tobytes()

    def factor(value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<f8").reshape(-1, dims)

    factors = per_partition(fit, dims, lambda: np.zeros((0, dims)), lambda r, x: stacked_r([r, centre.centred(x)]), to_bytes)
    r = factor(tree_merge(factors, lambda values: to_bytes(stacked_r([factor(v) for v in values]))))
    _, singular, right = np.linalg.svd(r, full_matrices=True)
    singular = np.concatenate([singular, np.zeros(dims - len(singular))])
    singular[singular <= singular[0] * max(dims, r.shape[0]) * np.finfo(float).eps] = 0
    right = right * np.sign(right[np.arange(dims), np.abs(right).argmax(1)])[:, None]
    k, power = min(components, dims), singular**2
    share = power[:k] / power.sum() if power.sum() else np.full(k, np.nan)
    found = Whitening(n, tuple(sums), right[:k], power[:k] / n, share)

    live = np.flatnonzero(found.eigenvalues > 0)
    if not len(live):
        return found
    width = len(live)

    def pack(m: tuple[float, np.ndarray, np.ndarray]) -> bytes:
        return to_bytes(np.concatenate([[m[0]], m[1], m[2].ravel()]))

    def unpack(value: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        a = np.frombuffer(value, "<f8")
        return a[0], a[1 : width + 1], a[width + 1 :].reshape(width, width)

    def fold(state: tuple | None, x: np.ndarray) -> tuple:
        w = found.whitened(x)[:, live]
        mean = w.mean(0)
        one = (float(len(w)), mean, (w - mean).T @ (w - mean))
        return one if state is None else merged_moments([state, one])

    _, _, products = unpack(tree_merge(per_partition(fit, dims, lambda: None, fold, pack), lambda values: pack(merged_moments([unpack(v) for v in values]))))
    error = float(np.abs(products / n - np.eye(width)).max())
    return Whitening(found.n, found.sums, found.vectors, found.eigenvalues, found.explained, error)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries take no part, nor do those whose length isn't the most
    frequent one among distinct vectors (ties: the greater length). Repeated rows and null ids are kept; equal vectors
    count once in the fit. Where an eigenvalue is zero, ``whitened`` is null; where all are, ``explained`` and
    ``identity_error`` are null too. A deviation beyond a long is null. Fewer dimensions than components give as many
    components. An empty table, or one of empty vectors, gives no rows; further columns are not read.
    """
    kept = whole_vectors(rows, id_col, vector_col, scale)
    fit = stored(kept.select("x").distinct())
    usual = fit.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = usual["dims"] if usual else 0
    model = fit_whitening(fit.where(F.size("x") == dims), dims, components)
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    k = len(model.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            row = pa.array(np.repeat(np.arange(len(x)), k))
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), model.deviations(x).take(row),
                    pa.array(model.whitened(x).ravel(), from_pandas=True), pa.array(np.tile(model.explained, m), from_pandas=True), pa.array([model.identity_error] * (m * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.where(F.size("x") == dims).mapInArrow(run, schema)
