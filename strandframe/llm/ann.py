"""Approximate nearest neighbours by learned partitions of a neighbour graph.

1. On a bounded sample the exact neighbour graph is cut into balanced parts that hold most neighbours together.
2. A small classifier learns which parts a vector's neighbours are in. It places every vector of the table.
3. The same classifier routes each query to its most probable parts, as many as a check on the sample asks for; there
   candidates are ranked by their exact inner product.
Equal vectors are indexed as at most ``k + 1`` rows, those with the smallest ids: no query can have more of them among
its nearest, so a vector that a third of all rows share costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialise

NEAREST = 20
#: Bounds of the fit: vectors of the sample, neighbours in its graph, and the recall that routing must reach on it.
SAMPLE = 4096
GRAPH_NEIGHBOURS = 10
TARGET_RECALL = 0.94
#: A part for about so many vectors, within these limits.
PART_ROWS = 2048
PARTS = (4, 64)
#: Rows of candidates and of queries that one task compares.
CELL_ROWS = 8192
CELL_QUERIES = 2048


def usable(vector: str | Column, dimension: int) -> Column:
    """Not null, of the table's dimension, finite, and not zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) == dimension) & ~bad & F.exists(v, lambda x: x != 0)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row by inner product, in blocks."""
    near = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        near[a : a + 512] = np.argpartition(-s, k, axis=1)[:, :k]
    return near


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each row: no part over its capacity, and as many graph neighbours as possible in the own part.

    Starts from balanced halving along principal directions; then rows move, a tenth of the capacity to spare, to the
    part where most of their neighbours (both ways) are.
    """
    n = len(x)
    part = np.zeros(n, np.int64)
    groups = [np.arange(n)]
    while len(groups) < parts:
        g = groups.pop(int(np.argmax([len(g) for g in groups])))
        c = x[g] - x[g].mean(0)
        axis = np.linalg.svd(c.T @ c)[0][:, 0]
        order = np.argsort(c @ axis, kind="stable")
        groups += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
    for p, g in enumerate(groups):
        part[g] = p
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    ends, other = np.concatenate([a, b]), np.concatenate([b, a])
    capacity = int(1.1 * -(-n // parts)) + 1
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (ends, part[other]), 1)
        gain = votes.max(1) - votes[np.arange(n), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            to = int(votes[i].argmax())
            if to != part[i] and sizes[to] < capacity:
                sizes[to] += 1
                sizes[part[i]] -= 1
                part[i], moved = to, moved + 1
        if moved < n // 200:
            break
    return part


class Router:
    """A classifier with one hidden layer from a vector to the probability of each part."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, steps: int = 400, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.scale = 1 / (np.sqrt((x * x).sum(1).mean()) + 1e-30)
        d, p = x.shape[1], target.shape[1]
        w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)) * 4, np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, p)), np.zeros(p)]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        self.w = w
        for t in range(1, steps + 1):
            i = rng.integers(0, len(x), min(512, len(x)))
            h0 = x[i] * self.scale @ w[0] + w[1]
            h = np.maximum(h0, 0)
            e = self._softmax(h @ w[2] + w[3]) - target[i]
            e /= len(i)
            back = e @ w[2].T * (h0 > 0)
            for k, g in enumerate([(x[i] * self.scale).T @ back, back.sum(0), h.T @ e, e.sum(0)]):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum(x * self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def fit_router(sample: np.ndarray, parts: int, k: int, target: float = TARGET_RECALL) -> tuple[Router, int]:
    """The router, and the smallest number of parts by which the sample's own neighbours are found at the target recall."""
    near = neighbour_graph(sample, min(max(GRAPH_NEIGHBOURS, k), len(sample) - 1))
    part = balanced_parts(sample, near[:, :GRAPH_NEIGHBOURS], parts)
    goal = np.zeros((len(sample), parts))
    np.add.at(goal, (np.repeat(np.arange(len(sample)), near.shape[1]), part[near].ravel()), 1 / near.shape[1])
    router = Router(sample, 0.8 * goal + 0.2 * np.eye(parts)[part])
    p = router.probabilities(sample)
    placed = p.argmax(1)
    rank = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1)
    needed = rank[np.arange(len(sample))[:, None], placed[near]]
    recall = [(needed < m).mean() for m in range(1, parts + 1)]
    return router, next(m for m, r in enumerate(recall, 1) if r >= target or m == parts)


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query row the k nearest other rows found: query_id, rank, vec_id, score (inner product in double precision).

    Ties go to the smaller id. Vectors that are null, zero, of another dimension than most, or hold null or non-finite
    components take no part. Repeated ids are candidates of their own, but a row is never a candidate of a query with
    its id. Null ids take no part. Further columns are not read.
    """
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    sizes = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dimension = sizes[0]["d"] if sizes else 0
    rows = rows.where(usable("v", dimension))
    order = Window.partitionBy("v").orderBy("vec_id")
    kept = materialise(rows.select("vec_id", "v").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n"))
    count = kept.count()
    out = "query_id long, vec_id long, score double"
    if count == 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample = np.unique(np.array([r["v"] for r in picked], float), axis=0)
    parts = int(min(PARTS[1], max(PARTS[0], count // PART_ROWS)))
    if len(sample) > 16 * parts:
        router, probes = fit_router(sample, parts, k)
    else:
        router, parts, probes = None, 1, 1

    def place(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.array(b.column("v").to_pylist(), float).reshape(-1, dimension)
                if router is None:
                    best = np.zeros((len(x), 1), np.int64)
                else:
                    best = np.argsort(-router.probabilities(x), axis=1, kind="stable")[:, :most]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(best.tolist(), pa.list_(pa.int32()))], ["vec_id", "v", "parts"])

        return run

    kind = kept.schema["v"].dataType.simpleString()
    schema = f"vec_id long, v {kind}, parts array<int>"
    indexed = kept.mapInArrow(place(1), schema).select("vec_id", "v", F.col("parts")[0].alias("part"))
    asked = rows.where("query").select("vec_id", "v").mapInArrow(place(probes), schema).select(F.col("vec_id").alias("query_id"), "v", F.explode("parts").alias("part"))
    indexed, asked = materialise(indexed), materialise(asked)
    # Each part is a grid of candidates by queries; there is one row of counts for each part.
    cells = {r["part"]: -(-r["count"] // CELL_ROWS) for r in indexed.groupBy("part").count().collect()}
    lots = {r["part"]: -(-r["count"] // CELL_QUERIES) for r in asked.groupBy("part").count().collect()}

    def of(counts: dict[int, int]) -> Column:
        return F.coalesce(F.create_map(*(F.lit(x) for kv in (counts or {0: 1}).items() for x in kv))[F.col("part")], F.lit(1))

    up_to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    candidates = indexed.withColumn("c", F.pmod(F.xxhash64("vec_id"), of(cells)).cast("int")).withColumn("q", up_to(of(lots)))
    asked = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), of(lots)).cast("int")).withColumn("c", up_to(of(cells)))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        left = left.sort_values("vec_id", kind="stable")
        ids, x, found = left["vec_id"].to_numpy(), np.array(left["v"].tolist(), float), []
        wide = min(len(ids), 2 * k + 32)  # wide enough that rounding in the product cannot hide a tie
        for a in range(0, len(right), 256):
            part = right.iloc[a : a + 256]
            own, q = part["query_id"].to_numpy(), np.array(part["v"].tolist(), float)
            s = q @ x.T
            s[own[:, None] == ids[None, :]] = -np.inf
            top = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
            exact = (q[:, None, :] * x[top]).sum(2)
            exact[own[:, None] == ids[top]] = -np.inf
            order = np.lexsort((ids[top], -exact), axis=1)[:, :k]
            row = np.arange(len(q))[:, None]
            found.append(pd.DataFrame({"query_id": np.repeat(own, order.shape[1]), "vec_id": ids[top[row, order]].ravel(), "score": exact[row, order].ravel()}))
        found = pd.concat(found)
        return found[found["score"] > -np.inf]

    both = candidates.groupBy("part", "c", "q").cogroup(asked.groupBy("part", "c", "q")).applyInPandas(rank, out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
