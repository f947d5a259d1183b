"""A quality classifier by compression.

Two zstandard dictionaries are built from labelled good and bad texts. A text compresses better with the dictionary of
its kind: the difference of the two compressed sizes, divided by the text's size, becomes a probability through a
logistic curve fitted to labelled texts that neither dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import whole_text
from .training import fold, sample_ids

#: Bounds of the training sample: labelled rows of each class, and the longest text that is used to train.
PER_CLASS = 1500
LONGEST = 16_000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def differences(self, texts: Iterator[str]) -> list[float]:
        """(size with the bad dictionary - size with the good one) / size of each text; 0 for empty texts."""
        if not self.good:
            return [0.0 for _ in texts]
        kinds = [zstandard.ZstdCompressionDict(d) for d in (self.bad, self.good)]
        for k in kinds:
            k.precompute_compress(level=LEVEL)
        bad, good = (zstandard.ZstdCompressor(dict_data=k, write_content_size=False, write_dict_id=False) for k in kinds)
        out = []
        for text in texts:
            raw = text.encode("utf-8", "replace")
            out.append((len(bad.compress(raw)) - len(good.compress(raw))) / len(raw) if raw else 0.0)
        return out

    def scores(self, texts: Iterator[str]) -> np.ndarray:
        z = np.clip(self.slope * np.array(self.differences(texts)) + self.offset, -35, 35)
        return 1 / (1 + np.exp(-z))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a one-dimensional logistic regression by Newton's method, on a scaled variable."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
    return w[0] / scale, w[1]


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Fits on at most ``per_class`` labelled rows of each class outside the held-out fold, in texts up to LONGEST.

    Half of them (by hash) make the dictionaries, the others the curve. Without enough of both classes every score is
    the share of good rows, or one half.
    """
    ids = sample_ids(labels, "quality", per_class, FOLDS, HELD_OUT)
    d = docs.select("doc_id", F.col("text")).where(F.length("text").between(1, LONGEST))
    rows = d.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label", (F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0).alias("first"))
    # A sample has a row for each id; of rows of equal id the one with the smallest text hash is learned from.
    rows = rows.groupBy("doc_id", "label", "first").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    part = {k: [r["text"].encode("utf-8", "replace") for r in rows if r["first"] and r["label"] == k] for k in (0, 1)}
    rest = [r for r in rows if not r["first"]]
    share = np.clip(np.mean([r["label"] for r in rows]) if rows else 0.5, 1e-6, 1 - 1e-6)
    if min(map(len, part.values())) < 16 or len({r["label"] for r in rest}) < 2:
        return QualityModel(b"", b"", 0.0, float(np.log(share / (1 - share))))
    made = {k: zstandard.train_dictionary(min(DICTIONARY_BYTES, max(4096, sum(map(len, v)) // 8)), v).as_bytes() for k, v in part.items()}
    model = QualityModel(made[1], made[0], 1.0, 0.0)
    x = np.array(model.differences(r["text"] for r in rest))
    model.slope, model.offset = fit_logistic(x, np.array([r["label"] for r in rest], float))
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every whole text; null texts count as empty. One narrow stage; the model is two small dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(iter(b.column(1).to_pylist())))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, whole_text(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7) for every row, repeated rows as often as they occur.

    Null ids are in no held-out fold and are not learned from; null texts count as empty: an empty text has the score of
    no difference. Very long texts are compressed whole. Equal texts have equal scores. Further columns are not read. An
    empty table gives no rows.
    """
    scored = score_quality(docs, fit_quality(docs, labels))
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
