"""A toxicity classifier: gradient-boosted trees over dense features of the text, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import materialise
from .toxic_features import FEATURES, features, mark_pattern
from .training import fold, sample_ids

PER_CLASS = 4000
LONGEST = 32_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: Beginnings of words that the training rows mark: their lengths, how many at most, in which share of toxic rows at least.
MARK_LENGTHS = range(3, 11)
MARKS = 64
MARK_SHARE = 0.02
#: Texts whose features are worked out at once.
SLICE = 500


def learn_marks(rows: DataFrame, least_share: float = MARK_SHARE, most: int = MARKS) -> list[str]:
    """A lexicon from labelled rows (label, text): beginnings of words that toxic rows have and other rows hardly have.

    Counted by documents; equal texts count once. The rows are a bounded sample, the driver gets the counts of
    beginnings that enough toxic rows share.
    """
    rows = rows.dropDuplicates(["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[tuple[str, int], int] = {}
            for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist()):
                words = set(re.findall(r"\w+", (text or "").lower()))
                for mark in {w[:n] for w in words for n in MARK_LENGTHS if n <= len(w)}:
                    counts[mark, label] = counts.get((mark, label), 0) + 1
            marks, labels = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), pa.array(labels, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["mark", "label", "n"])

    of = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    counts = rows.select("label", "text").mapInArrow(run, "mark string, label int, n long")
    per = lambda k: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0))
    least = max(4, int(least_share * of.get(1, 0)))
    found = counts.groupBy("mark").agg(per(1).alias("bad"), per(0).alias("fine")).where((F.col("bad") >= least) & (F.col("fine") * of.get(1, 0) * 20 <= F.col("bad") * of.get(0, 0)))
    ranked = sorted(found.collect(), key=lambda r: (-r["bad"], len(r["mark"]), r["mark"]))
    kept: list[str] = []
    for r in ranked:
        if len(kept) < most and not any(r["mark"].startswith(m) for m in kept):
            kept.append(r["mark"])
    return sorted(kept)


def with_features(docs: DataFrame, keep: list[str], marks: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and one double column for each feature. Narrow; null texts count as empty.

    If a kept column is a struct that holds the text, the text is read from there (``doc.text``) and sent once.
    """
    whole, _, part = text_col.partition(".")

    def texts(b: pa.RecordBatch) -> pa.Array:
        return b.column(whole).field(part) if part else b.column(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = mark_pattern(marks)
        for big in batches:
            for at in range(0, len(big), SLICE):
                b = big.slice(at, SLICE)
                rows = [features(t or "", marked) for t in texts(b).to_pylist()]
                made = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(FEATURES))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], [*keep, *FEATURES])

    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), *(T.StructField(c, T.DoubleType()) for c in FEATURES)])
    return docs.select(*dict.fromkeys([*keep, whole])).mapInArrow(run, schema)


class ToxicityModel:
    """Trees and the isotonic curve on their probability; or one constant where there was too little to learn from."""

    def __init__(self, trees=None, curve=None, constant: float = 0.5, marks: list[str] | None = None):
        self.trees, self.curve, self.constant, self.marks = trees, curve, constant, marks or []

    def score(self, featured: DataFrame, keep: list[str]) -> DataFrame:
        if self.trees is None:
            return featured.select(*keep, F.lit(self.constant).alias("score"))
        raw = self.raw(featured)
        return self.curve.transform(raw).select(*keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("score"))

    def raw(self, featured: DataFrame) -> DataFrame:
        d = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured)
        return self.trees.transform(d).withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Fits on at most ``per_class`` labelled rows of each class outside the held-out fold.

    Two fifths of them (by hash) give the marks, two fifths grow the trees, the rest fit the isotonic curve. Texts over
    LONGEST characters are not used to learn; every text is scored whole.
    """
    ids = sample_ids(labels, "toxic", per_class, FOLDS, HELD_OUT)
    rows = materialise(docs.select("doc_id", "text").where(F.length("text") <= LONGEST).join(F.broadcast(ids), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < 20:
        return ToxicityModel(constant=counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.0)
    # Marks come from one part of the rows, the trees from another, so that marks look no better than they are.
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5))
    marks = learn_marks(rows.where(part < 2))
    rows = materialise(with_features(rows.where(part >= 2), ["doc_id", "label"], marks))
    rows = rows.withColumn("label", F.col("label").cast("double"))
    grow = part < 4
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.where(grow)).coalesce(4)
    trees = GBTClassifier(maxDepth=3, maxIter=20, stepSize=0.3, seed=7, maxBins=32, cacheNodeIds=False).fit(assembled)
    model = ToxicityModel(trees, marks=marks)
    held = model.raw(rows.where(~grow)).select("raw", "label")
    model.curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(held)
    return model


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) for every row, repeated rows as often as they occur.

    Null ids are in no held-out fold and are not learned from; null texts count as empty and are scored like any other
    text, as are very long ones. Equal texts have equal scores. Further columns are not read. An empty table gives no rows.
    """
    model = fit_toxicity(docs, labels)
    scored = model.score(with_features(docs, ["doc_id"], model.marks), ["doc_id"])
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score below the threshold, with all their columns, in one pass over the texts.

    A row is carried as one struct, so that columns may have any names. Repeated rows, null ids and null or empty texts
    are scored like all others and stay if they score below. An empty table stays empty.
    """
    model = fit_toxicity(docs, labels)
    rows = with_features(docs.select(F.struct(*docs.columns).alias("doc")), ["doc"], model.marks, "doc.text")
    kept = model.score(rows, ["doc"]).where(F.col("score") < threshold)
    return kept.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
