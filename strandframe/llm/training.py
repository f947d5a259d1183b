"""Bounded, reproducible samples of labelled documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sample_ids(labels: DataFrame, label_col: str, per_class: int, folds: int, held_out: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_class`` ids of each label 0 and 1 outside the held-out fold: those with the smallest hashes."""
    ids = labels.where(F.col(id_col).isNotNull() & (fold(id_col, folds) != held_out))
    ids = ids.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    return reduce(DataFrame.union, (ids.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)))
