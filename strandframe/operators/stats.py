"""Counts and aggregate statistics of reads, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import with_numbers


def count_reads(reads: DataFrame) -> DataFrame:
    return reads.groupBy("src").agg(F.count("*").alias("n_reads"))


def read_stats(reads: DataFrame, by: list[str] | None = None, digits: int = 9) -> DataFrame:
    """Reads, bases, lengths, bases by letter (case-folded), score sums and the shares of high scores.

    Ratios are null where their denominator is zero; ``digits`` rounds them.
    """
    per = with_numbers(reads, by or [])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    agg = per.groupBy(*(by or [])).agg(
        F.count("*").alias("reads"), total("len").alias("bases"), F.min("len").cast("long").alias("min_length"), F.max("len").cast("long").alias("max_length"),
        *(total(b).alias(f"{b}_bases") for b in "acgtn"), total("q").alias("quality_sum"), total("q20").alias("q20_bases"), total("q30").alias("q30_bases"),
    )
    known = sum(F.col(f"{b}_bases") for b in "acgt")
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, digits))
    return agg.withColumns(
        {
            "other_bases": F.col("bases") - known - F.col("n_bases"),
            "mean_length": ratio(F.col("bases"), F.col("reads")),
            "gc_fraction": ratio(F.col("g_bases") + F.col("c_bases"), known),
            "mean_quality": ratio(F.col("quality_sum"), F.col("bases")),
            "q20_fraction": ratio(F.col("q20_bases"), F.col("bases")),
            "q30_fraction": ratio(F.col("q30_bases"), F.col("bases")),
        }
    )
