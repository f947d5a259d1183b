"""Read filters and the decision on a pair, and the counters of a run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons from mild to severe.
REASONS = ["too_many_n", "too_short", "low_quality", "adapter_dimer"]


@dataclass(frozen=True)
class Filter:
    min_length: int | None = None
    max_n: int | None = None
    low_quality: int | None = None
    max_low_percent: int | None = None


def read_reason(seq: Column, qual: Column, o: Filter) -> Column:
    """Why a read fails, checked in the order empty, low quality, N, length; null if it does not."""
    n = F.length(seq)
    why = F.when(n == 0, "too_short")
    if o.low_quality is not None:
        low = n - F.length(F.regexp_replace(qual, f"[\\x21-\\x{32 + o.low_quality:02x}]", "")) if o.low_quality > 0 else F.lit(0)
        why = why.when(low * 100 > n * o.max_low_percent, "low_quality")
    if o.max_n is not None:
        why = why.when(n - F.length(F.replace(seq, F.lit("N"), F.lit(""))) > o.max_n, "too_many_n")
    if o.min_length is not None:
        why = why.when(n < o.min_length, "too_short")
    return why


def severity(reason: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, REASONS)), reason), F.lit(0)).cast("int")


def decide(trimmed: DataFrame, o: Filter) -> DataFrame:
    """Adds reason1, reason2 and reason_pair (the worse of the two) to pairs with kept1, kept2 and cut flags; sequences are cut."""
    dimer = (F.col("cut1") | F.col("cut2")) & (F.col("kept1") <= 2) & (F.col("kept2") <= 2)
    for k in (1, 2):
        trimmed = trimmed.withColumn(f"reason{k}", F.when(dimer, "adapter_dimer").otherwise(read_reason(F.col(f"s{k}"), F.col(f"q{k}"), o)))
    worst = F.greatest(severity(F.col("reason1")), severity(F.col("reason2")))
    return trimmed.withColumn("reason_pair", F.when(worst > 0, F.element_at(F.array(*map(F.lit, REASONS)), worst)))


def filter_counts(decided: DataFrame) -> DataFrame:
    """For each reason the dropped pairs and, of dropped pairs, the reads of each mate that fail for it."""
    rows = decided.where(F.col("reason_pair").isNotNull()).select(F.explode(F.array(*(F.struct(F.lit(w).alias("who"), F.col(c).alias("reason")) for w, c in (("p", "reason_pair"), ("1", "reason1"), ("2", "reason2"))))).alias("x")).select("x.*")
    n = lambda w: F.sum((F.col("who") == w).cast("long"))
    return rows.where(F.col("reason").isNotNull()).groupBy("reason").agg(n("p").alias("dropped_pairs"), n("1").alias("failed_reads1"), n("2").alias("failed_reads2"))


def step_counts(trimmed: DataFrame) -> DataFrame:
    """For each mate and step the reads that lost bases and the bases lost."""
    rows = trimmed.select(F.explode(F.array(*(F.struct(F.lit(k).alias("mate"), F.lit(s).alias("step"), F.col(f"{c}{k}").cast("long").alias("n")) for k in (1, 2) for s, c in (("quality_tail", "tail"), ("poly_g", "polyg"), ("overlap", "overlap"), ("adapter", "adapter"))))).alias("x")).select("x.*")
    return rows.groupBy("mate", "step").agg(F.sum((F.col("n") > 0).cast("long")).alias("reads"), F.sum("n").alias("bases"))


def adapter_counts(trimmed: DataFrame) -> DataFrame:
    """For each mate the reads with an adapter cut (even of no base) and the adapter bases."""
    rows = trimmed.select(F.explode(F.array(*(F.struct(F.lit(k).alias("mate"), F.col(f"cut{k}").alias("cut"), F.col(f"cutbases{k}").cast("long").alias("n")) for k in (1, 2)))).alias("x")).select("x.*")
    return rows.groupBy("mate").agg(F.sum(F.col("cut").cast("long")).alias("reads"), F.sum("n").alias("bases"))
