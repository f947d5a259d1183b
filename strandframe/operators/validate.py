"""Validation of records and pairs: every failure as a row, and the one that counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reads as R

#: Codes in the order in which a record's failures take precedence.
ORDER = ["S003", "S001", "S004", "S005", "S002", "S006"]


def violations(records: DataFrame, alphabet: str | None = "iupac", quality: bool = True) -> DataFrame:
    """src, idx, code, line (from 1), offset of the first failure of each failing record, by precedence within it.

    ``records`` as read_fastq gives them: null fields are missing lines. Only the first failing record of a source is
    meaningful, since later lines may be framed wrongly; first_violation() picks it.
    """
    header, seq, plus, qual = (F.col(c) for c in ("header", "seq", "plus", "qual"))
    fail = lambda code, line, at: F.struct(F.lit(code).alias("code"), F.lit(line).alias("line"), at.cast("long").alias("offset"))
    bad = F.when(~header.rlike(r"^@[^ \t]"), fail("S003", 1, F.col("off_header")))
    bad = bad.when(seq.isNull(), fail("S004", 2, F.col("end_offset")))
    bad = bad.when(plus.isNull(), fail("S004", 3, F.col("end_offset")))
    bad = bad.when(~plus.startswith("+"), fail("S001", 3, F.col("off_plus")))
    bad = bad.when(qual.isNull(), fail("S004", 4, F.col("end_offset")))
    bad = bad.when(F.octet_length(seq) != F.octet_length(qual), fail("S005", 4, F.col("off_qual")))
    if alphabet:
        bad = bad.when(R.bad_base_index(seq, alphabet).isNotNull(), fail("S002", 2, F.col("off_seq") + R.bad_base_index(seq, alphabet)))
    if quality:
        bad = bad.when(R.bad_quality_index(qual).isNotNull(), fail("S006", 4, F.col("off_qual") + R.bad_quality_index(qual)))
    return records.withColumn("bad", bad).where(F.col("bad").isNotNull()).select("src", "idx", "bad.*")


def first_violation(found: DataFrame) -> DataFrame:
    """For each source its failing record with the smallest index."""
    least = found.groupBy("src").agg(F.min(F.struct("idx", "code", "line", "offset")).alias("x"))
    return least.select("src", "x.*")


def base_violations(reads: DataFrame, alphabet: str = "iupac") -> DataFrame:
    """idx and position of the first base outside the alphabet, for reads that have one."""
    at = R.bad_base_index(F.col("seq"), alphabet)
    return reads.select("idx", at.cast("long").alias("bad_at")).where(F.col("bad_at").isNotNull())


def pair_violations(left: DataFrame, right: DataFrame, policy: str = "illumina") -> DataFrame:
    """idx and code of every position where a mate is missing (P002) or names do not match (P001).

    For a missing mate also the side that is left (1 or 2) and the last record index of each side (null without records).
    """
    a = left.select("idx", F.col("header").alias("h1"))
    b = right.select("idx", F.col("header").alias("h2"))
    both = a.join(b, "idx", "full_outer")
    code = F.when(F.col("h1").isNull() | F.col("h2").isNull(), "P002").when(~R.names_match(F.col("h1"), F.col("h2"), policy), "P001")
    side = F.when(F.col("h1").isNull(), 2).when(F.col("h2").isNull(), 1)
    last = lambda k: F.when(side == k, F.col("idx")).when(side.isNotNull() & (F.col("idx") > 0), F.col("idx") - 1).alias(f"last{k}")
    return both.select("idx", code.alias("code"), side.alias("side"), last(1), last(2)).where(F.col("code").isNotNull())


def zip_pairs(left: DataFrame, right: DataFrame, plus: bool = False) -> DataFrame:
    """Record i of one source with record i of the other; with their plus lines (p1, p2) if asked."""
    fields = ("header", "seq", "qual", "plus") if plus else ("header", "seq", "qual")
    a = left.select("idx", *(F.col(c).alias(c[0] + "1") for c in fields))
    b = right.select("idx", *(F.col(c).alias(c[0] + "2") for c in fields))
    return a.join(b, "idx")


def pair_interleaved(records: DataFrame) -> DataFrame:
    """Records 2i and 2i+1 of one source as a pair; an odd last record stays without a mate (null)."""
    mate = lambda k, c: F.max(F.when(F.col("idx") % 2 == k - 1, F.col(c))).alias(f"{c[0]}{k}")
    return records.groupBy(F.floor(F.col("idx") / 2).alias("idx")).agg(*(mate(k, c) for k in (1, 2) for c in ("header", "seq", "qual")))


def interleave(pairs: DataFrame) -> DataFrame:
    """Two records for each pair: idx 2i for the first mate, 2i+1 for the second."""
    mates = F.array(*(F.struct(F.lit(k).alias("mate"), (F.col("idx") * 2 + k - 1).alias("idx"), F.col(f"h{k}").alias("header"), F.col(f"s{k}").alias("seq"), F.col(f"q{k}").alias("qual")) for k in (1, 2)))
    return pairs.select(F.explode(mates).alias("m")).select("m.*")


def deinterleave(records: DataFrame, mate: int) -> DataFrame:
    """The records of one mate, renumbered."""
    return records.where(F.col("idx") % 2 == mate - 1).select(F.floor(F.col("idx") / 2).alias("idx"), "header", "seq", "qual")


def field_fault(header: Column, seq: Column, qual: Column, plus: Column) -> Column:
    """Why a record can't be written so that it reads back the same, or null."""
    fields = (header, seq, plus, qual)
    some = lambda f: F.coalesce(f(fields[0]) | f(fields[1]) | f(fields[2]) | f(fields[3]), F.lit(False))
    return (
        F.when(header.isNull() | seq.isNull() | qual.isNull(), "missing field").when(header.rlike(r"^@?($|[ \t])"), "empty name").when(F.octet_length(seq) != F.octet_length(qual), "length mismatch")
        .when(some(lambda c: F.instr(c, "\n") > 0), "line feed in a field").when(some(lambda c: c.endswith("\r")), "carriage return at an end")
    )


def unwritable(records: DataFrame) -> DataFrame:
    """idx and reason of the records that the writer refuses; check only those that would be written."""
    plus = F.col("plus") if "plus" in records.columns else F.lit("+")
    fault = field_fault(F.col("header"), F.col("seq"), F.col("qual"), plus)
    return records.select("idx", fault.alias("reason")).where(F.col("reason").isNotNull())
