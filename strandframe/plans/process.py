"""A whole processing run over pairs: one narrow stage of trimming and decisions, then counters and records from it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reads as R
from ..operators import filters, inserts, transform, validate
from ..sources.fastq import record_text, write_texts
from ..sources.fastq_files import PRESETS

#: Names of the steps of a report, in their order, and of their columns.
STEPS = {"quality_tail": "tail", "poly_g": "polyg", "overlap": "overlap", "adapter": "adapter"}


@dataclass(frozen=True)
class Options:
    umi_length: int | None = None
    umi_skip: int = 0
    umi_mates: str = "both"
    trim: transform.Trim = field(default_factory=transform.Trim)
    filter: filters.Filter = field(default_factory=filters.Filter)
    max_pairs: int | None = None
    pair_duplication: bool = False
    gzip: bool = False
    gzip_preset: str | None = None

    @property
    def changes_reads(self) -> bool:
        """Whether any step or filter is asked for; without one, retained pairs are the raw ones."""
        t, f = self.trim, self.filter
        return any(x is not None for x in (self.umi_length, t.tail_window, t.poly_g, t.adapter1, f.min_length, f.max_n, f.low_quality))

    def check(self) -> None:
        """Ranges and combinations; a ValueError names the option."""
        t, f = self.trim, self.filter
        if self.umi_skip and not self.umi_length:
            raise ValueError("umi_skip needs umi_length")
        if self.gzip_preset is not None and not self.gzip:
            raise ValueError("gzip_preset needs gzip")
        if self.gzip_preset not in (None, *PRESETS):
            raise ValueError("gzip_preset must be " + ", ".join(PRESETS))
        ranges = [
            ("umi_length", self.umi_length, 1, 100), ("umi_skip", self.umi_skip, 0, 100), ("tail_window", t.tail_window, 1, 1000), ("tail_quality", t.tail_quality, 1, 30),
            ("max_n", f.max_n, 0, 50), ("low_quality", f.low_quality, 0, 93), ("max_low_percent", f.max_low_percent, 0, 100), ("min_length", f.min_length, 0, 2**32 - 1), ("poly_g", t.poly_g, 1, 2**31 - 1),
        ]
        for name, value, low, high in ranges:
            if value is not None and not low <= value <= high:
                raise ValueError(f"{name} must be {low} to {high}")
        for name, a, b in (("tail_window and tail_quality", t.tail_window, t.tail_quality), ("adapter1 and adapter2", t.adapter1, t.adapter2), ("low_quality and max_low_percent", f.low_quality, f.max_low_percent)):
            if (a is None) != (b is None):
                raise ValueError(f"{name} go together")
        for adapter in (t.adapter1, t.adapter2):
            if adapter is not None and (not 4 <= len(adapter) <= 128 or set(adapter) - set("ACGT")):
                raise ValueError("an adapter has 4 to 128 bases of ACGT")


class Run:
    """Results of a run as DataFrames: ``pairs`` (raw), ``decided`` (trimmed, with reasons), ``retained``.

    ``decided`` is kept until ``close``; a run is a context manager that closes itself.
    """

    def __init__(self, pairs: DataFrame, options: Options):
        options.check()
        self.options = options
        self.pairs = pairs if options.max_pairs is None else pairs.where(F.col("idx") < options.max_pairs)
        moved = self.pairs
        if options.umi_length:
            moved = transform.move_umi(moved, options.umi_length, options.umi_skip, options.umi_mates)
        self.moved = moved
        self.decided = filters.decide(transform.cut(transform.trim_pairs(moved, options.trim)), options.filter).persist(StorageLevel.MEMORY_AND_DISK)
        self.retained = self.decided.where(F.col("reason_pair").isNull())

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.decided.unpersist()

    def insert_sizes(self) -> DataFrame:
        """Pairs by insert size, from the mates' lengths after the quality tail and poly-G; without adapters there are none."""
        if not self.options.trim.adapter1:
            return self.decided.limit(0).select(F.lit(-1).alias("insert_size"), F.lit(0).cast("long").alias("n_pairs"))
        if self.options.trim.tail_window:  # a pair with an emptied mate isn't compared
            compared = (F.col("n1") > F.col("tail1")) & (F.col("n2") > F.col("tail2"))
        else:
            compared = F.lit(True)
        steps = ("overlap", "adapter")
        sized = self.decided.select(*((F.col(f"kept{k}") + sum(F.col(f"{c}{k}") for c in steps)).alias(f"length{k}") for k in (1, 2)), *((F.col(f"kept{k}") + sum(F.col(f"{c}{k}") for c in (*steps, "polyg", "tail"))).alias(f"n{k}") for k in (1, 2)), "tail1", "tail2", "ov_offset", "ov_length")
        return inserts.insert_sizes(sized.where(compared), F.col("length1"), F.col("length2"))

    def counters(self) -> dict[str, Column]:
        """Everything that is one number of a whole run, as aggregates over ``decided``."""
        count = lambda c: F.count(F.when(c, 1))
        total = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
        dropped = F.col("reason_pair").isNotNull()
        out = {"read": F.count(F.lit(1)), "written": count(~dropped), "dropped": count(dropped)}
        for k in (1, 2):
            for step, c in STEPS.items():
                out |= {f"{step}{k}_reads": count(F.col(f"{c}{k}") > 0), f"{step}{k}_bases": total(f"{c}{k}")}
            out |= {f"cut{k}_reads": count(F.col(f"cut{k}")), f"cut{k}_bases": total(f"cutbases{k}")}
        for reason in filters.REASONS:
            out |= {f"{reason}_pairs": count(F.col("reason_pair") == reason)} | {f"{reason}_reads{k}": count(dropped & (F.col(f"reason{k}") == reason)) for k in (1, 2)}
        if self.options.umi_length:
            out |= {"umi_ambiguous": count(F.col("umi_ambiguous")), "umi_short": count(F.col("umi_short"))}
        return out

    def write(self, out1: str, out2: str) -> dict[str, int]:
        """Both mates' retained records in order, in one pass, and the run's counters, from the decisions that are kept.

        Each pair is trimmed once. Both folders must be new and get part files of the same pairs; if anything fails, neither
        stays. Tagged names are repeated in plus lines that repeat the header.
        """
        plus = lambda k: F.col(f"p{k}") if f"p{k}" in self.decided.columns else F.lit("+")
        texts = [record_text(F.col(f"h{k}"), F.col(f"s{k}"), plus(k), F.col(f"q{k}"), F.col("idx")).alias(f"out{k}") for k in (1, 2)]
        write_texts(self.retained.orderBy("idx").select(*texts), [out1, out2], self.options.gzip, self.options.gzip_preset or "even")
        return self.decided.agg(*(c.alias(n) for n, c in self.counters().items())).first().asDict()


def pair_failures(left: DataFrame, right: DataFrame, policy: str = "illumina", alphabet: str = "iupac") -> DataFrame:
    """The failure that counts of every failing pair of records: idx, code, mate, and what belongs to the code.

    Order at one index: structure of mate 1, of mate 2, missing mate, alphabet or quality of mate 1, of mate 2, names.
    S codes have line and offset; P002 has the side that is left as its mate and the last record index of each side;
    P001 has names and mate marks.
    """
    extra = {"line": "int", "offset": "long", "last1": "long", "last2": "long", "name1": "string", "name2": "string", "marks1": "int", "marks2": "int"}
    fill = lambda df: df.select("idx", "step", "code", "mate", *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in extra.items()))
    cut = lambda df: df.select("idx", F.regexp_replace("header", "^@", "").alias("header"))
    rows = []
    for mate, records in ((1, left), (2, right)):
        found = validate.violations(records, alphabet)
        rows.append(fill(found.select("idx", F.when(F.col("code").isin("S002", "S006"), 3 + mate).otherwise(mate).alias("step"), "code", F.lit(mate).alias("mate"), "line", "offset")))
    pairs = validate.pair_violations(cut(left), cut(right), policy)
    lone = pairs.where("code = 'P002'").select("idx", F.lit(3).alias("step"), "code", F.col("side").alias("mate"), "last1", "last2")
    a, b = (cut(df).select("idx", R.record_id(F.col("header")).alias(f"name{k}"), R.mate_marks(F.col("header")).alias(f"marks{k}")) for k, df in ((1, left), (2, right)))
    named = pairs.where("code = 'P001'").select("idx", F.lit(6).alias("step"), "code", F.lit(None).cast("int").alias("mate")).join(a, "idx").join(b, "idx")
    every = rows[0].unionByName(rows[1]).unionByName(fill(lone)).unionByName(fill(named))
    return every.groupBy("idx").agg(F.min(F.struct("step", "code", "mate", *extra)).alias("x")).select("idx", "x.*").drop("step")


def interleaved_failures(records: DataFrame, policy: str = "illumina", alphabet: str = "iupac") -> DataFrame:
    """pair_failures of one source whose records 2i and 2i + 1 are pairs; idx counts pairs, last1 and last2 records."""
    side = lambda k: records.where(F.col("idx") % 2 == k - 1).withColumn("idx", F.floor(F.col("idx") / 2))
    return pair_failures(side(1), side(2), policy, alphabet).withColumns({"last1": F.col("last1") * 2, "last2": F.col("last2") * 2 + 1})


def first_pair_failure(found: DataFrame) -> DataFrame:
    """The row with the smallest index, if any."""
    return found.agg(F.min_by(F.struct(*found.columns), "idx").alias("x")).where(F.col("x").isNotNull()).select("x.*")


def check_pairs(left: DataFrame, right: DataFrame, policy: str = "illumina", alphabet: str = "iupac") -> DataFrame:
    """The first failure of two sources."""
    return first_pair_failure(pair_failures(left, right, policy, alphabet))


def check_interleaved(records: DataFrame, policy: str = "illumina", alphabet: str = "iupac") -> DataFrame:
    """The first failure of an interleaved source."""
    return first_pair_failure(interleaved_failures(records, policy, alphabet))
