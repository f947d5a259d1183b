"""Quality-control modules as aggregations: per cycle, per read, per tile, adapters and duplication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reads as R
from ..functions.arrays import LETTERS, base_counts, tile_sums, with_numbers

#: Cap of stored keys, key length, module limits and level labels.
KEY_BASES, KEY_CAP = 50, 100_000
LEVELS = ["1", "2", "3", "4", "5", "6", "7", "8", "9", ">10", ">50", ">100", ">500", ">1k", ">5k", ">10k+"]
LEVEL_FROM = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 51, 101, 501, 1001, 5001, 10001]
OVERREPRESENTED_PERCENT = 0.1
PERCENTILES = {"p10": 10, "p25": 25, "p50": 50, "p75": 75, "p90": 90}
PERCENTILE_READS = 100


#: Widths of cycle groups in the order in which they are tried: 1, then 2, 5, 10, 20, ...
WIDTHS = [1, *(d * 10**e for e in range(9) for d in (2, 5, 10))]


def group_width(cycles: Column) -> Column:
    """Width of cycle groups: 1 up to 75 cycles, else the first that makes fewer than 75 groups."""
    width = F.when(cycles <= 75, WIDTHS[0])
    for w in WIDTHS[1:]:
        width = width.when(9 + F.ceil((cycles - 9) / w) < 75, w)
    return width.cast("int")


def with_groups(rows: DataFrame, cycle: str, cycles: Column) -> DataFrame:
    """The rows with first and last cycle of their cycle's group."""
    sized = rows.withColumn("width_", group_width(cycles))
    return sized.select(*rows.columns, *group_bounds(F.col(cycle), cycles, F.col("width_")))


def group_bounds(cycle: Column, cycles: Column, width: Column) -> tuple[Column, Column]:
    """First and last cycle of a cycle's group: nine single ones, then groups that end before multiples of the width."""
    start = F.floor(cycle / width) * width
    alone = (width == 1) | (cycle <= 9)
    first = F.when(alone, cycle).otherwise(F.greatest(start, F.lit(10)))
    return first.cast("int").alias("first"), F.when(alone, cycle).otherwise(F.least(start + width - 1, cycles)).cast("int").alias("last")


def cycle_groups(spark, cycles: int) -> DataFrame:
    """cycle (from 1), first and last cycle of its group."""
    return with_groups(spark.range(1, cycles + 1).select(F.col("id").cast("int").alias("cycle"), F.lit(cycles).alias("cycles")), "cycle", F.col("cycles")).drop("cycles")


def grouped(each: DataFrame) -> DataFrame:
    """Rows by cycle (one each, so no more than the longest read has bases), with their group's first and last cycle."""
    cycles = F.max("cycle").over(Window.partitionBy())
    return with_groups(each.withColumn("cycles", cycles), "cycle", F.col("cycles"))


def per_cycle(reads: DataFrame) -> DataFrame:
    """cycle, base, q, n: the counts that all per-cycle modules share. Tasks count in arrays; only counts are shuffled.

    Letters are in upper case; all beside A, C, G, T and N are counted as ``?``.
    """
    return base_counts(reads).groupBy("cycle", "base", "q").agg(F.sum("n").alias("n"))


def cycle_quality(cycles: DataFrame) -> DataFrame:
    """Histogram of scores by cycle."""
    return cycles.groupBy("cycle", "q").agg(F.sum("n").alias("n"))


def rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def base_quality(cycles: DataFrame, digits: int | None = 9) -> DataFrame:
    """For each group of cycles the mean of the cycles' means, and of their percentiles over cycles with over 100 reads."""
    hist = cycle_quality(cycles)
    by = Window.partitionBy("cycle")
    seen = hist.withColumn("seen", F.sum("n").over(by.orderBy("q"))).withColumn("total", F.sum("n").over(by))
    pick = [F.min(F.when(F.col("seen") >= F.floor(F.col("total") * p / 100), F.col("q"))).alias(c) for c, p in PERCENTILES.items()]
    each = seen.groupBy("cycle").agg((F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("mean"), F.max("total").alias("total"), *pick)
    enough = F.col("total") > PERCENTILE_READS
    return grouped(each).groupBy("first", "last").agg(rounded(F.avg("mean"), digits).alias("mean"), *(rounded(F.avg(F.when(enough, F.col(c))), digits).alias(c) for c in PERCENTILES))


def letter_counts(cycles: DataFrame) -> DataFrame:
    """cycle, total, and the count of each letter."""
    n = lambda b: F.sum(F.when(F.col("base") == b, F.col("n")).otherwise(0)).alias(b)
    return cycles.groupBy("cycle").agg(F.sum("n").alias("total"), *map(n, LETTERS))


def base_content(cycles: DataFrame, digits: int | None = 9) -> DataFrame:
    """Percent of each letter among A, C, G, T, pooled over the group; null without any."""
    known = sum(F.sum(b) for b in "ACGT")
    return grouped(letter_counts(cycles)).groupBy("first", "last").agg(*(F.when(known > 0, rounded(F.sum(b) * 100 / known, digits)).alias(b.lower()) for b in "GATC"))


def base_n(cycles: DataFrame, digits: int | None = 9) -> DataFrame:
    return grouped(letter_counts(cycles)).groupBy("first", "last").agg(rounded(F.sum("N") * 100 / F.sum("total"), digits).alias("n_percent"))


def cycle_curves(cycles: DataFrame, digits: int | None = 9) -> DataFrame:
    """For each cycle the mean score and the share of each letter and of G and C among all bases."""
    share = lambda *b: rounded(F.sum(F.when(F.col("base").isin(*b), F.col("n")).otherwise(0)) / F.sum("n"), digits)
    return cycles.groupBy("cycle").agg(rounded(F.sum(F.col("q") * F.col("n")) / F.sum("n"), digits).alias("mean_quality"), *(share(b).alias(f"{b.lower()}_share") for b in "ATCGN"), share("G", "C").alias("gc_share"))


def length_bin(span: Column) -> Column:
    """The smallest of 1, 2, 5, 10, ... that needs at most 50 bins for the span."""
    size = F.when(span <= 50, 1)
    for w in WIDTHS[1:]:
        size = size.when(span / w <= 50, w)
    return size


def length_distribution(reads: DataFrame) -> DataFrame:
    """Reads by length bin; empty bins at the edges are left out, inner ones kept."""
    counts = reads.groupBy(F.length("seq").alias("len")).agg(F.count("*").alias("n"))
    low, high, span = F.col("low"), F.col("high"), F.col("high") + 1 - F.greatest(F.col("low") - 1, F.lit(0))
    ends = counts.agg(F.min("len").alias("low"), F.max("len").alias("high")).where("low is not null").withColumn("span", span).withColumn("size", length_bin(F.col("span")))
    bin_of = lambda x: (F.floor(x / F.col("size")) * F.col("size")).cast("int")
    binned = counts.crossJoin(F.broadcast(ends)).groupBy(bin_of(F.col("len")).alias("first")).agg(F.sum("n").alias("n"))
    every = ends.select("size", F.explode(F.sequence(bin_of(low), high, F.col("size"))).alias("first"))
    return every.join(binned, "first", "left").select("first", (F.col("first") + F.col("size") - 1).alias("last"), F.coalesce("n", F.lit(0)).alias("n"))


def read_quality(reads: DataFrame) -> DataFrame:
    """Reads by floored mean score, from the lowest to the highest without a gap; empty reads are left out."""
    counts = with_numbers(reads, []).where("len > 0").groupBy(F.floor(F.col("q") / F.col("len")).cast("int").alias("q")).agg(F.count("*").alias("n"))
    every = counts.agg(F.explode(F.sequence(F.min("q"), F.max("q"))).alias("q"))
    return every.join(counts, "q", "left").select("q", F.coalesce("n", F.lit(0)).alias("n"))


def read_gc(reads: DataFrame, digits: int | None = 6) -> DataFrame:
    """101 bins of GC percent: a read counts for all bins that its count of G and C covers, by how many counts share a bin."""
    n = R.gc_kept_length(F.length("seq"))
    counts = reads.where(F.length("seq") > 0).select(n.alias("n"), R.letters(F.upper(F.substring(F.col("seq"), F.lit(1), n)), "GC").alias("k"))
    counts = counts.groupBy("n", "k").agg(F.count("*").alias("reads"))
    low = lambda n, k: F.floor(F.greatest(k - 0.5, F.lit(0.0)) * 100 / n + 0.5).cast("int")
    high = lambda n, k: F.floor(F.least(k + 0.5, n.cast("double")) * 100 / n + 0.5).cast("int")
    lengths = counts.select("n").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    bins = lengths.withColumn("bin", F.explode(F.sequence(low(F.col("n"), F.col("k")), high(F.col("n"), F.col("k")))))
    weight = bins.groupBy("n", "bin").agg((1 / F.count("*")).alias("w"))
    covered = counts.join(bins, ["n", "k"]).groupBy("n", "bin").agg(F.sum("reads").alias("reads"))
    found = covered.join(weight, ["n", "bin"]).groupBy("bin").agg(F.sum(F.col("reads") * F.col("w")).alias("reads"))
    every = reads.sparkSession.range(101).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", rounded(F.coalesce("reads", F.lit(0.0)), digits).alias("reads"))


def terminal_runs(reads: DataFrame) -> DataFrame:
    """Reads whose last ten bases are all G, and all A."""
    ends = lambda b: F.sum(F.upper("seq").endswith(b * 10).cast("long"))
    return reads.agg(F.count("*").alias("reads"), F.coalesce(ends("G"), F.lit(0)).alias("poly_g"), F.coalesce(ends("A"), F.lit(0)).alias("poly_a"))


def basic_statistics(reads: DataFrame) -> DataFrame:
    """Reads, bases, whole GC percent of A, C, G and T, lengths, and the median length by cumulated counts."""
    seq = F.upper("seq")
    counts = reads.groupBy(F.length("seq").alias("len")).agg(F.count("*").alias("n"), F.sum(R.letters(seq, "GC")).alias("gc"), F.sum(R.letters(seq, "ACGT")).alias("known"))
    upto = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per length
    total = counts.agg(F.sum("n").alias("total"))
    d = counts.withColumn("upto", F.sum("n").over(upto)).crossJoin(F.broadcast(total))
    return d.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("reads"), F.coalesce(F.sum(F.col("n") * F.col("len")), F.lit(0)).alias("bases"), F.floor(F.sum("gc") * 100 / F.sum("known")).cast("long").alias("gc_percent"),
        F.min("len").alias("min_length"), F.max("len").alias("max_length"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("len"))).alias("median_length"),
    )


def adapter_content(reads: DataFrame, digits: int | None = 9) -> DataFrame:
    """Cumulative percent of all reads in which each adapter has begun, as the mean over each group of positions.

    No rows where the longest read has no two positions for an adapter.
    """
    names = F.array(*map(F.lit, R.CONTENT_ADAPTERS))
    starts = F.array(*(F.struct(F.lit(name).alias("adapter"), F.instr(F.upper("seq"), bases).alias("pos")) for name, bases in R.CONTENT_ADAPTERS.items()))
    found = reads.select(F.explode(starts).alias("x")).select("x.*").where("pos > 0").groupBy("adapter", "pos").agg(F.count("*").alias("n"))
    size = reads.agg(F.count("*").alias("total"), (F.max(F.length("seq")) - 11).alias("positions")).where("positions >= 2")
    grid = size.select("total", "positions", F.explode(names).alias("adapter")).select("*", F.explode(F.sequence(F.lit(1), F.col("positions"))).alias("pos"))
    upto = Window.partitionBy("adapter").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = grid.join(found, ["adapter", "pos"], "left").withColumn("seen", F.sum(F.coalesce("n", F.lit(0))).over(upto))
    return with_groups(seen, "pos", F.col("positions")).groupBy("adapter", "first", "last").agg(rounded(F.avg(F.col("seen") * 100 / F.col("total")), digits).alias("percent"))


#: Width of the ranges of record numbers by which keys are counted to find the last one that is stored.
KEY_RANGE = 1 << 16


def first_keys(reads: DataFrame, cap: int = KEY_CAP) -> DataFrame:
    """key and first_idx of the first ``cap`` distinct keys by appearance.

    Each task passes on its own first ``cap`` keys, among which all are that it can add. What they share is combined, and
    keys are counted by ranges of their first record. Whole ranges before the cap stay; of the range in which the cap
    falls, keys are ranked. No task sorts all keys.
    """

    def own_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.table({"key": batch.column(0), "first_idx": batch.column(1)}).group_by("key").aggregate([("first_idx", "min")]).rename_columns(["key", "first_idx"])
            held = new if held is None else pa.concat_tables([held, new]).group_by("key").aggregate([("first_idx", "min")]).rename_columns(["key", "first_idx"])
            if len(held) > cap:
                held = held.take(pc.select_k_unstable(held, cap, [("first_idx", "ascending")]))
        if held is not None:
            yield from held.combine_chunks().to_batches(max_chunksize=10_000)

    keyed = reads.select(key_of(F.col("seq")).alias("key"), F.col("idx").cast("long").alias("idx"))
    firsts = keyed.mapInArrow(own_first, "key string, first_idx long").groupBy("key").agg(F.min("first_idx").alias("first_idx"))
    firsts = firsts.withColumn("range", F.floor(F.col("first_idx") / KEY_RANGE))
    counts = firsts.groupBy("range").agg(F.count("*").alias("here"))
    before = F.coalesce(F.sum("here").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = counts.withColumn("before", before).where(F.col("before") < cap).drop("here")  # a row for each range that has keys
    rank = F.row_number().over(Window.partitionBy("range").orderBy("first_idx"))
    return firsts.join(F.broadcast(open_), "range").withColumn("rank", rank).where(F.col("before") + F.col("rank") <= cap).select("key", "first_idx")


def key_of(seq: Column) -> Column:
    return F.upper(F.substring(seq, 1, KEY_BASES))


def sequence_keys(reads: DataFrame, cap: int | None = KEY_CAP) -> DataFrame:
    """key, n, first_idx of the first ``cap`` distinct keys by appearance, or of all keys without a cap.

    The stored keys are at most ``cap`` short strings, so they are broadcast; reads of other keys are never shuffled.
    """
    if cap is None:
        return reads.groupBy(key_of(F.col("seq")).alias("key")).agg(F.count("*").alias("n"), F.min(F.col("idx").cast("long")).alias("first_idx"))
    stored = F.broadcast(first_keys(reads, cap))
    return reads.select(key_of(F.col("seq")).alias("key")).join(stored, "key").groupBy("key", "first_idx").agg(F.count("*").alias("n")).select("key", "n", "first_idx")


def level_of(n: Column) -> Column:
    """Label of a duplication level."""
    out = F.lit(LEVELS[0])
    for start, label in list(zip(LEVEL_FROM, LEVELS))[1:]:
        out = F.when(n >= start, label).otherwise(out)
    return out


#: Terms of a product that are added one by one; longer products are integrated.
TERMS = 20_000


def log_unseen(limit: int, total: int, level: int) -> float:
    """Logarithm of the chance that none of ``level`` reads of a key is among ``limit`` of ``total`` reads.

    That is C(total - level, limit) / C(total, limit), a product with as many terms as the smaller of the two numbers. Long
    sums of logarithms are integrals by the midpoint rule with its first correction; the last terms, where it is
    least exact, are added one by one.
    """
    few, many = sorted((limit, level))
    if few + many > total:
        return -math.inf
    ends = min(many, TERMS)
    tail = np.log1p(-few / (total - np.arange(many - ends, many, dtype=np.float64))).sum()
    if few <= ends:
        return float(np.log1p(-many / (total - np.arange(few, dtype=np.float64))).sum())
    high, low = total + 0.5, total - (many - ends) + 0.5  # the integral is over what is drawn from
    if high == low:
        return float(tail)
    area = (high - few) * math.log1p(-few / high) - (low - few) * math.log1p(-few / low) - few * math.log(high / low)
    slope = lambda u: few / (u * (u - few))  # noqa: E731  of log(1 - few / u)
    return float(tail + area - (slope(high) - slope(low)) / 24)


def corrected(limit: int, total: int, level: int, observed: int) -> float:
    """Estimate of how many keys of a level there are, if only ``limit`` of ``total`` reads could bring new keys.

    A chance to miss a key that is too small to matter leaves the number as observed.
    """
    if limit == total or total - observed < limit:
        return float(observed)
    unseen = math.exp(log_unseen(limit, total, level))
    if unseen < 1 - observed / (observed + 0.01):
        return float(observed)
    return observed / (1 - unseen)


def duplication_levels(reads: DataFrame, cap: int = KEY_CAP, digits: int | None = 9) -> DataFrame:
    """For each level the percent of all (estimated) reads; and the percent that would stay after deduplication.

    Keys are first counted by how often they occur: a row for each number of copies, however many keys there are.
    """

    @F.pandas_udf("double")
    def estimate(limit: pd.Series, total: pd.Series, level: pd.Series, observed: pd.Series) -> pd.Series:
        return pd.Series([corrected(*map(int, x)) for x in zip(limit, total, level, observed)], dtype=float)

    by_copies = sequence_keys(reads, cap).groupBy("n").agg(F.count("*").alias("keys"), F.max("first_idx").alias("last"))
    every = Window.partitionBy()
    limit = F.when(F.sum("keys").over(every) >= cap, F.max("last").over(every) + 1).otherwise(F.col("total"))
    rows = by_copies.crossJoin(F.broadcast(reads.agg(F.count("*").alias("total")))).withColumn("limit", limit)
    rows = rows.withColumn("v", estimate("limit", "total", "n", "keys"))
    by_level = rows.groupBy(level_of(F.col("n")).alias("level")).agg(F.sum(F.col("n") * F.col("v")).alias("reads"), F.sum("v").alias("keys"))
    names = reads.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")
    d = names.join(F.broadcast(by_level), "level", "left").select("level", F.coalesce("reads", F.lit(0.0)).alias("reads"), F.coalesce("keys", F.lit(0.0)).alias("keys"))
    raw, kept = F.sum("reads").over(every), F.sum("keys").over(every)
    share = lambda part, none: rounded(F.when(raw > 0, part * 100 / raw).otherwise(none), digits)
    return d.select("level", share(F.col("reads"), 0.0).alias("percent"), share(kept, 100.0).alias("left_percent"))


def overrepresented(reads: DataFrame, cap: int = KEY_CAP, digits: int | None = 9) -> DataFrame:
    """Keys that are over a tenth of a percent of all reads; order them by count descending, then first appearance."""
    total = F.broadcast(reads.agg(F.count("*").alias("total")))
    return sequence_keys(reads, cap).crossJoin(total).withColumn("percent", rounded(F.col("n") * 100 / F.col("total"), digits)).where(F.col("n") * 100 / F.col("total") > OVERREPRESENTED_PERCENT).drop("total")


def tile_field(header: Column) -> Column:
    """Which part of a header between colons (from 0) names the tile, by how many there are; null where none does.

    Empty parts at the end don't count.
    """
    parts = F.size(F.split(F.regexp_replace(header, "(?<=.):+$", ""), ":"))
    return F.when(parts >= 7, 4).when(parts >= 5, 2)


def tile_quality(reads: DataFrame, digits: int | None = 6, every_read: bool = False) -> DataFrame:
    """Mean score of each tile and group of cycles, less the mean over tiles.

    Of reads with a quality the first 10,000 count, then every tenth, or all of them with ``every_read``. Their order comes
    from the record index: ranks are taken within ranges of it and added to the counts of the ranges before, so no task
    ranks all reads. The first read's header tells which of its parts is the tile. A tile without scores in a group has
    the mean 0 there. If any counted read has no whole number as its tile, there are no rows.
    """
    full = reads.where(F.length("qual") > 0)
    used = full
    if not every_read:
        full = full.withColumn("range", F.floor(F.col("idx") / 100_000))
        counts = full.groupBy("range").agg(F.count("*").alias("n"))
        ahead = counts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
        ranked = full.join(F.broadcast(ahead), "range").withColumn("rank", F.col("ahead") + F.row_number().over(Window.partitionBy("range").orderBy("idx")))
        used = ranked.where((F.col("rank") <= 10_000) | ((F.col("rank") - 10_000) % 10 == 0))
    field, longest = tile_field(F.min_by("header", "idx")).alias("field"), F.max(F.octet_length("qual")).alias("cycles")
    about = full.agg(field, longest) if every_read else full.agg(field).crossJoin(used.agg(longest))
    number = F.expr("if(get(split(header, ':'), field) rlike '^[+-]?[0-9]+$', try_cast(get(split(header, ':'), field) as int), null)")
    about = F.broadcast(about)  # one row
    cells = tile_sums(used.crossJoin(about).select(number.alias("tile"), "qual")).groupBy("tile", "cycle").agg(F.sum("q").alias("q"), F.sum("n").alias("n"))
    each = with_groups(cells.crossJoin(about), "cycle", F.col("cycles")).groupBy("tile", "first", "last").agg(F.avg(F.col("q") / F.col("n")).alias("mean"))
    # From here on there are at most 75 rows, each with the tiles of one flow cell.
    groups = each.groupBy("first", "last").agg(F.collect_list(F.struct("tile", "mean")).alias("seen"))
    groups = groups.withColumn("tiles", F.array_distinct(F.flatten(F.collect_list("seen.tile").over(Window.partitionBy())))).where(~F.exists("tiles", F.isnull))
    unseen = F.transform(F.array_except("tiles", "seen.tile"), lambda t: F.struct(t.alias("tile"), F.lit(0.0).alias("mean")))
    rows = groups.select("first", "last", F.inline(F.concat("seen", unseen)))
    deviation = F.col("mean") - F.avg("mean").over(Window.partitionBy("first"))
    return rows.select("tile", "first", "last", rounded(F.col("mean"), digits).alias("mean"), rounded(deviation, digits).alias("deviation"))


#: Lengths of keys that may lie whole in a contaminant, and of the shortest run that counts otherwise.
WHOLE_KEY, LEAST_RUN = (8, 19), 21
#: Length of the stretches of which one must agree, and the step between those of a key. A run of 21 bases with one
#: disagreement has 10 agreeing bases in a row, in which one such stretch of the key lies whole.
SEED, SEED_STEP = 8, 3


def contaminant_hits(keys: DataFrame, contaminants: DataFrame) -> DataFrame:
    """For each key that a contaminant explains: name, whole percent of identity, and bases matched of the best one.

    ``keys`` has a row for each key; ``contaminants`` as sources.contaminants gives them: place, name, bases. A key of 8 to 19
    bases matches if it lies in the contaminant or its reverse complement. Otherwise the agreeing places, written as ones,
    are cut into runs with one disagreement each, and a run of 21 or more bases is a match. Both are laid over each other
    at every offset where a match can be, which are those at which a short stretch agrees. Of one contaminant the longest
    match counts (forward first, then the smallest offset), of all the longest, then the most identical, then the earliest
    in the list. The list is a parameter of at most 1 MiB.
    """
    strands = F.array(F.struct(F.lit(0).alias("strand"), F.upper("bases").alias("s")), F.struct(F.lit(1).alias("strand"), R.reverse_complement(F.col("bases")).alias("s")))
    both = contaminants.select("place", "name", F.inline(strands))
    # Outer, as an inner one makes a filter that works out the keys twice.
    stretches = lambda c, step: F.posexplode_outer(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{SEED}}})).{{{step}}}"), F.lit(1)))
    places = both.select("place", "strand", F.length("s").alias("bases"), stretches("s", 1).alias("there", "seed"))
    shared = keys.select("*", stretches("key", SEED_STEP).alias("at", "seed")).join(F.broadcast(places), "seed").withColumn("shift", F.col("at") * SEED_STEP - F.col("there"))
    whole = F.length("key").between(*WHOLE_KEY)
    least = F.when(whole, F.length("key")).otherwise(LEAST_RUN)
    overlap = F.least(F.length("key"), F.col("bases") + F.col("shift")) - F.greatest(F.lit(0), F.col("shift"))
    laid = shared.withColumn("overlap", overlap).where(F.col("overlap") >= least).select(*keys.columns, "place", "strand", "shift", "overlap").distinct().join(F.broadcast(both), ["place", "strand"])
    laid = laid.withColumn("s", F.expr("substr(s, greatest(1, 1 - shift), overlap)")).withColumn("part", F.expr("substr(key, greatest(1, 1 + shift), overlap)"))
    agree = "concat_ws('', transform(sequence(1, overlap), i -> if(substr(part, i, 1) = substr(s, i, 1), '1', '0')))"
    runs = laid.select("*", F.explode(F.expr(f"regexp_extract_all({agree}, '(1*0?1*)(0|$)', 1)")).alias("run"))
    size, odd = F.length(F.rtrim(F.col("run"), F.lit("0"))), F.col("run").contains("0")
    found = runs.where((size >= least) & ~(whole & odd)).withColumn("size", size).withColumn("identity", F.floor((F.col("size") - odd.cast("int")) * 100 / F.col("size")).cast("int"))
    best = found.groupBy(*keys.columns, "place", "name").agg(F.max(F.struct("size", (-F.col("strand")).alias("forward"), (-F.col("shift")).alias("early"), "identity")).alias("b"))
    # Of the runs at one offset and strand the longest, then the most identical one counts: the struct's last part.
    top = best.groupBy(*keys.columns).agg(F.max(F.struct("b.size", "b.identity", (-F.col("place")).alias("early"), "name")).alias("b"))
    return top.select(*keys.columns, F.col("b.name").alias("name"), "b.identity", F.col("b.size").alias("bases_matched"))


def gc_deviation(bins: DataFrame, digits: int | None = 6) -> DataFrame:
    """One row: percent of all reads by which the 101 bins of read_gc differ from a normal curve.

    The curve's centre is the middle of the bins around the first highest one that hold over nine tenths of it, or the
    highest one itself if these reach an end of the scale; null for fewer than two reads or if all are in one bin.
    """
    peak = bins.agg(F.max_by("bin", F.struct("reads", -F.col("bin"))).alias("peak"), (F.max("reads") * 0.9).alias("least"), F.sum("reads").alias("total"))
    rows = bins.crossJoin(F.broadcast(peak))
    low = F.col("reads") <= F.col("least")
    edges = rows.groupBy("peak", "total").agg(F.max(F.when(low & (F.col("bin") < F.col("peak")), F.col("bin"))).alias("a"), F.min(F.when(low & (F.col("bin") > F.col("peak")), F.col("bin"))).alias("b"))
    centre = bins.crossJoin(F.broadcast(edges.select("total", F.coalesce((F.col("a") + F.col("b")) / 2, F.col("peak").cast("double")).alias("centre"))))
    off = F.col("bin") - F.col("centre")
    spread = centre.groupBy("total", "centre").agg(F.when(F.col("total") > 1, F.sum(off * off * F.col("reads")) / F.greatest(F.col("total") - 1, F.lit(1e-9))).alias("variance"))
    curve = bins.crossJoin(F.broadcast(spread)).where("variance > 0")
    density = F.exp(-off * off / (2 * F.col("variance"))) / F.sqrt(2 * F.pi() * F.col("variance"))
    return curve.agg(rounded(F.sum(F.abs(density * F.col("total") - F.col("reads"))) * 100 / F.max("total"), digits).alias("deviation"))


#: What modules are graded by, the limits past which they warn and fail, and whether lower is worse.
LIMITS = {"base_quality_p25": (10, 5), "base_quality_p50": (25, 20), "tile_quality": (5, 10), "read_quality": (27, 20), "base_content": (10, 20), "gc_content": (15, 30), "n_content": (5, 20), "duplication": (70, 50), "adapter_content": (5, 10)}


def above(value: Column, name: str) -> Column:
    """0, 1 or 2 (pass, warn, fail) for values that shouldn't be over their limits."""
    warn, fail = LIMITS[name]
    return F.when(value > fail, 2).when(value > warn, 1).otherwise(0)


def below(value: Column, name: str) -> Column:
    warn, fail = LIMITS[name]
    return F.when(value < fail, 2).when(value < warn, 1).otherwise(0)


def grade_base_quality(module: DataFrame) -> DataFrame:
    """By the worst group's lower quartile and median; groups without percentiles don't count."""
    return module.agg(F.coalesce(F.max(F.greatest(below(F.col("p25"), "base_quality_p25"), below(F.col("p50"), "base_quality_p50"))), F.lit(0)).alias("g"))


def grade_read_quality(module: DataFrame) -> DataFrame:
    """By the most frequent mean score, the lowest of equals: at most 20 fails, at most 27 warns."""
    warn, fail = LIMITS["read_quality"]
    mode = F.max_by("q", F.struct("n", -F.col("q")))
    return module.agg(F.when(mode <= fail, 2).when(mode <= warn, 1).otherwise(0).alias("g"))


def grade_base_content(module: DataFrame) -> DataFrame:
    """By the largest difference between A and T or G and C in a group."""
    gap = F.greatest(F.abs(F.col("a") - F.col("t")), F.abs(F.col("g") - F.col("c")))
    return module.agg(F.coalesce(F.max(above(gap, "base_content")), F.lit(0)).alias("g"))


def grade_lengths(module: DataFrame) -> DataFrame:
    """``module`` has a row for each length (len): an empty read fails, several lengths warn."""
    return module.agg(F.when(F.min("len") == 0, 2).when(F.count_distinct("len") > 1, 1).otherwise(0).alias("g"))


def grade_overrepresented(module: DataFrame) -> DataFrame:
    """Any key warns, one over one percent fails."""
    return module.agg(F.when(F.max("percent") > 1, 2).when(F.count("*") > 0, 1).otherwise(0).alias("g"))


def module_grades(modules: dict[str, DataFrame]) -> DataFrame:
    """module, grade for the modules given by name; adapter_content without rows (reads too short for one) warns."""
    worst = lambda c, name, how: lambda m: m.agg(F.coalesce(F.max(how(F.col(c), name)), F.lit(0)).alias("g"))
    rules = {
        "base_quality": grade_base_quality,
        "tile_quality": lambda m: m.agg(F.coalesce(F.max(above(F.abs("deviation"), "tile_quality")), F.lit(0)).alias("g")),
        "read_quality": grade_read_quality,
        "base_content": grade_base_content,
        "gc_content": lambda m: gc_deviation(m).select(above(F.col("deviation"), "gc_content").alias("g")),
        "n_content": worst("n_percent", "n_content", above),
        "lengths": grade_lengths,
        "duplication": worst("left_percent", "duplication", below),
        "overrepresented": grade_overrepresented,
        "adapter_content": lambda m: m.agg(F.coalesce(F.max(above(F.col("percent"), "adapter_content")), F.lit(1)).alias("g")),
    }
    out = None
    for name, module in modules.items():
        row = rules[name](module).select(F.lit(name).alias("module"), F.element_at(F.array(*map(F.lit, ("pass", "warn", "fail"))), F.col("g") + 1).alias("grade"))
        out = row if out is None else out.unionByName(row)
    return out


def summary_totals(pairs: DataFrame, digits: int | None = 9) -> DataFrame:
    """Both mates together: reads, bases, score counts, GC share of all bases, whole mean lengths of each mate."""
    mates = pairs.select(F.explode(F.array(*(F.struct(F.lit(k).alias("mate"), F.col(f"s{k}").alias("seq"), F.col(f"q{k}").alias("qual")) for k in (1, 2)))).alias("m")).select("m.*")
    n = F.length("seq").cast("long")
    mean = lambda k: F.floor(F.sum(F.when(F.col("mate") == k, n)) / F.sum((F.col("mate") == k).cast("long"))).cast("long")
    return mates.agg(
        F.count("*").alias("total_reads"), F.sum(n).alias("total_bases"), F.sum(R.at_least(F.col("qual"), 20)).cast("long").alias("q20_bases"), F.sum(R.at_least(F.col("qual"), 30)).cast("long").alias("q30_bases"),
        rounded(F.sum(R.letters(F.upper("seq"), "GC")) / F.sum(n), digits).alias("gc_content"), mean(1).alias("read1_mean_length"), mean(2).alias("read2_mean_length"),
    )
