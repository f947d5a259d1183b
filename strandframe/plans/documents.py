"""JSON documents of statistics, checks and runs; only a row for each input, cycle or reason reaches the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reads as R
from ..operators import filters, inserts, qc, stats, validate
from .process import Run, check_interleaved, check_pairs

#: Names of the statistics in their order, and what the codes of pairs mean.
STATS = ["reads", "bases", "min_length", "max_length", "mean_length", *"acgtn", "other_bases", "gc_fraction", "quality_sum", "mean_quality", "q20_bases", "q20_fraction", "q30_bases", "q30_fraction"]
PAIR_MESSAGES = {"P001": "paired identifiers or mate markers do not match", "P002": "paired input is missing a mate"}
REASON_NAMES = {"low_quality": "low_quality_reads", "too_many_n": "too_many_N_reads", "adapter_dimer": "adapter_dimer_reads", "too_short": "too_short_reads"}


def escaped(text: str) -> str:
    """Printable ASCII as it is, a backslash twice, and any other byte as \\xHH."""
    return "".join(chr(b) if 32 <= b <= 126 and b != 92 else "\\\\" if b == 92 else f"\\x{b:02X}" for b in text.encode("utf-8", "surrogateescape"))


def failures(records: DataFrame, alphabet: str | None, quality: bool = True) -> dict[str, dict]:
    found = validate.first_violation(validate.violations(records, alphabet, quality)).collect()
    return {r["src"]: {"code": r["code"], "record_index": r["idx"], "byte_offset": r["offset"], "line_in_record": r["line"]} for r in found}


def document(kind: str, results: list[dict]) -> str:
    return json.dumps({"schema": kind, "results": results})


def check_document(inputs: list[str], records: DataFrame, alphabet: str = "iupac") -> str:
    """One result for each input (a value of ``src``), with its first failure."""
    bad = failures(records, alphabet)
    return document("check-v1", [{"input": escaped(i), "status": "error", "error": bad[i]} if i in bad else {"input": escaped(i), "status": "ok"} for i in inputs])


def named_stats(row: dict | None) -> dict:
    """Statistics by the names of the documents; those of no reads if there is no row."""
    if row is None:
        return dict.fromkeys(STATS) | dict.fromkeys([s for s in STATS if s in ("reads", "bases", *"acgtn") or s.endswith(("_bases", "_sum"))], 0)
    return {s: row[f"{s}_bases" if len(s) == 1 else s] for s in STATS}


def stats_document(inputs: list[str], records: DataFrame) -> str:
    """One result for each input: its statistics, or its first failure of structure or score range."""
    bad = failures(records, None)
    found = {r["src"]: r.asDict() for r in stats.read_stats(records, ["src"]).collect()}
    results = []
    for i in inputs:
        if i in bad:
            results.append({"input": escaped(i), "status": "error", "error": bad[i]})
            continue
        results.append({"input": escaped(i), "status": "ok"} | named_stats(found.get(i)))
    return document("stats-v1", results)


def pair_check_document(inputs: list[str], left: DataFrame, right: DataFrame | None = None, policy: str = "illumina", alphabet: str = "iupac") -> str:
    """The result of two inputs, or of an interleaved one if ``right`` is not given."""
    row = (check_interleaved(left, policy, alphabet) if right is None else check_pairs(left, right, policy, alphabet)).first()
    result: dict = {"input": escaped(inputs[0])} if right is None else {"inputs": [escaped(i) for i in inputs]}
    result["status"] = "ok" if row is None else "error"
    return document("check-v1", [result if row is None else result | pair_failure(row, inputs)])


#: Longest part of a name that an error shows, in bytes.
SHOWN = 128


def shown(name: str) -> str:
    return escaped(name.encode("utf-8", "surrogateescape")[:SHOWN].decode("utf-8", "surrogateescape"))


def pair_failure(row: dict, inputs: list[str]) -> dict:
    """``error`` of a row of pair_failures, and ``failed_input`` where it is one of two inputs."""
    if row["code"] in PAIR_MESSAGES:
        error = {"code": row["code"], "message": PAIR_MESSAGES[row["code"]], "pair_index": row["idx"]}
        if row["code"] == "P002":
            return {"error": error | {"remaining_side": f"R{row['mate']}", "record_indexes": [row["last1"], row["last2"]]}}
        return {"error": error | {"first_tokens": [shown(row["name1"]), shown(row["name2"])], "mate_markers": [[k for k in (1, 2) if m & k] for m in (row["marks1"], row["marks2"])]}}
    apart = len(inputs) > 1
    error = {"code": row["code"], "record_index": row["idx"] if apart else 2 * row["idx"] + row["mate"] - 1, "byte_offset": row["offset"], "line_in_record": row["line"]}
    return ({"failed_input": escaped(inputs[row["mate"] - 1])} if apart else {}) | {"error": error}


def totals(pairs: DataFrame) -> dict:
    """Both mates together, with the shares of high scores; zeros without bases."""
    r = qc.summary_totals(pairs).first().asDict()
    r = {k: v or 0 for k, v in r.items()}
    return r | {f"{q}_rate": r[f"{q}_bases"] / r["total_bases"] if r["total_bases"] else 0.0 for q in ("q20", "q30")}


def read_summary(reads: DataFrame) -> dict:
    """Totals of one mate, and its curves over the cycles."""
    s = stats.read_stats(reads).first()
    cycles = qc.per_cycle(reads)
    curves = sorted(qc.cycle_curves(cycles).collect(), key=lambda r: r["cycle"])
    q40 = cycles.agg(F.coalesce(F.sum(F.when(F.col("q") >= 40, F.col("n"))), F.lit(0)).alias("n")).first()["n"]
    column = lambda c: [r[c] for r in curves]
    content = {b: column(f"{b.lower()}_share") for b in ("A", "T", "C", "G", "N", "GC") if b != "GC"} | {"GC": column("gc_share")}
    return {
        "total_reads": s["reads"], "total_bases": s["bases"], "q20_bases": s["q20_bases"], "q30_bases": s["q30_bases"], "q40_bases": q40, "total_cycles": len(curves),
        "quality_curves": {"mean": column("mean_quality")}, "content_curves": content,
    }


def qc_summary(run: Run, command: list[str] = ()) -> str:
    """Totals before and after, dropped reads, duplication, insert sizes, adapter cuts, and each mate before and after."""
    trim = run.options.trim
    after = totals(run.retained)
    dropped = {r["reason"]: r["dropped_pairs"] for r in filters.filter_counts(run.decided).collect()}
    result = {"passed_filter_reads": after["total_reads"]} | {n: 2 * dropped.get(r, 0) for r, n in REASON_NAMES.items() if r != "adapter_dimer" or trim.adapter1} | {"too_long_reads": 0}
    out = {"schema": "qc-summary-v1", "summary": {"before_filtering": totals(run.pairs), "after_filtering": after}, "filtering_result": result}
    if run.options.pair_duplication:
        n = inserts.pair_duplicates(run.pairs).agg(F.count("*").alias("pairs"), F.sum(F.col("duplicate").cast("long")).alias("twice")).first()
        out["duplication"] = {"rate": n["twice"] / n["pairs"] if n["pairs"] else 0.0}
    if trim.adapter1:
        sizes = {r["insert_size"]: r["n_pairs"] for r in run.insert_sizes().collect()}
        histogram = [sizes.get(i, 0) for i in range(inserts.LARGEST)]
        out["insert_size"] = {"peak": max(range(len(histogram)), key=histogram.__getitem__), "unknown": sizes.get(-1, 0), "histogram": histogram}
        cuts = filters.adapter_counts(run.decided).agg(F.sum("reads").alias("reads"), F.sum("bases").alias("bases")).first()
        out["adapter_cutting"] = {"adapter_trimmed_reads": cuts["reads"] or 0, "adapter_trimmed_bases": cuts["bases"] or 0, "read1_adapter_sequence": trim.adapter1, "read2_adapter_sequence": trim.adapter2}
    for name, pairs in (("before_filtering", run.pairs), ("after_filtering", run.retained)):
        for k in (1, 2):
            out[f"read{k}_{name}"] = read_summary(pairs.select(F.col(f"s{k}").alias("seq"), F.col(f"q{k}").alias("qual")))
    return json.dumps(out | {"command": " ".join(map(escaped, command))}, indent="\t")


def unwritable_pair(pairs: DataFrame) -> DataFrame:
    """The first pair (by index, then mate) that couldn't be written, of pairs that would be."""
    rows = None
    for k in (1, 2):
        side = validate.unwritable(pairs.select("idx", *(F.col(f"{c[0]}{k}").alias(c) for c in ("header", "seq", "qual")))).withColumn("mate", F.lit(k))
        rows = side if rows is None else rows.unionByName(side)
    return rows.agg(F.min(F.struct("idx", "mate", "reason")).alias("x")).select("x.*").where(F.col("idx").isNotNull())
