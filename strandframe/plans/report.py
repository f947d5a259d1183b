"""A run over two record files as a whole: checks, outputs, quality-control texts and summary, and the report as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, inserts, stats, validate
from ..sources.contaminants import read_contaminants
from ..sources.fastq import input_state, read_fastq
from . import documents, tables
from .process import STEPS, Options, Run, check_pairs


def check_outputs(options: Options, outputs: tuple[str, str], report: str | None, qc_tables: str | None, qc_summary: str | None, contaminants: str | None) -> None:
    """Rules between options and outputs; a ValueError says which."""
    options.check()
    if outputs[0] == outputs[1]:
        raise ValueError("outputs must differ")
    if not options.gzip and any(o.endswith(".gz") for o in outputs):
        raise ValueError("outputs named .gz need gzip")
    if contaminants and not (report or qc_tables):
        raise ValueError("contaminants need report or qc_tables")
    if options.pair_duplication and not (report or qc_summary):
        raise ValueError("pair_duplication needs report or qc_summary")
    if options.max_pairs is not None and (qc_tables or qc_summary):
        raise ValueError("max_pairs can't be used with qc_tables or qc_summary")


def listed(options: Options, policy: str, alphabet: str, contaminants: str | None, qc_tables: str | None, qc_summary: str | None) -> dict:
    """Options by the names of the report; null where a step isn't asked for."""
    t, f, umi = options.trim, options.filter, options.umi_length is not None
    return {
        "gzip": options.gzip, "gzip_preset": (options.gzip_preset or "even") if options.gzip else None, "max_pairs": options.max_pairs, "pair_names": policy, "alphabet": alphabet,
        "umi_length": options.umi_length, "umi_skip": options.umi_skip if umi else None, "umi_mates": options.umi_mates if umi else None, "adapter1": t.adapter1, "adapter2": t.adapter2, "trim_poly_g": t.poly_g,
        "trim_tail_window": t.tail_window, "trim_tail_quality": t.tail_quality, "min_length": f.min_length, "max_n": f.max_n, "low_quality": f.low_quality, "max_low_quality_percent": f.max_low_percent,
        "contaminants": contaminants and documents.escaped(contaminants), "pair_duplication": options.pair_duplication, "qc_tables": qc_tables and documents.escaped(qc_tables), "qc_summary": qc_summary and documents.escaped(qc_summary),
    }


def mate(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.select("idx", F.col(f"h{k}").alias("header"), F.col(f"s{k}").alias("seq"), F.col(f"q{k}").alias("qual"))


def mate_stats(pairs: DataFrame) -> list[dict]:
    """Statistics of both mates, from one pass over the pairs."""
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("mate"), F.col(f"s{k}").alias("seq"), F.col(f"q{k}").alias("qual")) for k in (1, 2))))
    found = {r["mate"]: r.asDict() for r in stats.read_stats(pairs.select(both.alias("x")).select("x.*"), ["mate"]).collect()}
    return [documents.named_stats(found.get(k)) for k in (1, 2)]


def named_modules(found: tables.Results) -> dict:
    """Each quality-control module's grade and rows; overrepresented keys with what explains them."""
    named = {name: {"grade": found.grades[name], "rows": rows} for name, rows in found.rows.items()}
    named["overrepresented"]["rows"] = [r | {"source": found.sources.get(r["key"])} for r in found.rows["overrepresented"]]
    return named


def trimming(options: Options, counts: dict[str, int], k: int) -> dict:
    asked = {"quality_tail": options.trim.tail_window, "poly_g": options.trim.poly_g, "overlap": options.trim.adapter1, "adapter": options.trim.adapter1}
    return {s: {"reads": counts[f"{s}{k}_reads"], "bases": counts[f"{s}{k}_bases"]} if asked[s] is not None else None for s in STEPS}


def insert_results(run: Run) -> dict:
    """Compared and overlapping pairs, and the histogram of sizes with its peak and median."""
    sizes = run.insert_sizes()
    found = {r["insert_size"]: r["n_pairs"] for r in sizes.collect()}
    row = inserts.insert_summary(sizes).first()
    overlapping = run.decided.agg(F.count("ov_offset").alias("n")).first()["n"]
    return {"pairs": sum(found.values()), "overlapping": overlapping, "unknown": found.get(-1, 0), "peak": row["peak"] or 0, "median": row["median"], "histogram": [found.get(i, 0) for i in range(inserts.LARGEST)]}


def duplication(pairs: DataFrame) -> dict:
    r = inserts.pair_duplicates(pairs).agg(F.count("*").alias("pairs"), F.coalesce(F.sum(F.col("duplicate").cast("long")), F.lit(0)).alias("duplicates")).first()
    return {"pairs": r["pairs"], "duplicates": r["duplicates"], "rate": r["duplicates"] / r["pairs"] if r["pairs"] else 0.0}


def counted(run: Run, counts: dict[str, int], modules: dict[str, list[tables.Results]] | None) -> dict:
    """The parts of the report that a whole run fills."""
    o = run.options
    reasons = lambda of: {r: counts[f"{r}_{of}"] for r in filters.REASONS}
    return {
        "pairs": {c: counts[c] for c in ("read", "written", "dropped")},
        "mates": {"raw": mate_stats(run.pairs), "retained": mate_stats(run.retained)},
        "qc": modules and {name: list(map(named_modules, mates)) for name, mates in modules.items()},
        "umi": {"ambiguous_pairs": counts["umi_ambiguous"], "short_pairs": counts["umi_short"]} if o.umi_length else None,
        "trimming": [trimming(o, counts, k) for k in (1, 2)],
        "filtering": {"dropped_pairs": reasons("pairs"), "failed_reads": [reasons("reads1"), reasons("reads2")]} if o.changes_reads else None,
        "inserts": insert_results(run) if o.trim.adapter1 else None,
        "pair_duplication": duplication(run.pairs) if o.pair_duplication else None,
    }


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as a folder with one part file; the path must be new."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def failure_of(row: dict | None, inputs: tuple[str, str]) -> tuple[str | None, dict | None]:
    """The input that fails and what fails there; a failure of a pair names no input."""
    if row is None:
        return None, None
    result = documents.pair_failure(row, inputs)
    return result.get("failed_input"), result["error"]


def process_files(
    spark: SparkSession, inputs: tuple[str, str], outputs: tuple[str, str], options: Options = Options(), policy: str = "illumina", alphabet: str = "iupac",
    report: str | None = None, qc_tables: str | None = None, qc_summary: str | None = None, contaminants: str | None = None,
) -> dict:
    """Process two files of mates into two new folders; returns the report and writes it, texts and summary where asked.

    Both files are checked as a whole first (structure, missing mates, bases and qualities, names, and whether what would be
    written could be read back). Inputs that fail, or that change meanwhile, leave no outputs; the report then has status
    ``error`` and says why. Modules (``qc``) are worked out where a report or texts are asked for. With ``max_pairs`` the input may go on, so ``input_complete`` is false if it does.
    """
    check_outputs(options, outputs, report, qc_tables, qc_summary, contaminants)
    sources = None if contaminants is None else read_contaminants(spark, contaminants)
    state = input_state(spark, list(inputs))
    left, right = (read_fastq(spark, path) for path in inputs)
    size = {path.rsplit("/", 1)[-1]: (n, when) for path, n, when in state}
    known = lambda path: size.get(path.rstrip("/").rsplit("/", 1)[-1], (None, None))
    out = {
        "schema": "process-v1", "byte_strings": "escaped-bytes-v1", "options": listed(options, policy, alphabet, contaminants, qc_tables, qc_summary),
        "inputs": [{"path": documents.escaped(i), "size": known(i)[0], "mtime_ns": known(i)[1] and int(known(i)[1].timestamp() * 1_000_000) * 1000} for i in inputs],
        "outputs": [{"path": documents.escaped(o)} for o in outputs],
    }
    checked = [side if options.max_pairs is None else side.where(F.col("idx") < options.max_pairs) for side in (left, right)]
    failed_input, error = failure_of(check_pairs(*checked, policy, alphabet).first(), inputs)
    failed_output, found = None, dict.fromkeys(("pairs", "mates", "qc", "umi", "trimming", "filtering", "inserts", "pair_duplication"))
    files = None
    if error is None:
        with Run(validate.zip_pairs(left, right, plus=True), options) as run:
            bad = documents.unwritable_pair(run.retained).first()
            if bad is not None:
                failed_output = outputs[bad["mate"] - 1]
                error = {"code": "unwritable_record", "message": bad["reason"], "pair_index": bad["idx"]}
            else:
                counts = run.write(*outputs)
                populations = {"raw": run.pairs} | ({"retained": run.retained} if options.changes_reads else {})
                modules = {name: [tables.results_of(mate(pairs, k), sources) for k in (1, 2)] for name, pairs in populations.items()} if report or qc_tables else None
                found = counted(run, counts, modules)
                if input_state(spark, list(inputs)) != state:
                    raise RuntimeError("input changed during the passes over it")
                if qc_tables:
                    files = []
                    for k, name in enumerate(tables.text_folders(list(inputs)), 1):
                        for population, mates in modules.items():
                            path = f"{qc_tables}/{population}/{name}"
                            write_text(spark, tables.qc_text(mates[k - 1], inputs[k - 1].rsplit("/", 1)[-1], tables.TITLE), path)
                            files.append({"population": population, "mate": k, "path": documents.escaped(path)})
                if qc_summary:
                    write_text(spark, documents.qc_summary(run), qc_summary)
    complete = error is None and (options.max_pairs is None or not left.where(F.col("idx") >= options.max_pairs).limit(1).count())
    out |= {"status": "ok" if error is None else "error", "input_complete": complete} | found
    out |= {"qc_table_files": files, "failed_input": failed_input, "failed_output": failed_output and documents.escaped(failed_output), "error": error}
    if report:
        write_text(spark, json.dumps(out), report)
    return out


def count_document(inputs: list[str], records: DataFrame) -> str:
    """One result for each input: how many records it has, or its first failure of structure."""
    bad = documents.failures(records, None, quality=False)
    found = {r["src"]: r["n_reads"] for r in stats.count_reads(records).collect()}
    return documents.document("count-v1", [{"input": documents.escaped(i), "status": "error", "error": bad[i]} if i in bad else {"input": documents.escaped(i), "status": "ok", "reads": found.get(i, 0)} for i in inputs])


def stats_texts(inputs: list[str], records: DataFrame) -> str:
    """Statistics of several inputs as text: a heading and lines for each, or its first failure; blank lines between them."""
    bad = documents.failures(records, None)
    rows = {r["src"]: r.asDict() for r in stats.read_stats(records, ["src"]).collect()}
    none = stats.read_stats(records.limit(0)).first().asDict()
    parts = []
    for i in inputs:
        lines = [f"{documents.escaped(i)}:"] if len(inputs) > 1 else []
        if i in bad:
            e = bad[i]
            lines.append(f"error: {e['code']} in record {e['record_index']}, line {e['line_in_record']}, byte {e['byte_offset']}")
        else:
            r = dict(rows.get(i, none))
            r.pop("src", None)
            lines.append(tables.stats_lines(r))
        parts.append("\n".join(lines))
    return "\n\n".join(parts) + "\n"

