"""Text reports from small result frames; every module has a bounded number of rows."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reads as R
from ..operators import qc

#: Titles, columns and order of the modules of a quality-control text.
MODULES = {
    "base_quality": ("Per base sequence quality", "Base\tMean\tMedian\tLower Quartile\tUpper Quartile\t10th Percentile\t90th Percentile", ["mean", "p50", "p25", "p75", "p10", "p90"]),
    "tile_quality": ("Per tile sequence quality", "Tile\tBase\tMean", ["deviation"]),
    "read_quality": ("Per sequence quality scores", "Quality\tCount", ["n"]),
    "base_content": ("Per base sequence content", "Base\tG\tA\tT\tC", ["g", "a", "t", "c"]),
    "gc_content": ("Per sequence GC content", "GC Content\tCount", ["reads"]),
    "n_content": ("Per base N content", "Base\tN-Count", ["n_percent"]),
    "lengths": ("Sequence Length Distribution", "Length\tCount", ["n"]),
    "duplication": ("Sequence Duplication Levels", "Duplication Level\tPercentage of total", ["percent"]),
    "overrepresented": ("Overrepresented sequences", "Sequence\tCount\tPercentage\tPossible Source", []),
    "adapter_content": ("Adapter Content", "\t".join(["Position", *R.CONTENT_ADAPTERS]), list(R.CONTENT_ADAPTERS)),
}
#: Endings that a file's name loses, in this order, for the folder of its text.
NAME_ENDINGS = [".gz", ".bz2", ".txt", ".fastq", ".fq", ".csfastq", ".sam", ".bam", ".ubam"]
#: First line of a quality-control text of a run.
TITLE = "##Quality control"
UNITS = ((10**9, "Gbp"), (10**6, "Mbp"), (10**3, "kbp"))


def ratio_text(numerator: int, denominator: int) -> str:
    """Six decimals, exactly half up; a dash without a denominator."""
    if denominator == 0:
        return "-"
    return str((Decimal(numerator) / Decimal(denominator)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def number_text(x: float | None) -> str:
    """A double as Java writes it: shortest digits, at least one decimal, an E below 0.001 and from ten million on."""
    if x is None or math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return np.format_float_positional(x, unique=True, trim="0")
    return np.format_float_scientific(x, unique=True, trim="0", exp_digits=1).replace("e+", "E").replace("e", "E")


def length_text(bases: int) -> str:
    """Bases in the largest unit that fits, with the first decimal, cut off and left out if it is zero."""
    size, unit = next(((s, u) for s, u in UNITS if bases >= s), (1, "bp"))
    whole, decimals = number_text(bases / size).split(".")
    return f"{whole}{'' if decimals[0] == '0' else '.' + decimals[0]} {unit}"


def stats_text(stats: DataFrame) -> str:
    """``name: value`` lines of a one-row statistics frame."""
    return stats_lines(stats.first().asDict())


def stats_lines(r: dict) -> str:
    known = sum(r[f"{b}_bases"] for b in "acgt")
    ratios = {"mean_length": (r["bases"], r["reads"]), "gc_fraction": (r["g_bases"] + r["c_bases"], known), "mean_quality": (r["quality_sum"], r["bases"]), "q20_fraction": (r["q20_bases"], r["bases"]), "q30_fraction": (r["q30_bases"], r["bases"])}
    return "\n".join(f"{k}: {ratio_text(*ratios[k]) if k in ratios else '-' if v is None else v}" for k, v in r.items())


def qc_modules(reads: DataFrame, digits: int | None = None) -> dict[str, DataFrame]:
    """Every module over one set of reads, by name; lengths by bins. Values are rounded only where digits are given."""
    cycles = qc.per_cycle(reads)
    return {
        "base_quality": qc.base_quality(cycles, digits), "tile_quality": qc.tile_quality(reads, digits), "read_quality": qc.read_quality(reads), "base_content": qc.base_content(cycles, digits), "gc_content": qc.read_gc(reads, digits),
        "n_content": qc.base_n(cycles, digits), "lengths": qc.length_distribution(reads), "duplication": qc.duplication_levels(reads, digits=digits), "overrepresented": qc.overrepresented(reads, digits=digits), "adapter_content": qc.adapter_content(reads, digits),
    }


def grades(reads: DataFrame, modules: dict[str, DataFrame]) -> DataFrame:
    """module and grade; lengths are graded by the lengths themselves, not by bins."""
    return qc.module_grades(modules | {"lengths": reads.select(F.length("seq").alias("len")).distinct()})


def label(first: int, last: int) -> str:
    return str(first) if first == last else f"{first}-{last}"


def basic_lines(r: dict, filename: str) -> list[str]:
    low, high = r["min_length"] or 0, r["max_length"] or 0
    values = {
        "Filename": filename, "File type": "Conventional base calls" if r["reads"] else "null", "Encoding": "Sanger / Illumina 1.9", "Total Sequences": r["reads"], "Total Bases": length_text(r["bases"]),
        "Sequence length": label(low, high), "Mean Length": r["bases"] // r["reads"] if r["reads"] else 0, "Median Length": r["median_length"] or 0, "%GC": r["gc_percent"] or 0,
    }
    return [">>Basic Statistics\tpass", "#Measure\tValue", *(f"{k}\t{v}" for k, v in values.items()), ">>END_MODULE"]


def module_lines(name: str, rows: list[dict], grade: str, sources: dict[str, str]) -> list[str]:
    title, header, columns = MODULES[name]
    lines = [f">>{title}\t{grade}"]
    if name == "duplication":
        lines.append(f"#Total Deduplicated Percentage\t{number_text(rows[0]['left_percent'])}")
    if rows or name not in ("overrepresented", "adapter_content"):
        lines.append("#" + header)
    if name == "adapter_content":
        by_place: dict[tuple, dict] = {}
        for r in rows:
            by_place.setdefault((r["first"], r["last"]), {})[r["adapter"]] = r["percent"]
        rows = [{"first": a, "last": b} | v for (a, b), v in by_place.items()]
    if name == "overrepresented":
        cells = [[r["key"], str(r["n"]), number_text(math.floor(r["percent"] * 100 + 0.5) / 100), sources.get(r["key"], "No Hit")] for r in sorted(rows, key=lambda r: (-r["n"], r["first_idx"]))]
    elif name == "duplication":
        at = {r["level"]: r["percent"] for r in rows}
        cells = [[level, number_text(at[level])] for level in qc.LEVELS]
    else:
        head = {"read_quality": "q", "gc_content": "bin"}.get(name)
        order = (lambda r: r[head]) if head else lambda r: (r.get("tile") or 0, r["first"])
        start = lambda r: [str(r[head])] if head else ([str(r["tile"])] if name == "tile_quality" else []) + [label(r["first"], r["last"])]
        cells = [start(r) + [number_text(None if r[c] is None else float(r[c])) for c in columns] for r in sorted(rows, key=order)]
    return [*lines, *map("\t".join, cells), ">>END_MODULE"]


def hit_texts(overrepresented: DataFrame, contaminants: DataFrame | None) -> dict[str, str]:
    """What explains each overrepresented key, where a contaminant does."""
    if contaminants is None:
        return {}
    hits = qc.contaminant_hits(overrepresented.select("key"), contaminants)
    return {r["key"]: f"{r['name']} ({r['identity']}% over {r['bases_matched']}bp)" for r in hits.collect()}


@dataclass(frozen=True)
class Results:
    """Rows and grades of all modules of one set of reads, what explains its overrepresented keys, and its basic statistics."""

    rows: dict[str, list[dict]]
    grades: dict[str, str]
    sources: dict[str, str]
    basic: dict


def results_of(reads: DataFrame, contaminants: DataFrame | None = None) -> Results:
    """Works out every module once, from reads that are kept meanwhile; a bounded number of rows of each reaches the driver."""
    spark, kept = reads.sparkSession, reads.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        frames, rows = {}, {}
        for name, module in qc_modules(kept).items():
            found = module.collect()
            rows[name] = [r.asDict() for r in found]
            frames[name] = spark.createDataFrame(found, module.schema)
        grade = dict(map(tuple, grades(kept, frames).collect()))
        return Results(rows, grade, hit_texts(frames["overrepresented"], contaminants), qc.basic_statistics(kept).first().asDict())
    finally:
        kept.unpersist()


def qc_text(reads: DataFrame | Results, filename: str, title: str, contaminants: DataFrame | None = None) -> str:
    """All modules of one set of reads in their fixed order, graded; values are written in full precision.

    Quality and tile modules are left out where there is nothing to show. ``title`` is the first line. Results that were
    worked out before may be given in place of the reads.
    """
    found = reads if isinstance(reads, Results) else results_of(reads, contaminants)
    lines = [title, *basic_lines(found.basic, filename)]
    for name, rows in found.rows.items():
        if rows or name not in ("base_quality", "tile_quality", "read_quality"):
            lines += module_lines(name, rows, found.grades[name], found.sources)
    return "\n".join(lines) + "\n"


def text_folders(names: list[str]) -> list[str]:
    """The folder of each file's text; a ValueError for names with a tab or line end, and for two files with one folder."""
    folders = []
    for name in names:
        base = name.rsplit("/", 1)[-1]
        if set(base) & set("\t\r\n"):
            raise ValueError(f"a quality-control text can't name {base!r}")
        for ending in NAME_ENDINGS:
            base = base.removesuffix(ending)
        folders.append(base + "_fastqc")
    if len(set(folders)) < len(folders):
        raise ValueError("two of the files would share a folder")
    return folders
