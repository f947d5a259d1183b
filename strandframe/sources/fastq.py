"""FASTQ text as a DataFrame of records with exact positions, and back.

Record numbers and byte offsets need the order of lines in a file: each byte range counts its lines, the counts are summed
over the ranges before it, and each range is then read with the number of its first line. No task sees a whole file,
unless it is compressed as one, and no line is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.validate import field_fault
from .fastq_files import FIELDS, PRESETS, FastqSource, count_lines, reachable

#: Bytes of a plain file that one task reads.
SPLIT_BYTES = 64 << 20


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """src, line_no, offset (both from 0), content and whether the line has an end; a CR goes only before an LF.

    An uncompressed file whose last line has no end is told by its size. Compressed files are taken to end their lines.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("id"),
    )
    width = F.octet_length("value") + 1
    split = raw.groupBy("src", "start").agg(F.count("*").alias("n"), F.sum(width).alias("bytes"), F.min("id").alias("first"), F.max("file_size").alias("file_size"))
    before = Window.partitionBy("src").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("src")
    split = split.select(
        "src", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.sum("n").over(whole).alias("lines"), (F.sum("bytes").over(whole) == F.col("file_size") + 1).alias("open_end"),
    )
    inside = Window.partitionBy("src", "start").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    lines = raw.drop("file_size").withColumn("skip", F.coalesce(F.sum(width).over(inside), F.lit(0))).join(split, ["src", "start"])
    number = F.col("lines_before") + F.col("id") - F.col("first")
    ended = ~(F.col("open_end") & (number == F.col("lines") - 1) & ~F.col("src").rlike(r"\.(gz|bz2|zst|lz4)$"))
    value = F.when(ended, F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))
    return lines.select("src", number.alias("line_no"), (F.col("bytes_before") + F.col("skip")).alias("offset"), value.alias("content"), (F.col("bytes_before") + F.col("skip") + width - F.when(ended, 0).otherwise(1)).alias("end"))


def file_ranges(spark: SparkSession, path: str | list[str], split_bytes: int) -> list[tuple[str, int, int]]:
    """(src, start, stop) of the byte ranges of all files that Spark finds under the path; an empty file has none."""
    meta = [F.col(f"_metadata.file_{c}") for c in ("path", "size")]
    files = spark.read.format("binaryFile").load(path).select(*meta).collect()  # a row for each file, without its content
    return [(src, at, min(at + split_bytes, size)) for src, size in sorted(map(tuple, files)) for at in range(0, size, split_bytes)]


def counted(spark: SparkSession, ranges: list[tuple[str, int, int]]) -> list[tuple[str, int, int | None, int]]:
    """(src, start, stop, lines before) of the ranges, by a job that counts lines; a gzip file becomes one range without end.

    A row of three numbers for each range reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [count_lines(*r) for r in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64())], ["no", "lines"])

    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "no long, src string, start long, stop long").repartition(max(1, min(len(ranges), 100_000)), "no")
    lines = dict(map(tuple, rows.mapInArrow(count, "no long, lines long").collect()))
    out, before = [], 0
    for i, (src, start, stop) in enumerate(ranges):
        if lines[i] < 0:
            if start == 0:
                out.append((src, 0, None, 0))
            continue
        before = 0 if start == 0 else before
        out.append((src, start, stop, before))
        before += lines[i]
    return out


def read_fastq(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """src, idx, header, seq, plus, qual, off_header, off_seq, off_plus, off_qual, end_offset.

    An incomplete last record has nulls for its missing lines. A last blank piece behind a final LF is no line. Plain
    files are read by byte ranges, which count their lines first; a gzip file (told by its content) is read by one task.
    On file systems that only Spark can open, lines are numbered by a shuffle, and gzip files are told by their names.
    """
    ranges = file_ranges(spark, path, split_bytes)
    if not all(reachable(src) for src in {r[0] for r in ranges}):
        return records_of_lines(read_lines(spark, path))
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("ranges", json.dumps(counted(spark, ranges) if ranges else [])).load()


def records_of_lines(lines: DataFrame) -> DataFrame:
    """Records out of numbered lines."""
    at = F.col("line_no") % 4
    parts = [F.max(F.when(at == i, F.col("content"))).alias(c) for i, c in enumerate(FIELDS)]
    offsets = [F.max(F.when(at == i, F.col("offset"))).alias(f"off_{c}") for i, c in enumerate(FIELDS)]
    return lines.groupBy("src", F.floor(F.col("line_no") / 4).alias("idx")).agg(*parts, *offsets, F.max("end").alias("end_offset"))


def record_text(header: Column, seq: Column, plus: Column, qual: Column, idx: Column) -> Column:
    """A record in canonical form; one that wouldn't read back fails the job."""
    fault = field_fault(header, seq, qual, plus)
    named = F.when(header.startswith("@"), header).otherwise(F.concat(F.lit("@"), header))
    value = F.concat(F.concat_ws("\n", named, seq, F.coalesce(plus, F.lit("+")), qual), F.lit("\n"))
    return F.when(fault.isNull(), value).otherwise(F.raise_error(F.concat(F.lit("unwritable record "), idx.cast("string"), F.lit(": "), fault)).cast("string"))


def write_texts(texts: DataFrame, paths: list[str], gzip: bool = False, preset: str = "even") -> None:
    """Writes each string column to a new folder of ordered part files, all in one pass; on failure nothing stays."""
    if preset not in PRESETS:
        raise ValueError("preset must be " + ", ".join(PRESETS))
    texts.sparkSession.dataSource.register(FastqSource)
    options = {"paths": json.dumps(paths), "gzip": str(gzip).lower(), "preset": preset}
    texts.write.format("fastq").mode("append").options(**options).save()


def write_fastq(records: DataFrame, path: str, order: list[str], compression: str | None = None) -> None:
    """Writes records in order into a new folder of part files; an existing path is an error. ``compression``: null or gzip."""
    plus = F.col("plus") if "plus" in records.columns else F.lit("+")
    text = record_text(F.col("header"), F.col("seq"), plus, F.col("qual"), F.col("idx"))
    write_texts(records.orderBy(*order).select(text.alias("value")), [path], compression == "gzip")


def input_state(spark: SparkSession, path: str | list[str]) -> set[tuple]:
    """Name, size and time of change of every input file; a row for each file reaches the driver."""
    meta = [F.col(f"_metadata.file_{c}") for c in ("path", "size", "modification_time")]
    return {tuple(r) for r in spark.read.format("binaryFile").load(path).select(*meta).distinct().collect()}


@contextmanager
def unchanged(spark: SparkSession, path: str | list[str]) -> Iterator[None]:
    """Fails if an input changes while several passes go over it."""
    before = input_state(spark, path)
    yield
    if input_state(spark, path) != before:
        raise RuntimeError("input changed during the passes over it")
