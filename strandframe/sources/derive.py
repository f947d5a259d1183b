"""Reads and pairs derived from ordinary tables by expressions that Spark and DuckDB both evaluate to the same values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values of common library kits.
ADAPTER_1 = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"
ADAPTER_2 = "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"

_HEX = "0123456789abcdef"
_BASES = "ACGTACGTACGTACGN"
_QUALS = "#+5:?ABCDEFGHIII"


def _hashed(letters: str, key: str, to: str, kind: str) -> str:
    parts = ", ".join(f"md5(concat('{c}', cast({key} as {kind})))" for c in letters)
    return f"translate(concat({parts}), '{_HEX}', '{to}')"


def read_columns(kind: str) -> dict[str, str]:
    """Expressions over ``documents``; ``kind`` is the dialect's string type."""
    n = "cast(20 + doc_id % 45 as int)"
    return {
        "idx": "doc_id",
        "header": f"concat('A00123:8:HFLKW:1:', cast(1101 + doc_id % 4 as {kind}), ':', cast(doc_id % 1000 as {kind}), ':2000 1:N:0:ACGT')",
        "seq": f"substr({_hashed('st', '(doc_id % 700)', _BASES, kind)}, 1, {n})",
        "qual": f"substr({_hashed('qr', 'doc_id', _QUALS, kind)}, 1, {n})",
        "src": "source",
    }


def pair_columns(kind: str) -> dict[str, str]:
    """Expressions over ``events``: fragments of 30 to 120 bases read from both ends, with adapters, errors and poly-G tails."""
    size = "cast(30 + event_id % 91 as int)"
    frag = f"substr({_hashed('fghi', '(event_id % 5000)', _BASES, kind)}, 1, {size})"
    back = f"reverse(translate({frag}, 'ACGT', 'TGCA'))"
    first = f"substr(concat({frag}, '{ADAPTER_1}', repeat('A', 60)), 1, 60)"
    second = f"substr(concat({back}, '{ADAPTER_2}', repeat('A', 60)), 1, 60)"
    head = f"concat('A00123:8:HFLKW:1:', cast(1101 + event_id % 4 as {kind}), ':', cast(event_id as {kind}), ':2000 "
    return {
        "idx": "event_id",
        "h1": head + "1:N:0:ACGT')",
        "s1": f"case when event_id % 11 = 0 then concat(substr({first}, 1, 45), repeat('G', 15)) else {first} end",
        "q1": f"substr({_hashed('ab', 'event_id', _QUALS, kind)}, 1, 60)",
        "h2": head + "', case when event_id % 13 = 0 then '1' else '2' end, ':N:0:ACGT')",
        "s2": f"case when event_id % 5 = 0 then concat(substr({second}, 1, 9), 'T', substr({second}, 11)) else {second} end",
        "q2": f"substr({_hashed('cd', 'event_id', _QUALS, kind)}, 1, 60)",
    }


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.selectExpr(*(f"{e} as {c}" for c, e in read_columns("string").items()))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(*(f"{e} as {c}" for c, e in pair_columns("string").items()))


def reads_sql() -> str:
    """The same reads as a DuckDB subquery."""
    return "(select " + ", ".join(f"{e} as {c}" for c, e in read_columns("varchar").items()) + " from documents)"


def pairs_sql() -> str:
    return "(select " + ", ".join(f"{e} as {c}" for c, e in pair_columns("varchar").items()) + " from events)"
