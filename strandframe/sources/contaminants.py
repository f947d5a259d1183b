"""Lists of known contaminants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the largest list.
LARGEST = 1 << 20


def parse(text: DataFrame) -> DataFrame:
    """place (line number from 1), name, bases in upper case from a column ``value`` with a whole list.

    A line is a name, one or more tabs, and bases. Lines that begin with ``#``, are blank, or have not exactly these two
    fields are passed over. Bases other than A, C, G, T fail the job with the line's number.
    """
    lines = text.select(F.posexplode(F.split("value", "\n")).alias("at", "line")).select((F.col("at") + 1).alias("place"), F.regexp_replace("line", "\r+$", "").alias("line"))
    fields = F.split(F.regexp_replace("line", "\t+$", ""), "\t+")
    kept = lines.where(~F.col("line").startswith("#") & F.col("line").rlike("[^\\x00-\\x20]")).select("place", fields.alias("f")).where(F.size("f") == 2)
    bases = F.upper(F.col("f")[1])
    wrong = F.raise_error(F.concat(F.lit("line "), F.col("place").cast("string"), F.lit(": bases other than A, C, G, T"))).cast("string")
    return kept.select("place", F.col("f")[0].alias("name"), F.when(bases.rlike("^[ACGT]+$"), bases).otherwise(wrong).alias("bases"))


def read_contaminants(spark: SparkSession, path: str) -> DataFrame:
    """The list in a file of at most 1 MiB; a larger one fails the job."""
    whole = spark.read.text(path, wholetext=True)
    size = F.col("_metadata.file_size")
    return parse(whole.select(F.when(size <= LARGEST, F.col("value")).otherwise(F.raise_error(F.lit("a contaminant list has at most 1 MiB")).cast("string")).alias("value")))


def contaminants(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """A list given as names and bases."""
    return spark.createDataFrame([(i, n, b) for i, (n, b) in enumerate(rows, 1)], "place int, name string, bases string")
