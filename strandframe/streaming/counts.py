"""Running statistics over a folder of FASTQ files as they arrive, with Structured Streaming.

Each micro-batch is aggregated on its own and its one row is appended to a table; totals are sums of those rows, so no
state grows with the stream. Files must be complete when they appear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stats import read_stats
from ..sources.fastq import read_fastq


def stream_stats(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts the stream; rows of per-batch statistics are appended to ``out`` as Parquet."""
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")

    def write(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # names of the files of one batch
        if paths:
            rows = read_stats(read_fastq(spark, paths))
            rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = names.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """Totals over all batches so far."""
    rows = spark.read.parquet(out)
    sums = [c for c in rows.columns if c in ("reads", "bases", "quality_sum") or c.endswith("_bases")]
    return rows.agg(*(F.sum(c).alias(c) for c in sums), F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"))
