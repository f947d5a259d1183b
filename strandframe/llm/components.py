"""Connected components of links between 64-bit values, as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (v, root): the smallest value reachable from every value in a link.

    Every round takes the smallest label among neighbours, then the label of that label, so that the rounds grow with
    the logarithm of a component's width. Labels are checkpointed each round; only a count reaches the driver. A value
    with very many links is one row on the label side, and minima are combined before they are shuffled.
    """
    both = materialise(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        nearer = labels.join(near.withColumnRenamed("a", "v"), "v").select("v", F.col("root").alias("old"), F.least("root", "m").alias("hop"))
        step = nearer.join(labels.select(F.col("v").alias("hop"), F.col("root").alias("jump")), "hop")
        step = materialise(step.select("v", "old", F.least("hop", "jump").alias("root")))
        if step.where("root <> old").limit(1).count() == 0:
            return step.select("v", "root")
        labels = step.select("v", "root")
