"""Connected components over edges that may form large stars and long chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import stored


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of the component (``label``) of every ``node`` of the edges (``a``, ``b``).

    Each round links every node to the smallest node near it, from both ends of the edges, and then lets pointers
    skip ahead, so that the number of rounds grows with the logarithm of the longest path. Only (node, label)
    rows are written between rounds; a hub is reduced by partial aggregation.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("ahead"))
        # The label of a node is hooked below the smallest label that any of its nodes sees.
        seen = labels.join(near, "node").withColumn("low", F.least("label", "near"))
        hooks = seen.groupBy("label").agg(F.min("low").alias("hook"))
        after = seen.join(hooks, "label").select("node", F.least("low", "hook").alias("label"), F.col("label").alias("old"))
        after = after.join(jump, "label", "left").select("node", F.least("label", F.coalesce("ahead", "label")).alias("label"), "old")
        after = stored(after, "labels")
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels
