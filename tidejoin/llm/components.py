"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidejoin.llm.staging import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for every node of edges (a, b).

    Each round takes the least label among the neighbours, then that label's own label, and is
    written to the shared folder; only the number of changes comes to the driver.
    """
    both = staged(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("theirs")), "other")
        near = near.groupBy("node").agg(F.min("theirs").alias("theirs"))
        least = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "theirs").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = staged(least.join(jump, "label").select("node", "was", F.least("label", "next").alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where("was <> label").isEmpty():
            return labels
