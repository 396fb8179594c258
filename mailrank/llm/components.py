"""Connected components of links between numbers, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrank.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``); equal labels are one component.

    Each round every node points to its smallest neighbour or itself, pointers are followed
    once more, and the links move to where their ends point; those inside a node fall away.
    Every round removes all nodes but local minima and what they point to, and the rounds end
    when no link is left. Rounds are written tables; sums by node are combined before the
    shuffle, and joins on a frequent node are left to the skew join.
    """
    edges = written(links.where("a <> b").distinct(), "links")
    labels = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        first = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        first = written(first, "parents")
        up = first.select(F.col("a").alias("p"), F.col("p").alias("q"))
        parents = written(first.join(up, "p").select("a", F.col("q").alias("p")), "parents")
        to_b = parents.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(parents, "a").join(to_b, "b").where("p <> pb")
        edges = written(moved.select(F.least("p", "pb").alias("a"), F.greatest("p", "pb").alias("b")).distinct(), "links")
        on_label = parents.select(F.col("a").alias("label"), "p")
        labels = labels.join(on_label, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        labels = written(labels, "labels")
    return labels
