"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.sources.scratch import stage


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the label is the component's smallest node.

    Every round, a node takes the smallest label around it and then that label's own label, so chains
    shrink by doubling. Each round is staged; the loop ends when no label changes. Links are first
    reduced to one per pair. The sums are pre-aggregated, so a node with many links is no hot key.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage(both, "links")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("seen"))
        near = labels.join(around, F.col("node") == F.col("a")).select(
            "node", F.least("label", "seen").alias("to"), F.col("label").alias("old")
        )
        near = stage(near, "near-labels")
        own = near.select(F.col("node").alias("via"), F.col("to").alias("further"))
        labels = near.join(own, F.col("to") == F.col("via")).select("node", F.least("to", "further").alias("label"), "old")
        labels = stage(labels, "labels")
        if labels.filter(F.col("label") != F.col("old")).isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
