"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hushframe.llm.frames import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each end of ``links`` (a, b): the smallest node reachable.

    Each round every node takes the smallest label among itself and its
    neighbours, then the label of that label, so labels jump along chains.
    The link table keeps its size; rounds end when no label changes. Tables
    between rounds are written to the shared folder.
    """
    links = links.where("a <> b")
    both = materialize(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select("node", F.least("component", "m").alias("next"), F.col("component").alias("old"))
        parents = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        moved = materialize(lower.join(parents, "next").select("node", F.least("next", "beyond").alias("component"), (F.col("old") != F.least("next", "beyond")).alias("changed")))
        labels = moved.select("node", "component")
        if moved.where("changed").isEmpty():
            return labels
