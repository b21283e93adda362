"""Connected components of an edge table, without gathering a component or a node's links in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import checkpointed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; the component is its least node.

    Each round takes the least label among the neighbours and then jumps to the label of the label,
    so a chain of n nodes needs about log n rounds.  Labels are cut from their lineage by a
    checkpoint in the shared folder.  Null ends and loops add nothing."""
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = checkpointed(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("component")))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("component").alias("top"))
        new = checkpointed(lower.join(up, "mid", "left").select("node", F.least("mid", F.coalesce("top", "mid")).alias("component"), "old"))
        moved = new.where(F.col("component") != F.col("old")).limit(1).count()
        labels = new.drop("old")
        if not moved:
            return labels
