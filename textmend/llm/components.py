"""Connected components of a large set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import checkpointed


def components(links: DataFrame) -> DataFrame:
    """links(a, b): each node of a link with the smallest node it can reach, as (node, component).

    Each round takes the smallest label among neighbours and then the label of that label, so the number of rounds grows
    with the logarithm of a component's width. The links stay distributed; joins have one row a node on one side, so
    hot nodes can be split, and each round ends in the shared folder."""
    both = checkpointed(links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b"), F.col("a"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        new = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        # the label is itself a node, whose own label may be smaller
        step = labels.select(F.col("node").alias("c"), F.col("component").alias("next"))
        new = checkpointed(new.join(step, "c", "left").select("node", "old", F.least("c", F.coalesce("next", "c")).alias("component")))
        changed = new.where("old <> component").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
