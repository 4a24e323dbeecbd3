"""Connected components of an edge table by joins alone (hooking and shortcutting); nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonflow.llm.common import drop_table, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the smallest node reachable.

    A union-find forest kept as a table: each round hooks a node, and the root above it, to the smallest grandparent
    among its neighbours, then halves all paths. Rounds grow with the logarithm of the longest path.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).where("u != v").distinct()
    both = materialize(both, "cc-edges")
    parents = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("parent")), "cc-parents")
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        forest = materialize(parents.join(up, "parent").select("node", "parent", "above"), "cc-forest")
        near = both.join(forest.select(F.col("node").alias("v"), "above"), "v").groupBy(F.col("u").alias("node")).agg(F.min("above").alias("low"))
        hooks = near.join(forest.select("node", "parent"), "node")
        proposals = (
            hooks.select("node", F.col("low").alias("to"))
            .union(hooks.select(F.col("parent").alias("node"), F.col("low").alias("to")))
            .union(forest.select("node", F.col("above").alias("to")))
        )
        better = proposals.groupBy("node").agg(F.min("to").alias("to"))
        new = materialize(parents.join(better, "node").select("node", F.least("parent", "to").alias("parent"), (F.col("to") < F.col("parent")).alias("moved")), "cc-parents")
        done = new.where("moved").isEmpty()
        drop_table(parents)
        drop_table(forest)
        parents = new.select("node", "parent")
        if done:
            drop_table(both)
            return parents.select("node", F.col("parent").alias("component"))
