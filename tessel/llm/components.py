"""Connected components over link tables, by distributed minimum-label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every endpoint of edges (a, b); comp is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, then the label of that
    label (pointer jumping), so the rounds grow with the logarithm of a chain's length.
    Labels are a table in the shared folder after each round; nothing reaches the driver
    but the count of changes. No edges give no rows.
    """
    both = materialize(edges.select("a", "b").where("a <> b").union(edges.selectExpr("b", "a").where("a <> b")).distinct(), "links", light=True)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels", light=True)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        after = materialize(low.join(jump, "comp").select("node", F.least("comp", "next").alias("comp"), "was"), "labels", light=True)
        labels = after.select("node", "comp")
        if after.where("comp <> was").isEmpty():
            return labels


def with_component(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """rows with the component of their `node` column; a node without links is its own."""
    own = labels.select(F.col("node").alias(node), F.col("comp").alias(name))
    return rows.join(own, node, "left").withColumn(name, F.coalesce(name, node))


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels after more edges (a, b): only the components that the edges touch are linked anew."""
    between = with_component(with_component(edges.select("a", "b"), labels, "a", "ca"), labels, "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    lower = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("low"))
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    nodes = labels.unionByName(ends.join(labels, "node", "left_anti").withColumn("comp", F.col("node")))
    return materialize(nodes.join(lower, "comp", "left").select("node", F.coalesce("low", "comp").alias("comp")), "labels", light=True)
