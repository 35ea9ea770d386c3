"""Connected components of links that may have hubs, without a task or a driver that sees a whole component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerlake.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node that is reachable) for every node of the links (a, b).

    In each round a node takes its smallest neighbour, if that is smaller, as its parent; parents' parents are taken until
    each node points at one that has none, in as many steps as the longest way doubles. Links are then drawn between
    those, and links that join a node to itself leave. Nodes without a parent are never neighbours, so each round at
    least halves the nodes that still have links.
    """
    edges = scratch.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    root = scratch.keep(nodes.select("node", F.col("node").alias("component")))
    while not edges.isEmpty():
        parent = scratch.keep(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = scratch.keep(parent.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
            parent = jumped.select("node", "parent")
            if jumped.where("moved").isEmpty():
                break
        moved = parent.select(F.col("node").alias("component"), F.col("parent").alias("to"))
        root = scratch.keep(root.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        for end in ("a", "b"):
            step = parent.select(F.col("node").alias(end), F.col("parent").alias("to"))
            edges = edges.join(step, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    return root
