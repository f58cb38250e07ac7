"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabwise.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges (a, b)``; component = the smallest node reachable.

    Every round hooks each node to its smallest neighbour, follows the pointers
    to their roots by doubling, and contracts the edges to those roots.  Hooks
    are minima (combined before the shuffle, so a hub is one row a task) and
    contracted edges are made distinct; a hub's side of the contraction join is
    left to adaptive skew splitting.  Null ends and self loops give no edge.
    No component or edge list reaches the driver.
    """
    spark, step = scratch.spark, 0
    edges = (edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    edges = scratch.write(edges, f"{name}-edges0")
    labels = scratch.write(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                           .withColumn("component", F.col("node")), f"{name}-labels0")
    while not edges.isEmpty():
        step += 1
        hooks = scratch.write(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")),
                              f"{name}-hooks{step}-0")
        jump = 0
        while True:
            jump += 1
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            further = scratch.write(hooks.join(up, "root", "left").select(
                "node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")),
                f"{name}-hooks{step}-{jump}")
            scratch.drop(f"{name}-hooks{step}-{jump - 1}")
            hooks = further.select("node", "root")
            if further.where("moved").isEmpty():
                break
        at = hooks.select(F.col("node").alias("component"), F.col("root").alias("_root"))
        labels = scratch.write(labels.join(at, "component", "left").select(
            "node", F.coalesce("_root", "component").alias("component")), f"{name}-labels{step}")
        for end in ("a", "b"):
            edges = edges.join(hooks.select(F.col("node").alias(end), F.col("root").alias("_root")), end, "left") \
                .select(F.coalesce("_root", end).alias(end), "b" if end == "a" else "a")
        edges = scratch.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                              .distinct(), f"{name}-edges{step}")
        scratch.drop(f"{name}-edges{step - 1}", f"{name}-labels{step - 1}", f"{name}-hooks{step}-{jump}")
    return labels
