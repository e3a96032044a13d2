"""Connected components of an undirected graph, by rounds of joins.

Every round hooks each component to the smallest label among its neighbours and
then shortens the label chains by one jump.  A round writes its labels to the
shared folder, so lost executors cost one round at most and the lineage stays
short.  Labels only get smaller, so the loop ends; it takes about log of the
longest path for paths and one or two rounds for stars.  Hot nodes (hubs) are
reduced by partial aggregation before any shuffle; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Columns ``node``, ``root`` (smallest node of its component) of all nodes in ``edges`` (a, b).

    Null ends and loops are ignored.
    """
    edges = edges.filter("a is not null and b is not null and a != b").select("a", "b")
    both = scratch.table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{name}-0")
    step = 0
    while True:
        # Smallest label next to each node, sent to the node's own root as well.
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("far")), "b").groupBy("a").agg(F.min("far").alias("far"))
        offered = labels.join(near.withColumnRenamed("a", "node"), "node")
        hooks = offered.groupBy("root").agg(F.min("far").alias("far")).filter("far < root").withColumnRenamed("root", "old")
        hooks = scratch.table(hooks, f"{name}-hooks-{step}")
        if hooks.isEmpty():
            return labels
        new = labels.join(hooks, F.col("root") == F.col("old"), "left").select("node", F.coalesce("far", "root").alias("root"))
        jumped = new.alias("n").join(new.select(F.col("node").alias("at"), F.col("root").alias("up")), F.col("n.root") == F.col("at"), "left").select("node", F.least(F.coalesce("up", "root"), "root").alias("root"))
        step += 1
        labels = scratch.table(jumped, f"{name}-{step}")
        scratch.drop(f"{name}-hooks-{step - 1}")
        scratch.drop(f"{name}-{step - 1}")
