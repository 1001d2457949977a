"""Connected components of a distributed edge table, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: u, v (long). Returns node, root (the smallest node reachable), for nodes that have edges.

    Each round hooks every node to its smallest neighbour, shortens the chains by pointer jumping and
    contracts the edges, so the number of rounds grows with the logarithm of the longest chain.
    Loops and repeated edges do no harm; an empty table gives an empty table.
    """
    both = edges.where("u <> v").select("u", "v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    left = scratch.table(both, "edges")
    labels = None
    while not left.isEmpty():
        parent = scratch.table(left.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("parent")), "parent")
        for _ in range(2):
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            parent = scratch.table(parent.join(up, "parent").select("node", F.col("top").alias("parent")), "parent")
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("root"))
        else:
            step = parent.select(F.col("node").alias("root"), F.col("parent").alias("top"))
            labels = scratch.table(labels.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        a = parent.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        b = parent.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        left = scratch.table(left.join(a, "u").join(b, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges")
    return labels if labels is not None else left.select(F.col("u").alias("node"), F.col("v").alias("root"))
