"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeq.staging import Workspace


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, label) for each node of links (a, b); equal labels: connected. Nodes are longs in no particular order.

    Each round, every node moves to the smallest node of its closed neighbourhood and the links are contracted; at least
    half of the nodes that still have links go, so rounds grow as the logarithm of the longest path.
    """
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
    edges = work.table(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x <> y").distinct())
    labels = work.table(edges.select(F.col("x").alias("node"), F.col("x").alias("label")).distinct())
    while not edges.isEmpty():
        moves = work.table(edges.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("to")))
        moved = labels.join(moves, labels.label == moves.x, "left").select("node", F.coalesce("to", "label").alias("label"))
        right = moves.select(F.col("x").alias("y"), F.col("to").alias("to_y"))
        fewer = edges.join(moves, "x").join(right, "y").select(F.col("to").alias("x"), F.col("to_y").alias("y")).filter("x <> y").distinct()
        old = (labels, edges, moves)
        labels, edges = work.table(moved), work.table(fewer)
        for table in old:
            work.drop(table)
    return labels
