"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b) but the roots; a root is the smallest node of its
    component. Edges from a node to itself say nothing.

    Alternating large-star and small-star steps: each links a node's neighbours to the least of them, and the number
    of rounds grows with the logarithm of the longest path. It ends when each node has one smaller neighbour, which has
    none itself. Each round is written to the shared folder, so a lost executor costs one round. Minima are taken before
    the shuffle and written before they are joined, so that a node with very many neighbours is neither gathered in one
    task nor joined in one: the sides of the join are plain exchanges, which adaptive execution splits.
    """
    pairs = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m"), F.lit(1).alias("up")),
                                              F.struct(F.col("v").alias("n"), F.col("u").alias("m"), F.lit(0).alias("up")))).alias("e"))
        nodes = ends.groupBy("e.n").agg(F.least("n", F.min("e.m")).alias("m"), F.sum("e.up").alias("ups"), F.count(F.lit(1)).alias("all"))
        nodes = scratch.keep(nodes)
        if nodes.where((F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("all") > F.col("ups"))).isEmpty():
            scratch.drop(nodes)
            return pairs.withColumnsRenamed({"u": "node", "v": "root"})
        large = pairs.join(nodes.select(F.col("n").alias("v"), "m"), "v").select("u", F.col("m").alias("v"))
        large = scratch.keep(large.distinct())
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        made = scratch.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(pairs, nodes, large, least)
        pairs = made
