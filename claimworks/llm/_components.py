"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimworks.llm._lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (columns a, b of any one ordered type): root is the least node it can reach.

    A large star ties each node's larger neighbours to the least of its neighbourhood, a small star the smaller ones. The
    number of edges never grows, and rounds grow with the logarithm of the longest path. It ends when nobody with a smaller
    neighbour has another, which the least neighbours tell without a further round; they are then the roots. They are
    written before they are joined: a join of two exchanges is one whose hot keys Spark can split, which a hub's
    neighbourhood needs. What a round reads twice is written once, as every exchange has files for each pair of tasks.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        low = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        if low.where("m < u and n > 1").isEmpty():
            return low.select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        large = cut(both.join(low.select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = cut(small.where("u <> v").distinct())
