"""Context graphs: undirected (entity, entity, relation) triples and their connected parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimworks.operators.lineage import kept


def parts(triples: DataFrame) -> DataFrame:
    """node, part: the least node that each node (columns a, b of the triples) is connected with.

    Large and small stars take turns until nothing changes: a large star ties each node's larger neighbours to the least of
    its neighbourhood, a small star the smaller ones. The number of edges never grows, and rounds grow with the logarithm of
    the longest path. Each round is written to the shared folder.
    """
    edges = kept(triples.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ties = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = kept(large.join(low, "u").select(F.explode(ties).alias("x")).select("x.u", "x.v").where("u <> v").distinct())
        after = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    nodes = triples.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("part")), "node", "left").select("node", F.coalesce("part", "node").alias("part"))


def shapes(triples: DataFrame, labels: DataFrame) -> DataFrame:
    """part, triples, nodes, branched: each part's number of triples and nodes, and whether a node has more than two neighbours."""
    degrees = triples.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    nodes = labels.join(degrees, "node").groupBy("part").agg(F.count("*").alias("nodes"), (F.max("degree") > 2).alias("branched"))
    hops = triples.join(labels, triples.a == labels.node).groupBy("part").agg(F.count("*").alias("triples"))
    return hops.join(nodes, "part")
