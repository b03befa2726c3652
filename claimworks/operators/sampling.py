"""Deterministic samples by hash, by stratum, interleaved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimworks.functions.hashing import digest, pool, text_group
from claimworks.functions.scores import once

SEED = "claimworks-1"


def with_pool(rows: DataFrame, text: str = "doc") -> DataFrame:
    """group and pool of each row; copies of a text are always in one pool."""
    return once(rows, group=text_group(F.col(text))).withColumn("pool", pool(F.col("group")))


def seeded(row_id: str = "id", seed: str = SEED) -> Column:
    """A row's place in the seed's random order."""
    return digest(F.lit(seed), F.col(row_id))


def stratified(rows: DataFrame, by: list[str], size: int, order: Column | None = None) -> DataFrame:
    """The first rows of each stratum in random order, with their place and the stratum's size."""
    order = seeded() if order is None else order
    rows = rows.withColumn("_order", order)
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_order", "id"))).where(F.col("place") <= size)
    return top.drop("_order")


def interleaved(rows: DataFrame, by: list[str], order: list[str], limit: int = 0) -> DataFrame:
    """Rows in turn from each stratum, so that every prefix is balanced; position counts from 1. A limit of 0 keeps all.

    A row's position follows from its turn and the strata's sizes: the rows of earlier turns, and the earlier strata that
    still have one in this turn. No task sees more than a stratum.
    """
    turn = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    if limit:
        turn = turn.where(F.col("_turn") <= limit)
    stratum = F.struct(*by)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.array_sort(F.collect_list(F.struct(*by, F.col("_n")))).alias("_sizes")).withColumn("_k", F.lit(1))
    joined = turn.withColumn("_k", F.lit(1)).withColumn("_s", stratum).join(F.broadcast(sizes), "_k")  # one row, a number for each stratum
    earlier = F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, x: a + F.least(x["_n"], F.col("_turn").cast("long") - 1))
    same = F.size(F.filter("_sizes", lambda x: (x["_n"] >= F.col("_turn")) & (F.struct(*[x[c].alias(c) for c in by]) < F.col("_s"))))
    out = joined.withColumn("position", (earlier + same + 1).cast("int")).drop("_turn", "_k", "_s", "_sizes")
    return out.where(F.col("position") <= limit) if limit else out


def hash_subset(rows: DataFrame, limit: int, row_id: str = "id") -> DataFrame:
    """The rows with the least hashes of their id; a limit of 0 keeps all."""
    return rows.orderBy(F.sha2(row_id, 256), row_id).limit(limit) if limit else rows


def in_order(subset: DataFrame, position: str) -> DataFrame:
    """A subset of a known few rows back in the order of the whole, with place from 1."""
    return subset.withColumn("place", F.row_number().over(Window.orderBy(position)))


def by_number(rows: DataFrame, row_id: str = "id") -> DataFrame:
    """The rows by the number after the colon of their id: 9 before 10."""
    return rows.orderBy(F.split_part(row_id, F.lit(":"), F.lit(2)).cast("long"), row_id)


def remaining(rows: DataFrame, used: DataFrame, by: list[str]) -> DataFrame:
    """How many rows of each stratum are left after those used; strata without any are absent."""
    return rows.join(used.select("id"), "id", "left_anti").groupBy(*by).agg(F.count("*").alias("n"))


def group_folds(rows: DataFrame, group: str, folds: int) -> DataFrame:
    """group, n, fold: the largest group first, each to the lightest fold, then the lower one. For evaluation sets: groups
    are counted in Spark and dealt out by one task."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", group], ascending=[False, True])
        weight, out = [0] * folds, []
        for n in frame.n:
            f = weight.index(min(weight))
            weight[f] += n
            out.append(f)
        return frame.assign(fold=out)[[group, "n", "fold"]]

    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    return counts.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, f"{group} string, n long, fold int")
