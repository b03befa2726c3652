"""Numbering rows in a global order without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimworks.llm import _tables
from claimworks.llm._lineage import cut

_PLACE = (1 << 33) - 1


def ranked(df: DataFrame, by: list[Column | str], within: str | None = None, name: str = "rank") -> DataFrame:
    """The rows with their number, from 0, in the order of by, or among the rows of their group.

    Rows are dealt by ranges of by and sorted there; a group, which must be a stretch of that order, may span several ranges,
    so a hot group is no single task. Each range then needs to know how many rows of a group lie in earlier ranges: one
    count for each range and group.
    """
    groups = [within] if within else []
    own = cut(df.repartitionByRange(_tables.blocks_wanted(df.sparkSession), *by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()))
    own = own.withColumn("_part", F.shiftright("_m", 33)).withColumn("_place", F.col("_m").bitwiseAND(F.lit(_PLACE))).drop("_m")
    runs = own.groupBy(*groups, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut(runs.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).drop("_n", "_first"))
    return own.join(runs, [*groups, "_part"]).withColumn(name, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")
