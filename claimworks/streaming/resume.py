"""Scoring that resumes: files arrive, pending rows are scored once, counts are kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimworks.functions.hashing import configuration_digest
from claimworks.functions.scores import outcome
from claimworks.operators.lineage import exists


def run_location(root: str, identity: dict) -> str:
    """A run's folder, named by its identity: another identity never meets this one's checkpoints or cache."""
    return f"{root.rstrip('/')}/run-{configuration_digest(identity)[:16]}"


def score_new_files(spark: SparkSession, incoming: DataFrame, location: str, score: Callable[[DataFrame], DataFrame], key: str = "id") -> None:
    """Scores what has arrived since the last call. incoming is a streaming DataFrame.

    A batch that was cut short runs again; what its first run cached is not scored twice, as each batch is checked against
    the cache before it is scored.
    """

    def run(batch: DataFrame, number: int) -> None:
        cache = f"{location}/cache"
        new = batch.dropDuplicates([key])
        if exists(spark, cache):
            new = new.join(spark.read.parquet(cache).select(key), key, "left_anti")
        score(new).write.mode("append").parquet(cache)

    incoming.writeStream.foreachBatch(run).option("checkpointLocation", f"{location}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def running_confusion(spark: SparkSession, incoming: DataFrame, accepted: Column, location: str, by: str = "dataset", label: str = "label") -> DataFrame:
    """Counts of outcomes by source over everything that has arrived, kept in the stream's state and written after each batch."""
    counts = incoming.withColumn("outcome", outcome(F.col(label), accepted)).groupBy(by).agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "FN", "FP", "TN")])

    def publish(table: DataFrame, number: int) -> None:
        table.write.mode("overwrite").parquet(f"{location}/confusion")

    counts.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", f"{location}/confusion-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{location}/confusion")
