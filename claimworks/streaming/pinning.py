"""One resolved model for each requested name: the first answer fixes it, later answers of another are refused.

What a name resolved to is kept in the state of a stream, by name, so it holds over batches and restarts. A batch may have any number of
answers of one name: only its distinct (name, model) pairs, each with the place of its first answer, go through the state, and
the decision comes back to the answers by a join, so a name that has most of the answers is no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimworks.operators.checks import PINNED

_STATE, _OUT = "model string", "requested string, resolved string"


def _resolve(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The model of one name: what the state has, or the first answer's."""
    first = None
    for frame in frames:
        for model, place in zip(frame["model"], frame["place"]):
            if model is not None and (first is None or (place, model) < first):
                first = (place, model)
    if state.exists:
        (model,) = state.get
    elif PINNED.search(key[0]):
        model = key[0]  # a name with a version is itself
    elif first is not None:
        model = first[1]
    else:
        return
    state.update((model,))
    yield pd.DataFrame({"requested": [key[0]], "resolved": [model]})


def pin(spark: SparkSession, answers: DataFrame, location: str, order: str) -> DataFrame:
    """requested, resolved of every name so far; answers: a streaming DataFrame (requested, model, and a number that orders them).

    Works off what has arrived since the last call. A name's answers are those of its batch in order; batches are as they come.
    """
    pairs = answers.select("requested", "model", F.col(order).cast("long").alias("place")).where("requested is not null")
    resolved = pairs.groupBy("requested").applyInPandasWithState(_resolve, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{location}/resolved/batch={number}")

    resolved.writeStream.outputMode("append").foreachBatch(publish).option("checkpointLocation", f"{location}/pins").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{_OUT}, batch int").parquet(f"{location}/resolved").select("requested", "resolved").distinct()


def first_answers(answers: DataFrame, order: str) -> DataFrame:
    """requested, model and the place of the pair's first answer: what pin() needs of a batch, a row for each pair."""
    return answers.groupBy("requested", "model").agg(F.min(order).alias(order))


def refused(answers: DataFrame, resolved: DataFrame) -> DataFrame:
    """answers with a column refused: null, or why an answer is not one of its name's model."""
    why: Column = F.when(F.col("model").isNull(), "no model").when(~F.col("model").eqNullSafe(F.col("resolved")), F.when(F.col("requested") == F.col("resolved"), "another model than the pinned one").otherwise("another model than before"))
    return answers.join(resolved, "requested", "left").withColumn("refused", why).drop("resolved")
