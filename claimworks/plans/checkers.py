"""Checkers as parameters: how a cache of answers becomes a score, and what a report holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimworks.functions import scores, text
from claimworks.operators import joins, metrics


@dataclass(frozen=True)
class Checker:
    """kind: 'probabilities' (a map answers by question), 'logits' (a map of [no, yes] pairs) or 'score' (as cached)."""

    name: str
    kind: str = "probabilities"
    inverted: tuple[str, ...] = ("unsupported", "contradicted")
    temperature: float = 1.0
    threshold: float = 0.30

    def score(self) -> Column:
        if self.kind == "probabilities":
            values = F.transform_values("answers", lambda k, v: F.when(k.isin(list(self.inverted)), 1 - v).otherwise(v))
            return F.array_min(F.map_values(values))
        if self.kind == "logits":
            return scores.decided(F.col("logits"), list(self.inverted), self.temperature)
        if self.kind == "score":
            return F.col("score")
        raise ValueError(self.kind)


def report(rows: DataFrame, cache: DataFrame, checker: Checker, *, whole: bool = False) -> DataFrame:
    """model and the metrics of the rows that the cache has; complete: whether it has all. whole: a row without an answer is an error."""
    if whole and (lost := joins.pending(rows, cache).select("id").first()):
        raise ValueError(f"{checker.name} has no answer for {lost.id}")
    keyed = cache.select("id", checker.score().alias("_score"))
    held = rows.join(keyed, "id")
    missing = joins.pending(rows, cache).agg((F.count("*") == 0).alias("complete")).withColumn("_k", F.lit(1))
    found = metrics.metrics(held, "_score", checker.threshold).withColumn("_k", F.lit(1))
    return found.join(F.broadcast(missing), "_k").select(F.lit(checker.name).alias("model"), F.lit(checker.threshold).alias("threshold"), *[c for c in found.columns if c != "_k"], "complete")  # one row


def comparison(*reports: DataFrame) -> DataFrame:
    """scope and a cell for each model's balanced accuracy."""
    union = reports[0]
    for r in reports[1:]:
        union = union.unionByName(r)
    models = [r.model for r in union.select("model").distinct().orderBy("model").collect()]  # as many rows as models
    cells = union.groupBy("scope").pivot("model", models).agg(F.first("balanced_accuracy"))
    return cells.select("scope", *[text.percent(F.col(f"`{m}`")).alias(m) for m in models])


def check_claim(spark, document: str, claim: str, answers: dict[str, float], checker: Checker) -> tuple[float, str]:
    """Score and verdict of one claim."""
    row = spark.createDataFrame([(document, claim, answers)], "doc string, claim string, answers map<string,double>").select(checker.score().alias("s")).first()
    return row.s, "Supported" if row.s > checker.threshold else "Refuted"
