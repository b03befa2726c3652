"""Calibration: weighted logistic regression, grouped folds, the one-standard-error choice, transferred thresholds."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimworks.functions.scores import clipped_logit, linear
from claimworks.operators import digests
from claimworks.operators.checks import unchanged
from claimworks.operators.lineage import exists
from claimworks.operators.metrics import metrics, tuned, vetoed_mean


def with_weights(rows: DataFrame, by: tuple[str, ...] = ("dataset", "label")) -> DataFrame:
    """Weights that make every stratum count the same and average 1: n / (strata * rows of the stratum)."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    totals = sizes.agg(F.sum("_n").alias("_all"), F.count("*").alias("_strata")).withColumn("_k", F.lit(1))
    sizes = sizes.withColumn("_k", F.lit(1)).join(totals, "_k")
    return rows.join(sizes, list(by)).withColumn("weight", F.col("_all").cast("double") / (F.col("_strata") * F.col("_n"))).drop("_n", "_k", "_all", "_strata")


@dataclass
class Fitted:
    features: list[str]
    weights: list[float]
    bias: float
    logits: bool

    def score(self, rows: DataFrame, name: str = "score") -> DataFrame:
        parts = [clipped_logit(F.col(f)) if self.logits else F.col(f) for f in self.features]
        return rows.withColumn(name, linear(parts, self.weights, self.bias))


def fit(rows: DataFrame, features: list[str], c: float, *, logits: bool = False, label: str = "label", weight: str = "weight") -> Fitted:
    """L2-penalised logistic regression with inverse penalty c, on the scores or on their clipped logits."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    inputs = rows.select(label, weight, *[(clipped_logit(F.col(f)) if logits else F.col(f)).alias(f) for f in features])
    total = inputs.agg(F.sum(weight)).first()[0]
    vectors = VectorAssembler(inputCols=features, outputCol="_x").transform(inputs)
    model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol=weight, standardization=False, elasticNetParam=0.0, regParam=1.0 / (c * total), tol=1e-9, maxIter=5000).fit(vectors)
    return Fitted(features, [float(w) for w in model.coefficients], float(model.intercept), logits)


def with_fold_weights(rows: DataFrame, folds: int, by: tuple[str, ...] = ("dataset", "label")) -> DataFrame:
    """fold_weights: for each fold (column fold), the weight that with_weights() gives the row where that fold is left out."""
    every, left = range(folds), [f"_left{f}" for f in range(folds)]
    sizes = rows.groupBy(*by).agg(*[F.count(F.when(F.col("fold") != f, 1)).alias(left[f]) for f in every])
    totals = sizes.agg(*[x for f in every for x in (F.sum(left[f]).alias(f"_all{f}"), F.count(F.when(F.col(left[f]) > 0, 1)).alias(f"_strata{f}"))]).withColumn("_k", F.lit(1))
    weight = lambda f: F.when(F.col(left[f]) > 0, F.col(f"_all{f}").cast("double") / (F.col(f"_strata{f}") * F.col(left[f])))
    weights = sizes.withColumn("_k", F.lit(1)).join(totals, "_k").select(*by, F.array(*[weight(f) for f in every]).alias("fold_weights"))
    return rows.join(weights, list(by), "left")


def out_of_fold(rows: DataFrame, features: list[str], c: float, folds: int, *, logits: bool = False) -> DataFrame:
    """Every row (column fold) scored by the model of the other folds. Rows that already have their fold_weights are not counted again."""
    weighed = rows if "fold_weights" in rows.columns else with_fold_weights(rows, folds)
    train = lambda f: weighed.where(F.col("fold") != f).withColumn("weight", F.col("fold_weights")[f]).where("weight is not null")
    parts = [fit(train(f), features, c, logits=logits).score(rows.where(F.col("fold") == f)) for f in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spread(folds: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean, sample deviation and standard error of a value over folds."""
    return folds.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))


def one_standard_error(candidates: DataFrame) -> DataFrame:
    """Of candidates (c, mean, se): within the best one's standard error, the least c, then the largest mean, then no logits where both were tried."""
    best = F.max_by(F.col("mean") - F.col("se"), "mean").over(Window.partitionBy())
    return candidates.withColumn("least", best).where("mean >= least").orderBy("c", F.col("mean").desc(), *[x for x in ("logits",) if x in candidates.columns]).limit(1).drop("least")


def transferred(development: DataFrame, test: DataFrame, score: str, fixed: float = 0.30, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """keys, rule ('fixed' or 'fitted'), threshold, macro: thresholds fitted on development rows, applied to test rows."""
    fitted = tuned(development, score, list(keys)).select(*keys, "threshold")
    rules = fitted.select(*keys, F.explode(F.array(F.struct(F.lit("fixed").alias("rule"), F.lit(fixed).alias("t")), F.struct(F.lit("fitted").alias("rule"), F.col("threshold").alias("t")))).alias("x")).select(*keys, "x.*")
    rows = test.join(rules, list(keys)).withColumn("accepted", F.col(score) > F.col("t"))
    recall = lambda v, hit: F.avg(F.when(F.col("label") == v, hit.cast("double")))
    sources = rows.groupBy(*keys, "rule", "t", "dataset").agg(((recall(1, F.col("accepted")) + recall(0, ~F.col("accepted"))) / 2).alias("b"))
    return sources.groupBy(*keys, "rule", F.col("t").alias("threshold")).agg(F.round(vetoed_mean("b"), 12).alias("macro"))


def fit_threshold(development: DataFrame, score: str, folder: str, key: str = "id") -> float:
    """A threshold tuned on development rows, kept in a folder with what it was made from.

    A second fit of the same rows gives the first one's threshold; one of other rows is refused.
    """
    spark = development.sparkSession
    before = _fitted(spark, folder)
    if before is not None:
        unchanged(before["root"], digests.root(development, key), folder)
        return before["threshold"]
    made = {"root": digests.store(development, key, f"{folder}/input"), "score": score, "threshold": tuned(development, score).first().threshold}
    spark.createDataFrame([(json.dumps(made),)], "value string").coalesce(1).write.text(f"{folder}/fit")
    return made["threshold"]


def apply_threshold(development: DataFrame, rows: DataFrame, folder: str, key: str = "id") -> DataFrame:
    """rows with a column accepted by the folder's threshold, if the development rows are still those it was made from."""
    made = _fitted(rows.sparkSession, folder)
    if made is None:
        raise FileNotFoundError(f"{folder}: no fit")
    unchanged(made["root"], digests.root(development, key), folder)
    return rows.withColumn("accepted", F.col(made["score"]) > made["threshold"])


def _fitted(spark, folder: str) -> dict | None:
    return json.loads(spark.read.text(f"{folder}/fit").first().value) if exists(spark, f"{folder}/fit/_SUCCESS") else None


def largest_difference(a: DataFrame, b: DataFrame, score: str, threshold: float, key: str = "id") -> DataFrame:
    """Largest difference of two scorings, and whether they decide alike."""
    j = a.select(key, F.col(score).alias("x")).join(b.select(key, F.col(score).alias("y")), key)
    return j.agg(F.count("*").alias("n"), F.max(F.abs(F.col("x") - F.col("y"))).alias("difference"), F.bool_and((F.col("x") > threshold) == (F.col("y") > threshold)).alias("same"))


__all__ = ["apply_threshold", "fit", "fit_threshold", "largest_difference", "metrics", "one_standard_error", "out_of_fold", "spread", "transferred", "with_fold_weights", "with_weights", "Fitted"]
