"""Constraints as queries: each gives its violations, and none means that it holds."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A name that ends in a dotted version.
PINNED = re.compile(r"-\d+(?:\.\d+)+$")


def uncovered(rows: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Keys that only one side has."""
    a, b = rows.select(key).distinct().withColumn("a", F.lit(1)), predictions.select(key).distinct().withColumn("b", F.lit(1))
    joined = a.join(b, key, "full_outer").where("a is null or b is null")
    return joined.select(key, F.when(F.col("b").isNull(), "missing").otherwise("unexpected").alias("violation"))


def shared(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Keys that occur with more than one value of by: pools that are not disjoint."""
    return rows.groupBy(key).agg(F.count_distinct(by).alias("n")).where("n > 1")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def changed(rows: DataFrame, stored: str, recomputed, key: str = "id") -> DataFrame:
    """Rows whose stored value is not what it should be."""
    return rows.withColumn("_now", recomputed).where(~F.col(stored).eqNullSafe(F.col("_now"))).select(key, F.col(stored).alias("stored"), F.col("_now").alias("recomputed"))


def several(rows: DataFrame, column: str) -> DataFrame:
    """The values of a column that should have one, where it has more."""
    values = rows.agg(F.array_sort(F.collect_set(column)).alias("found"))
    return values.where("size(found) > 1")


def audit(**violations: DataFrame) -> DataFrame:
    """check, n, passed: how many violations each check has."""
    each = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n", (F.col("n") == 0).alias("passed")) for name, df in violations.items()]
    return reduce(DataFrame.unionByName, each)


def observed(df: DataFrame, folder: str, **conditions) -> dict[str, bool]:
    """Writes the table and gives each condition, an aggregate over its rows, from that same pass. No rows: false where a condition is null."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, *[F.coalesce(c, F.lit(False)).alias(name) for name, c in conditions.items()]).write.parquet(folder)
    return {name: bool(seen.get[name]) for name in conditions}


def answered_rows(rows: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Every key of either side once: rows_n, predictions_n and the columns of both, those of predictions as p_ ones.

    Both sides are counted by key before they meet, so all of an audit's conditions can be seen in one pass over the result.
    """
    side = lambda df, n, mark: df.groupBy(key).agg(F.count("*").alias(n), *[F.first(c).alias(mark + c) for c in df.columns if c != key])
    return side(rows, "rows_n", "").join(side(predictions, "predictions_n", "p_"), key, "full_outer")


def tampered(found: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Files (path, sha256 as fingerprints() gives them) whose bytes are not those expected by file name, or that are missing."""
    want = found.sparkSession.createDataFrame(list(expected.items()) or [("", "")], "name string, want string").where("name <> ''")
    have = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    return want.join(have, "name", "left").where(~F.col("want").eqNullSafe(F.col("sha256"))).select("name", "want", F.col("sha256").alias("have"))


def unchanged(before: str | None, now: str, what: str) -> bool:
    """Whether the digest of what a fit was made from is known and the same; another one is refused with an error."""
    if before is not None and before != now:
        raise ValueError(f"{what} is not what it was when the fit was made; remove the fit to make it anew")
    return before is not None


def resolved(answers: DataFrame, requested: str, before: str | None = None, model: str = "model") -> DataFrame:
    """The answers with a column refused: null, or why an answer's model is not the one of this run.

    before: the model that earlier answers of the run resolved to. A requested name that ends in a version is to be answered
    by that very model; another is an alias, which the run's first answers resolve for all later ones.
    """
    why = F.when(F.col(model).isNull(), "no model")
    if before is not None:
        why = why.when(F.col(model) != before, "another model than before")
    if PINNED.search(requested):
        why = why.when(F.col(model) != requested, "another model than the pinned one")
    return answers.withColumn("refused", why)
