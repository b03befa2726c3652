"""Where a rule goes wrong: confusion counts, counterfactual rules, samples of errors, costs and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimworks.functions.scores import outcome

OUTCOMES = ("TP", "FN", "FP", "TN")


def with_outcome(rows: DataFrame, accepted: Column, label: str = "label") -> DataFrame:
    return rows.withColumn("accepted", accepted).withColumn("outcome", outcome(F.col(label), F.col("accepted")))


def confusion(rows: DataFrame, by: str = "dataset") -> DataFrame:
    """Counts of each outcome by source, and the rates that follow from them (null over nothing)."""
    counts = rows.groupBy(by).agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in OUTCOMES])
    tpr, tnr = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    return counts.withColumns({"supported_recall": tpr, "unsupported_recall": tnr, "balanced_accuracy": (tpr + tnr) / 2, "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))})


def counterfactuals(rows: DataFrame, rules: dict[str, Column], label: str = "label") -> DataFrame:
    """rule and its pooled counts and balanced accuracy, for each other rule over the same rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), r.alias("accepted")) for n, r in rules.items()]))
    spread = rows.select(label, pairs.alias("x")).select(label, "x.*").withColumn("outcome", outcome(F.col(label), F.col("accepted")))
    return confusion(spread, "rule")


def gate_changes(rows: DataFrame, rule: Column, other: Column, label: str = "label") -> DataFrame:
    """How many rows of each class the other rule accepts that the rule does not."""
    more = ~rule & other
    return rows.agg(F.count_if(more & (F.col(label) == 1)).alias("additional_tp"), F.count_if(more & (F.col(label) == 0)).alias("additional_fp"))


def confident_errors(rows: DataFrame, score: str, high: float = 0.70, low: float = 0.10, by: str = "dataset") -> DataFrame:
    return rows.groupBy(by).agg(F.count_if((F.col("outcome") == "FP") & (F.col(score) >= high)).alias("confident_fp"), F.count_if((F.col("outcome") == "FN") & (F.col(score) <= low)).alias("confident_fn"))


def error_sample(rows: DataFrame, order: Column, size: int = 4, by: tuple[str, ...] = ("dataset", "outcome")) -> DataFrame:
    """The first errors of each stratum in random order, the stratum's size, and a number through all of them."""
    errors = rows.where(F.col("outcome").isin("FN", "FP")).withColumn("_o", order)
    stratum = Window.partitionBy(*by)
    top = errors.withColumn("place", F.row_number().over(stratum.orderBy("_o", "id"))).withColumn("stratum_errors", F.count("*").over(stratum)).where(F.col("place") <= size)
    return top.withColumn("review_index", F.row_number().over(Window.orderBy(*by, "place"))).drop("_o")


def tallies(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return rows.groupBy(row).pivot(column, values).count().na.fill(0)


def latencies(rows: DataFrame, column: str, points: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Interpolated percentiles and the median; null without rows."""
    return rows.agg(F.count(column).alias("n"), *[F.percentile(column, p).alias(f"p{round(p * 100)}") for p in points], F.median(column).alias("median"))


def usage(rows: DataFrame, stage: str, price_in: float | None, price_out: float | None) -> DataFrame:
    """Responses, retries, tokens and cost of each stage and in all ('(total)')."""
    summed = rows.rollup(stage).agg(F.grouping(stage).alias("g"), F.count("*").alias("responses"), F.sum(F.col("attempts") - 1).alias("retries"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    from claimworks.functions.scores import cost

    return summed.select(F.when(F.col("g") == 1, "(total)").otherwise(F.col(stage)).alias(stage), "responses", "retries", "tokens_in", "tokens_out", cost(F.col("tokens_in"), F.col("tokens_out"), price_in, price_out).alias("usd"))


def consistency(full: DataFrame, reduced: DataFrame, key: str = "id") -> DataFrame:
    """Of rows judged on the full document and without the evidence: how many are right on both, and of those accepted."""
    joined = full.select(key, F.col("accepted").alias("f")).join(reduced.select(key, F.col("accepted").alias("r")), key)
    both = F.count_if(F.col("f") & ~F.col("r"))
    return joined.agg(F.count("*").alias("n"), F.try_divide(both.cast("double"), F.count("*")).alias("accuracy"), F.try_divide(both.cast("double"), F.count_if("f")).alias("precision"))


def largest_summed(parts: DataFrame, value: str, row_id: str = "id") -> DataFrame:
    """rows, total: of several values a row, the largest counts; their sum over all rows."""
    return parts.groupBy(row_id).agg(F.max(value).alias("v")).agg(F.count("v").alias("rows"), F.sum("v").alias("total"))
