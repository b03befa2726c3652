"""Leaderboards: the best and second-best of each column, Markdown in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimworks.functions.text import number, percent, unmarked


def places(table: DataFrame, name: str, columns: list[str], best: int = 2) -> DataFrame:
    """name, metric, value, place: for each column, the rows with its largest distinct values; equal values share a place."""
    long = table.unpivot([name], columns, "metric", "value").where("value is not null")
    return long.withColumn("place", F.dense_rank().over(Window.partitionBy("metric").orderBy(F.col("value").desc()))).where(F.col("place") <= best)


def marked(table: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """The table with its cells as text, the best of each column bold and the second-best underlined; old marks go."""
    numbers = table.select(name, *[number(unmarked(F.col(c).cast("string"))).alias(c) for c in columns])
    top = places(numbers, name, columns).groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct("metric", "place"))).alias("_p"))
    cells = []
    for c in columns:
        text, place = unmarked(F.col(c).cast("string")), F.element_at("_p", F.lit(c))
        cells.append(F.when(place == 1, F.concat(F.lit("**"), text, F.lit("**"))).when(place == 2, F.concat(F.lit("<u>"), text, F.lit("</u>"))).otherwise(text).alias(c))
    return table.join(top, name, "left").select(name, *cells)


def read_markdown(spark: SparkSession, text: str) -> DataFrame:
    """A pipe table, as columns of text."""
    rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in text.strip().splitlines() if line.strip().startswith("|")]
    head, body = rows[0], [r for r in rows[1:] if not all(set(c) <= set(":- ") and c for c in r)]
    return spark.createDataFrame([tuple(r) for r in body], ", ".join(f"`{h}` string" for h in head))


def markdown(table: DataFrame, order: list[str]) -> str:
    """A small result as a pipe table."""
    rows = table.orderBy(*order).collect()
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"


def row(metrics: DataFrame, names: dict[str, str]) -> DataFrame:
    """scope, column, cell: a metrics table's balanced accuracies as percentages under their display names."""
    from claimworks.functions.text import renamed

    return metrics.select("scope", renamed(F.col("scope"), names).alias("column"), percent(F.col("balanced_accuracy")).alias("cell"))
