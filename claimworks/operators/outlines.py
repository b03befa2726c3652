"""Sections of texts by their header lines, as an outline, in the natural order of their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A numbered header (its number is the first group), or an appendix's, which only ends the section before it.
HEADER = r"^(?:([0-9]+(?:\.[0-9]+)*)\.  .+|Appendix [A-Z]\..*)$"
DEPTH = 6


def natural(number: Column) -> Column:
    """A key that sorts 4.2 before 4.10: the parts of a number as numbers."""
    return F.transform(F.split(number, r"\."), lambda p: p.cast("decimal(38,0)"))


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", header: str = HEADER) -> DataFrame:
    """key, line, number, level, parent, body of every numbered section; key tells documents apart.

    A section is its header and the lines up to the next header; parent is the number of the nearest header above that is of a
    higher level, null if there is none. Text before the first header and after an appendix's belongs to none.
    """
    lines = docs.where(F.col(text).isNotNull()).select(key, F.split(text, "\n").alias("_l"))
    marks = F.filter(F.transform("_l", lambda x, i: F.struct(i.alias("line"), x.alias("x"))), lambda m: m["x"].rlike(header))
    heads = lines.withColumn("_m", F.transform(marks, lambda m: F.struct(m["line"].alias("line"), F.regexp_extract(m["x"], header, 1).alias("number"))))
    spans = F.transform("_m", lambda m, i: F.struct(m["line"].alias("line"), m["number"].alias("number"), F.array_join(F.slice("_l", m["line"] + 1, F.coalesce(F.get("_m", i + 1)["line"], F.size("_l")) - m["line"]), "\n").alias("body")))
    found = heads.select(key, F.explode(spans).alias("_s")).select(key, "_s.line", "_s.number", "_s.body").where("number <> ''")
    found = found.withColumn("level", F.size(F.split("number", r"\.")))
    above = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == n, F.struct("line", "number")), ignorenulls=True).over(above) for n in range(1, DEPTH)]
    nearest = F.array_max(F.filter(F.array(*[F.when(F.col("level") > n + 1, x) for n, x in enumerate(last)]), lambda x: x.isNotNull()))
    return found.select(key, "line", "number", "level", nearest["number"].alias("parent"), F.trim(F.col("body")).alias("body"))


def in_order(found: DataFrame, key: str = "doc_id", name: str = "place") -> DataFrame:
    """sections() with their place, from 1, by the natural order of their numbers."""
    return found.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(natural(F.col("number")), "line")))


def containing(found: DataFrame, quote: str, key: str = "doc_id") -> DataFrame:
    """key, number: of each document the first section, by natural order, whose text has the quote; white space is one space."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    hits = found.where(F.contains(flat(F.col("body")), flat(F.lit(quote))))
    return hits.groupBy(key).agg(F.min_by("number", F.struct(natural(F.col("number")), "line")).alias("number"))
