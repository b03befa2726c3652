"""Labelled claims over the driver's tables, with stand-in answers.

A row is a document with a quality label and a benchmark text as its claim. Answers come from a hash of question and row, two
decimals each, higher or lower by the label so that scores tell the classes apart; one answer in sixteen to the rule's
questions is mistaken and goes the other way, so that each kind of error occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimworks.functions.scores import Pack, once, with_scores

#: Whether label 1 raises the question's answer.
QUESTIONS = {"support": True, "unsupported": False, "contradicted": False, "direct": True, "complete": True, "detail": True}
#: Questions whose answers are mistaken one time in sixteen.
MISTAKEN = ("support", "unsupported", "contradicted")

PACK = Pack.load(
    {
        "questions": {
            "support": {"type": "noul", "instructions": "Does the document support the claim?"},
            "unsupported": {"type": "noul", "instructions": "Is a part of the claim without support?"},
            "contradicted": {"type": "noul", "instructions": "Does the document contradict the claim?"},
            "direct": {"type": "noul", "instructions": "Is the claim true by the document?"},
            "complete": {"type": "choice", "instructions": "How complete is the support?", "criteria": {"yes": "all", "no": "none"}},
            "detail": {"type": "score", "instructions": "How many details agree?", "criteria": ["none", "few", "most", "all"]},
        },
        "extractions": {
            "support": {"answer_key": "support", "field": "noul"},
            "no_unsupported": {"answer_key": "unsupported", "field": "noul", "invert": True},
            "no_contradicted": {"answer_key": "contradicted", "field": "noul", "invert": True},
            "direct": {"answer_key": "direct", "field": "noul"},
            "complete": {"answer_key": "complete", "field": "probabilities", "option": "yes"},
            "detail": {"answer_key": "detail", "field": "score", "divisor": 3},
        },
        "combinations": {
            "min_rule": {"operation": "min", "inputs": ["support", "no_unsupported", "no_contradicted"]},
            "mean_rule": {"operation": "mean", "inputs": ["support", "no_unsupported", "no_contradicted"]},
            "product_rule": {"operation": "product", "inputs": ["support", "no_unsupported", "no_contradicted"]},
        },
        "selection": {"diagnostic_only": ["complete"]},
    }
)
SCORES = [*PACK.extractions, *PACK.combinations]
RULE, THRESHOLD = "min_rule", 0.30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str, dataset: str = "lang") -> DataFrame:
    """id, doc_id, doc, claim, dataset, label."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("claim"))
    n = bench.count()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("doc"), F.col(dataset).alias("dataset"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    joined = docs.join(labels, "doc_id").withColumn("item_id", F.col("doc_id") % F.lit(n)).join(bench, "item_id")
    return joined.select(F.concat(F.lit("dev:"), F.col("doc_id").cast("string")).alias("id"), "doc_id", "doc", "claim", "dataset", "label")


def hundredths(question: str, raised: bool) -> Column:
    """A whole number from 0 to 100 for the row's answer."""
    digest = F.sha2(F.concat(F.lit(question + ":"), F.col("doc_id").cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 101
    part = F.floor(h * 60 / 100)
    mistaken = (F.substring(digest, 9, 1) == "0") & F.lit(question in MISTAKEN)
    return F.when((F.col("label") == (1 if raised else 0)) != mistaken, part + 40).otherwise(part)


def answers() -> Column:
    """A map of answers by question, as a service would send them."""
    kind = "struct<type:string,noul:double,score:double,probabilities:map<string,double>>"
    entries = []
    for name, raised in QUESTIONS.items():
        p = hundredths(name, raised) / F.lit(100.0)
        what = PACK.questions[name]["type"]
        none = F.lit(None).cast("double")
        parts = F.struct(
            F.lit(what), p if what == "noul" else none, p * 3 if what == "score" else none,
            F.create_map(F.lit("yes"), p, F.lit("no"), 1 - p) if what == "choice" else F.lit(None).cast("map<string,double>"),
        )
        entries += [F.lit(name), parts.cast(kind)]
    return F.create_map(*entries)


def answered(spark: SparkSession, sf_dir: str, dataset: str = "lang") -> DataFrame:
    """rows() with a column answers."""
    return once(rows(spark, sf_dir, dataset), answers=answers())


def scored(spark: SparkSession, sf_dir: str, dataset: str = "lang", *, exact: bool = False) -> DataFrame:
    """rows() with a column for each score of the pack."""
    return with_scores(answered(spark, sf_dir, dataset), PACK, exact=exact).drop("answers")


def _answer_sql(question: str, raised: bool) -> str:
    h = f"(CAST(('0x' || substr(sha256('{question}:' || doc_id), 1, 8)) AS BIGINT) % 101) * 60 // 100"
    return f"CASE WHEN (label = {1 if raised else 0}) <> ({str(question in MISTAKEN).lower()} AND substr(sha256('{question}:' || doc_id), 9, 1) = '0') THEN {h} + 40 ELSE {h} END"


def rows_sql(dataset: str = "lang") -> str:
    return f"""rows AS (SELECT 'dev:' || d.doc_id AS id, d.doc_id, d.text AS doc, b.text AS claim, d.{dataset} AS dataset, CAST(l.quality AS INTEGER) AS label
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""


def scored_sql(dataset: str = "lang") -> str:
    """Common table expressions rows, given (answers in hundredths), scored (doubles) for the DuckDB texts."""
    given = ", ".join(f"{_answer_sql(q, r)} AS h_{q}" for q, r in QUESTIONS.items())
    return f"""{rows_sql(dataset)},
given AS (SELECT *, {given} FROM rows),
base AS (SELECT *, CAST(h_support AS DOUBLE) / 100 AS support, 1 - CAST(h_unsupported AS DOUBLE) / 100 AS no_unsupported, 1 - CAST(h_contradicted AS DOUBLE) / 100 AS no_contradicted,
  CAST(h_direct AS DOUBLE) / 100 AS direct, CAST(h_complete AS DOUBLE) / 100 AS complete, CAST(h_detail AS DOUBLE) / 100 * 3 / 3 AS detail FROM given),
scored AS (SELECT *, least(support, no_unsupported, no_contradicted) AS min_rule, (support + no_unsupported + no_contradicted) / 3 AS mean_rule, support * no_unsupported * no_contradicted AS product_rule FROM base)"""
