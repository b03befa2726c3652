"""A corpus from raw documents: quality, near copies, benchmark passages, secrets, token ids.

Each stage takes all that the one before kept, and its decisions take effect: rejected documents go, one document of each
class of near copies stays (the least doc_id), contaminated documents go, secrets are masked in the texts, and the last stage
gives the token ids of what is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimworks.llm import _tables, bpe_codec, decontamination, jaccard_join, quality, secret_scan
from claimworks.llm._lineage import cut, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is a half or more stay, as they are.

    Null and empty texts have a score like any other; repeated rows stay or go together; rows without an id are scored but teach
    nothing; without labelled rows every score is a half, so all stay; an empty table stays empty; further columns go.
    """
    model = quality.fit(docs, _tables.read(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.scored(docs.select(*COLUMNS), model).where("score >= 0.5").select(*COLUMNS)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: the one with the least doc_id, null last; of several with that id, the one with the least text.

    An id that one row has tells the row. Rows that share an id or have none are told apart by their columns, and rows that are the
    same in all of them are one. Null, empty and wordless texts are copies of the same text only; an empty table stays empty.
    """
    rows = docs.select(*COLUMNS)
    classes = cut(jaccard_join.set_classes(rows).select("doc_id", "name", "root", "class_id"))
    first = F.col("doc_id").eqNullSafe(F.col("class_id"))
    kept = classes.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(first).alias("first")).where("first")
    single = F.col("doc_id").isNotNull() & (F.col("n") == 1)
    plain = rows.join(kept.where(single).select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(*COLUMNS)
    odd = cut(kept.where(~single).select(F.col("doc_id").alias("id")))
    if odd.isEmpty():  # else all texts would be dealt out to find that none is asked for
        return plain
    shared = rows.join(odd, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").withColumn("key", F.sha2(F.to_json(F.struct(*COLUMNS)), 256))
    names = jaccard_join.sketches(shared.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "name").distinct()
    own = classes.where(first).select(F.col("doc_id").alias("id"), "name", "root").distinct()
    found = shared.join(names, "key").join(own, "name").where(F.col("doc_id").eqNullSafe(F.col("id")))
    least = found.groupBy("root").agg(F.min(F.struct("text", *[c for c in COLUMNS if c != "text"])).alias("x"))
    return plain.unionByName(least.select(*[f"x.{c}" for c in COLUMNS]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which a twentieth of the words or more is the benchmark's go; others stay as they are.

    Null and empty texts have no words and stay; every row is judged by itself, so repeated rows and ids stay or go alike; an
    empty table or benchmark takes nothing away.
    """
    found = decontamination.overlaps(docs.select(*COLUMNS), _tables.read(spark, sf_dir, "benchmark", "item_id", "text"), keep=COLUMNS)
    return found.where(~decontamination.contaminated()).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets in their texts are masked, and n_chars is that of the masked text.

    Null texts become empty ones; every row is masked by itself; an empty table stays empty.
    """
    found = secret_scan.scan(docs, secret_scan.train(secret_scan.samples(spark)), keep=("lang", "source"))
    return found.select("doc_id", secret_scan.masked("text", "spans").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of every row; null and empty texts have no ids, repeated rows have a row each."""
    return bpe_codec.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("byte-level BPE encoding", tokens_stage),
]

#: The quality model and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = _tables.read(spark, sf_dir, "documents", *COLUMNS)
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
