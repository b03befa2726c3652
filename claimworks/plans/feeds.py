"""Registered queries that write tables as sources give them and read them back: streams, caches, windows of rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from claimworks.plans.binding import rows, rows_sql, table
from claimworks.plans.queries import _folder, query


@query("SELECT doc_id, length(text) AS n, source, lang FROM documents")
def arrow_stream(spark, sf_dir):
    """Documents as Arrow streams, by byte ranges."""
    from claimworks.sources import arrow_streams

    folder = _folder(spark)
    arrow_streams.register(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang").write.format("arrow_stream").mode("append").save(folder)
    return spark.read.format("arrow_stream").load(folder).select("doc_id", F.length("text").cast("long").alias("n"), "source", "lang")


@query("SELECT 'doc:' || doc_id AS id, CAST(doc_id * 7 % 101 AS DOUBLE) / 100 AS score, n_chars AS n_chunks FROM documents")
def headered_cache(spark, sf_dir):
    """A cache of one file: its identity, then two records of each document, of which the later counts."""
    from claimworks.sources import scans, schemas

    folder, identity = _folder(spark), {"model": "stand-in", "threshold": 0.3}
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    record = lambda score, n: F.to_json(F.struct(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), score.alias("score"), n.alias("n_chunks")))
    turns = [(1, record(F.lit(0.5), F.lit(0))), (2, record(F.col("doc_id") * 7 % 101 / F.lit(100.0), F.col("n_chars")))]
    both = [docs.select(F.lit(turn).alias("turn"), F.hash("doc_id").alias("place"), line.alias("value")) for turn, line in turns]
    head = spark.createDataFrame([(0, 0, json.dumps({"identity": identity}))], "turn int, place int, value string")
    # The format is one file; its one writer streams sorted lines.
    head.unionByName(both[0]).unionByName(both[1]).repartition(1).sortWithinPartitions("turn", "place").select("value").write.text(folder)
    return scans.cache(spark, scans.only_file(spark, folder, "part-*"), identity, schemas.CHUNK_CACHE)


_WINDOWS = 8


@query(f"""WITH {rows_sql()}, n AS (SELECT id, label, row_number() OVER (ORDER BY id) - 1 AS i, 1 + count(*) OVER () // {_WINDOWS} AS size FROM rows)
SELECT CAST(i // size AS INTEGER) AS "window", count(*) AS n, min(id) AS first_id, max(id) AS last_id, CAST(sum(label) AS BIGINT) AS positive FROM n GROUP BY i // size""")
def row_windows(spark, sf_dir):
    """Rows by id, an eighth in each window."""
    from claimworks.streaming import windows

    folder = _folder(spark)
    rows(spark, sf_dir).select("id", "label", (F.col("doc_id") % 101 / F.lit(100.0)).alias("score")).orderBy("id").write.parquet(f"{folder}/pending")
    n = spark.read.parquet(f"{folder}/pending").count()
    windows.score_windows(spark, f"{folder}/pending", folder, lambda batch: batch, 1 + n // _WINDOWS)
    cached = spark.read.parquet(f"{folder}/cache")
    return cached.groupBy("window").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("label").cast("long").alias("positive"))




@query("""WITH a AS (SELECT event_id, event_type AS requested, event_type || '-1.' || (user_id % 3) AS model FROM events), f AS (SELECT requested, arg_min(model, event_id % 2 * 1000000000 + event_id) AS resolved FROM a GROUP BY requested)
SELECT event_id, requested, model, 'another model than before' AS refused FROM a JOIN f USING (requested) WHERE model <> resolved""")
def pinned_answers(spark, sf_dir):
    """Answers of two batches that are not of the model that their name first resolved to."""
    from claimworks.streaming import pinning

    folder = _folder(spark)
    answers = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("requested"), F.concat("event_type", F.lit("-1."), (F.col("user_id") % 3).cast("string")).alias("model"))
    for batch in (0, 1):
        first = pinning.first_answers(answers.where(F.col("event_id") % 2 == batch), "event_id")
        first.coalesce(1).write.mode("append").parquet(f"{folder}/answers")  # a row for each name and model
        resolved = pinning.pin(spark, spark.readStream.schema(first.schema).parquet(f"{folder}/answers"), folder, "event_id")
    return pinning.refused(answers, resolved).where("refused is not null").select("event_id", "requested", "model", "refused")


@query("SELECT CAST(item_id AS VARCHAR) AS claim_id, CASE WHEN item_id % 3 = 0 THEN 'Supported' ELSE 'Refuted' END AS verdict, length(text) AS n FROM benchmark")
def published_claims(spark, sf_dir):
    """A file for each claim, published together, read back."""
    from claimworks.sources import committed

    folder = _folder(spark)
    results = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("claim_id"), F.when(F.col("item_id") % 3 == 0, "Supported").otherwise("Refuted").alias("verdict"), F.length("text").cast("long").alias("n"))
    committed.publish(results, folder, {"threshold": 0.3})
    return committed.published(spark, folder).select("claim_id", "verdict", F.get_json_object("value", "$.n").cast("long").alias("n"))
