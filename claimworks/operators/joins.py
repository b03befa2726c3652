"""Joins of rows with predictions, caches, candidates and chunks."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimworks.operators.lineage import kept


def pending(rows: DataFrame, cache: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(cache.select(key), key, "left_anti")


def scored(rows: DataFrame, cache: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(cache.select(key), key, "left_semi")


def progress(rows: DataFrame, cache: DataFrame, key: str = "id") -> DataFrame:
    """completed, total, complete: how many of the rows the cache has; repeated answers count once."""
    joined = rows.join(cache.select(key).distinct().withColumn("_done", F.lit(1)), key, "left")
    return joined.agg(F.count("_done").alias("completed"), F.count("*").alias("total")).withColumn("complete", F.col("completed") == F.col("total"))


def overlay(base: DataFrame, newer: DataFrame, key: str = "id") -> DataFrame:
    """All keys of both; the newer row where both have one."""
    columns = [c for c in base.columns if c != key]
    n = newer.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(n, key, "full_outer")
    return joined.select(key, *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's last row."""
    columns = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("x")).select(key, *[F.col(f"x.{c}") for c in columns])


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys by where they first occur."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def merged_scores(*caches: DataFrame) -> DataFrame:
    """id, scores: score maps of several caches as one map; two values for one score stop the query."""
    union = caches[0].select("id", "scores")
    for c in caches[1:]:
        union = union.unionByName(c.select("id", "scores"))
    long = union.select("id", F.explode("scores").alias("name", "value"))
    single = long.groupBy("id", "name").agg(F.min("value").alias("value"), F.max("value").alias("top"))
    value = F.when(F.col("value") == F.col("top"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("two values of "), "name", F.lit(" for "), "id")).cast("double"))
    return single.select("id", "name", value.alias("value")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("scores"))


def per_question(rows: DataFrame, questions: list[str]) -> DataFrame:
    return rows.withColumn("question", F.explode(F.array(*[F.lit(q) for q in questions])))


def named(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """The claims that name candidates, each with those that there are."""
    return claims.where(F.size("candidate_documents") > 0).withColumn("file", F.explode(F.array_distinct("candidate_documents"))).join(documents, "file")


def free(claims: DataFrame) -> DataFrame:
    """The claims that name no candidates."""
    return claims.where(F.col("candidate_documents").isNull() | (F.size("candidate_documents") == 0))


def candidates(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Each claim with its candidate documents; names that no document has are ignored.

    A claim without candidates is matched with every document. Documents carry their number of the block they are dealt to,
    and claims are spread over the blocks, so no side is sent whole to anyone and no plan has a Cartesian product.
    """
    blocks = max(1, int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = named(claims, documents)
    dealt = documents.withColumn("_block", F.pmod(F.xxhash64("file"), F.lit(blocks)))
    every = free(claims).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(dealt, "_block").drop("_block")
    return own.unionByName(every.select(*own.columns))


def containing(documents: DataFrame, quotes: DataFrame, words: int = 4, few: int = 1 << 18) -> DataFrame:
    """item_id, doc_id: the documents (doc_id, t) that contain a quote (item_id, q), both with white space as one space.

    The words within a quote, all but its first and last, are whole words of any text that contains it. Each quote is keyed by
    the rarest run of so many of them, by how many documents have it, or by its rarest word if it has fewer. One pass over
    the documents finds the runs that any quote has; those that meet a quote's key are compared, text by text. Up to so few such
    pairs are sent to all tasks, more are joined by a shuffle. Quotes of one or two words have no key and meet every document.
    """
    split = F.split("q", " ")
    inner = F.slice(split, 2, F.greatest(F.size(split) - 2, F.lit(0)))
    keyed = quotes.where("q is not null").withColumn("w", inner).withColumn("k", F.when(F.size("w") >= words, words).when(F.size("w") > 0, 1).otherwise(0))
    lengths = [r.k for r in keyed.select("k").distinct().collect()]  # three at most

    def runs(w, k: int):
        # The words are bound to a name of their own, or they would be split again for each run.
        every = lambda v: F.when(F.size(v) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(v) - k + 1), lambda i: F.xxhash64(F.slice(v, i, k)))))
        return F.get(F.transform(F.array(w), every), F.lit(0))

    short = keyed.where("k = 0").select("item_id", "q", F.lit(None).cast("array<string>").alias("candidate_documents"))
    met = [candidates(short, documents.withColumnRenamed("doc_id", "file")).where(F.contains("t", F.col("q"))).select("item_id", F.col("file").alias("doc_id"))] if 0 in lengths else []
    for k in sorted(set(lengths) - {0}):
        grams = keyed.where(F.col("k") == k).select("item_id", F.explode(runs("w", k)).alias("g"))
        hits = kept(documents.select("doc_id", F.explode(runs(F.split("t", " "), k)).alias("g")).join(grams.select("g").distinct(), "g", "left_semi"))
        often = hits.groupBy("g").agg(F.count("*").alias("n"))
        keys = grams.join(often, "g", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("x")).where("x.n > 0").select("item_id", "x.g")
        pairs = kept(hits.join(keys, "g").select("doc_id", "item_id"))
        if pairs.count() <= few:
            pairs = F.broadcast(pairs)
        met.append(documents.join(pairs, "doc_id").join(keyed.select("item_id", "q"), "item_id").where(F.contains("t", F.col("q"))).select("item_id", "doc_id"))
    none = documents.limit(0).select(F.lit(None).cast(quotes.schema["item_id"].dataType).alias("item_id"), "doc_id")
    return reduce(DataFrame.unionByName, met, none)


def best_anywhere(claims: DataFrame, chunks: DataFrame, make: Callable[[], Callable[[list[str], list[str | None]], np.ndarray]], part: int = 1024, batch: int = 1 << 16) -> DataFrame:
    """claim_id, file, chunk_index, support: each claim's best chunk among all (file, chunk_index, chunk), as best_document() orders them.

    A support is a matter of chunk and claim alone, so equal chunks are scored once, for the first place that has them. The
    function that make() returns gives the supports of chunks (rows) and claims (columns), without a value where there is none.
    Claims travel in parts, and a task keeps one row for each claim, so neither pairs nor their scores are ever rows.
    """
    blocks = max(1, int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = chunks.where("chunk is not null and file is not null").groupBy("chunk").agg(F.min(F.struct("file", "chunk_index")).alias("x"))
    dealt = first.select("chunk", "x.file", "x.chunk_index", F.pmod(F.xxhash64("chunk"), F.lit(blocks)).alias("_block"))
    ids = claims.select(F.col("claim_id").cast("string").alias("c")).distinct()
    parts = F.lit(math.ceil(ids.count() / part) or 1)
    asked = ids.groupBy(F.pmod(F.xxhash64("c"), parts).alias("_part")).agg(F.to_json(F.collect_list(F.struct("c"))).alias("_asked"))
    spread = asked.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(batches):
        model, known, best = make(), {}, {}
        for b in batches:
            at, files, places, texts = b.column(0).to_numpy(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()
            for p in np.unique(at).tolist():
                rows = np.flatnonzero(at == p).tolist()
                if p not in known:
                    known[p] = [x.get("c") for x in json.loads(b.column(1)[rows[0]].as_py())]
                rows.sort(key=lambda i: (files[i], places[i]))
                step = max(1, batch // len(known[p]))
                for k in range(0, len(rows), step):
                    some = rows[k : k + step]
                    grid = model([texts[i] for i in some], known[p])
                    below = np.where(np.isnan(grid), np.inf, -grid)
                    for j, r in enumerate(below.argmin(0).tolist()):
                        found = (float(below[r, j]), files[some[r]], places[some[r]])
                        if (p, j) not in best or found < best[p, j]:
                            best[p, j] = found
        if best:
            support = [None if below == math.inf else 0.0 - below for below, _, _ in best.values()]
            columns = [[known[p][j] for p, j in best], [f for _, f, _ in best.values()], [i for _, _, i in best.values()], support]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.float64()))], names=["claim_id", "file", "chunk_index", "support"])

    met = dealt.join(spread, "_block").select("_part", "_asked", "file", "chunk_index", "chunk")
    return best_document(met.mapInArrow(run, "claim_id string, file string, chunk_index int, support double"))


def best_document(scores: DataFrame) -> DataFrame:
    """claim_id, file, chunk_index, support: the best chunk of the best document, earlier files and chunks first among equals."""
    # The least of (no support, support downwards, file, chunk): an aggregate, so chunks are combined before they are moved.
    first = F.min(F.struct(F.col("support").isNull().alias("none"), (0.0 - F.col("support")).alias("below"), "file", "chunk_index")).alias("x")
    return scores.groupBy("claim_id").agg(first).select("claim_id", "x.file", "x.chunk_index", (0.0 - F.col("x.below")).alias("support"))


def nested(scores: DataFrame) -> DataFrame:
    """claim_id, document_scores: documents by file, each with its chunks in order."""
    chunks = scores.groupBy("claim_id", "file").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "support"))).alias("chunks"), F.max("support").alias("support_prob"))
    return chunks.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("file", "support_prob", "chunks"))).alias("document_scores"))


def zipped(sample: DataFrame, notes: DataFrame, index: str = "review_index") -> DataFrame:
    """Each sampled row with the note of its number; a number that only one side has stops the query."""
    joined = sample.withColumn("_s", F.lit(1)).join(notes.withColumn("_n", F.lit(1)).withColumnRenamed("index", index), index, "full_outer")
    sound = F.when(F.col("_s").isNotNull() & F.col("_n").isNotNull(), F.col(index)).otherwise(F.raise_error(F.concat(F.lit("no pair for number "), F.col(index).cast("string"))).cast("int"))
    return joined.withColumn(index, sound).drop("_s", "_n")


def packs_by_digest(spark, packs: dict[str, dict]) -> DataFrame:
    """pack_hash, pack, threshold: question packs under the digest that predictions carry."""
    from claimworks.functions.hashing import configuration_digest

    rows = [(configuration_digest(p), n, float(p.get("decision", {}).get("threshold", 0.5))) for n, p in packs.items()]
    return spark.createDataFrame(rows, "pack_hash string, pack string, threshold double")
