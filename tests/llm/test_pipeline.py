import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from claimworks.llm import bpe_codec, decontamination, jaccard_join, quality, secret_scan


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs)
    for n, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"file://{folder}/{n}")
        docs = spark.read.parquet(f"file://{folder}/{n}")
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage(spark, sf_dir, stages):
    raw, good, alone, clean, masked, tokens = stages
    assert all(df.columns == list(p.COLUMNS) for df in (good, alone, clean, masked))
    scores = quality.scored(raw, quality.fit(raw, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert ids(good) == ids(scores.where("score >= 0.5"))
    classes = jaccard_join.similarity_classes(good)
    assert ids(alone) == sorted({r.class_id for r in classes.collect()})
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert ids(clean) == ids(decontamination.contamination(alone, bench).where("not contaminated"))
    assert ids(masked) == ids(clean) == ids(tokens)
    zeros = [0.0] * len(secret_scan.ALPHABET) ** 2
    assert secret_scan.scan(masked, zeros).where("size(base) > 0").count() == 0
    for r in masked.join(tokens.withColumnRenamed("doc_id", "d").withColumnRenamed("n_tokens", "n"), F.expr("doc_id = d")).collect():
        assert bpe_codec.codec().decode(r.ids) == r.text.encode() and r.n == len(r.ids) and r.n_chars == len(r.text)


def test_keeps_most_good_documents(sf_dir, stages):
    labels = duckdb.sql(f"select doc_id from '{sf_dir}/labels.parquet' where quality = 1").fetchall()
    kept = set(ids(stages[1]))
    assert sum(i in kept for (i,) in labels) >= 0.95 * len(labels)


def test_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (2, "", "en", "s", 0), (2, "x", "en", "s", 1), (3, "password=abcdef12 " * 3, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    quality_stage, copies, bench, secrets, tokens = (f for _, f in p.STAGES)
    text = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    every = sorted(((r[0], r[1]) for r in rows), key=str)
    kept = text(quality_stage(spark, docs, sf_dir))
    assert all(kept.count(x) == every.count(x) for x in kept)
    assert text(quality_stage(spark, docs.withColumn("doc_id", -F.col("doc_id") - 10), sf_dir)) == sorted(((None if i is None else -i - 10, t) for i, t in every), key=str)  # no labels
    assert text(copies(spark, docs, sf_dir)) == sorted([(1, None), (2, "x"), (3, rows[4][1]), (None, rows[1][1])], key=str)
    assert text(bench(spark, docs, sf_dir)) == every
    masked = secrets(spark, docs, sf_dir).collect()
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in masked), key=str) == sorted([(1, "", 0), (None, "a b c d e f", 11), (2, "", 0), (2, "x", 1), (3, "[secret] " * 3, 27)], key=str)
    assert sorted(((r.doc_id, r.n_tokens > 0) for r in tokens(spark, docs, sf_dir).collect()), key=str) == sorted([(1, False), (None, True), (2, False), (2, True), (3, True)], key=str)
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_one_row_of_each_class(spark, sf_dir):
    """Repeated rows, an id that two classes share, and null ids."""
    a, b, c, d, e = ("".join(f"{w}{i} " for i in range(30)) for w in "abcde")
    rows = [(1, a), (1, a), (2, a), (None, a), (3, b), (5, b), (5, c), (6, c), (7, d + "."), (7, d), (None, e), (None, e), (9, "other words that stand alone here"), (10, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in p.near_copies_stage(spark, docs, sf_dir).collect()]
    want = [(1, a), (3, b), (5, c), (7, min(d, d + ".")), (None, e), (9, rows[-2][1]), (10, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
