from pyspark.sql import functions as F

from claimworks.operators import checks, joins, sampling


def pool_rows(spark):
    return spark.createDataFrame([(f"dev:{i}", f"S{i % 3}", f"document {i % 60}\n text", f"claim {i}", i % 2) for i in range(600)], "id string, dataset string, doc string, claim string, label int")


def test_pools(spark):
    rows = sampling.with_pool(pool_rows(spark))
    top = sampling.stratified(rows, ["pool", "dataset", "label"], 20)
    first, again = sorted(r.id for r in top.collect()), sorted(r.id for r in sampling.stratified(rows.repartition(7), ["pool", "dataset", "label"], 20).collect())
    assert first == again and checks.shared(rows, "group", "pool").isEmpty()
    assert max(r["count"] for r in top.groupBy("pool", "dataset", "label").count().collect()) <= 20
    assert {r.pool for r in rows.select("pool").distinct().collect()} == {"tune", "selection"}


def test_interleaving(spark):
    rows = pool_rows(spark)
    got = [r.id for r in sampling.interleaved(rows, ["dataset", "label"], ["id"], 12).join(rows.select("id"), "id").orderBy("position").collect()]
    strata = [(int(i.split(":")[1]) % 3, int(i.split(":")[1]) % 2) for i in got]
    assert len(got) == 12 and len(set(strata[:6])) == 6 and strata[:6] == strata[6:]
    longer = [r.id for r in sampling.interleaved(rows, ["dataset", "label"], ["id"], 30).orderBy("position").collect()]
    assert longer[:12] == got


def test_subset_and_rest(spark):
    rows = pool_rows(spark)
    few = sampling.hash_subset(rows, 50)
    assert few.count() == 50 and sampling.hash_subset(rows, 0).count() == 600
    assert sum(r.n for r in sampling.remaining(rows, few, ["dataset", "label"]).collect()) == 550


def test_folds(spark):
    rows = sampling.with_pool(pool_rows(spark))
    folds = sampling.group_folds(rows, "group", 5).collect()
    weight = [sum(r.n for r in folds if r.fold == f) for f in range(5)]
    assert sum(weight) == 600 and max(weight) - min(weight) <= 10 and len({r.group for r in folds}) == len(folds)


def test_joins_and_checks(spark):
    a = spark.createDataFrame([("1", 0.1), ("2", 0.2)], "id string, score double")
    b = spark.createDataFrame([("2", 0.9), ("3", None)], "id string, score double")
    assert sorted(map(tuple, joins.overlay(a, b).collect())) == [("1", 0.1), ("2", 0.9), ("3", None)]
    assert sorted(map(tuple, checks.uncovered(a, b).collect())) == [("1", "missing"), ("3", "unexpected")]
    scores = lambda df: df.select("id", F.create_map(F.lit("s"), "score").alias("scores"))
    assert joins.merged_scores(scores(a), scores(a)).count() == 2
    try:
        joins.merged_scores(scores(a), scores(b.where("score > 0"))).collect()
    except Exception as e:
        assert "two values of s for 2" in str(e)
    else:
        raise AssertionError
    assert [tuple(r) for r in checks.several(a, "id").collect()] == [(["1", "2"],)]


def test_candidates(spark):
    docs = spark.createDataFrame([("a.txt", "x"), ("b.txt", "y")], "file string, text string")
    claims = spark.createDataFrame([("1", "c", ["b.txt", "none", "b.txt"]), ("2", "d", None), ("3", "e", []), ("4", "f", ["none"])], "claim_id string, claim string, candidate_documents array<string>")
    got = sorted((r.claim_id, r.file) for r in joins.candidates(claims, docs).collect())
    assert got == [("1", "b.txt"), ("2", "a.txt"), ("2", "b.txt"), ("3", "a.txt"), ("3", "b.txt")]
    s = spark.createDataFrame([("1", "b", 0, 0.5), ("1", "a", 2, 0.9), ("1", "a", 1, 0.9), ("1", "c", 0, 0.9)], "claim_id string, file string, chunk_index int, support double")
    assert tuple(joins.best_document(s).first()) == ("1", "a", 1, 0.9)
    tree = joins.nested(s).first().document_scores
    assert [d.file for d in tree] == ["a", "b", "c"] and [c.chunk_index for c in tree[0].chunks] == [1, 2]
