"""Digests that say what changed, fits that are bound to their input, audits in one pass, outlines, runs that stop."""

import pytest
from pyspark.sql import functions as F

from claimworks.operators import calibration, checks, digests, outlines
from claimworks.streaming import windows


def test_digests(spark, tmp_path):
    """Order and partitions do not matter; repeated rows, nulls and renamed columns do; changed keys are found."""
    rows = [(f"k{i}", i % 5, None if i % 3 else "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, a int, b string")
    root = digests.store(df.repartition(5), "id", f"file://{tmp_path}/d")
    assert root == digests.root(df.orderBy(F.col("a").desc()), "id") == digests.stored_root(spark, f"file://{tmp_path}/d")
    assert digests.changed(df, "id", f"file://{tmp_path}/d").isEmpty()
    other = spark.createDataFrame([*rows[:10], ("k10", 9, "x"), *rows[12:], ("new", 1, None), rows[20], (None, 1, "y")], "id string, a int, b string")
    assert digests.root(other, "id") != root
    got = {(r.id, r.change) for r in digests.changed(other, "id", f"file://{tmp_path}/d").collect()}
    assert got == {("k10", "changed"), ("k11", "removed"), ("new", "added"), ("k20", "changed"), (None, "added")}
    assert digests.root(df.withColumnRenamed("b", "c"), "id") != root
    levels = digests.tree(digests.row_digests(df, "id"))
    assert {r.level: r.n for r in levels.groupBy("level").agg(F.sum("n").alias("n")).collect()} == {0: 3000, 1: 3000, 2: 3000}
    none = df.limit(0)
    assert digests.store(none, "id", f"file://{tmp_path}/none") == digests.root(none, "id")
    assert digests.changed(df.limit(1), "id", f"file://{tmp_path}/none").first().change == "added"


def test_bound_threshold(spark, tmp_path):
    """A fit is kept with its input's digest: the same rows give it again, others are refused by fit and by apply."""
    dev = spark.createDataFrame([(str(i), "AB"[i % 2], i // 2 % 2, 0.2 + 0.6 * (i // 2 % 2)) for i in range(40)], "id string, dataset string, label int, score double")
    folder = f"file://{tmp_path}/fit"
    t = calibration.fit_threshold(dev, "score", folder)
    assert 0.2 <= t < 0.8 and calibration.fit_threshold(dev.repartition(3), "score", folder) == t
    assert calibration.apply_threshold(dev, dev, folder).where("accepted <> (label = 1)").isEmpty()
    changed = dev.withColumn("score", F.when(F.col("id") == "7", 0.5).otherwise(F.col("score")))
    with pytest.raises(ValueError, match="not what it was"):
        calibration.fit_threshold(changed, "score", folder)
    with pytest.raises(ValueError, match="not what it was"):
        calibration.apply_threshold(changed, dev, folder)
    assert [r.id for r in digests.changed(changed, "id", f"{folder}/input").collect()] == ["7"]
    with pytest.raises(FileNotFoundError):
        calibration.apply_threshold(dev, dev, f"file://{tmp_path}/other")


def test_observed(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "id string, v int")
    got = checks.observed(df, f"file://{tmp_path}/o", all_ids=F.bool_and(F.col("id").isNotNull()), all_values=F.bool_and(F.col("v").isNotNull()), two=F.count("*") == 2)
    assert got == {"all_ids": True, "all_values": False, "two": True} and spark.read.parquet(f"file://{tmp_path}/o").count() == 2
    assert checks.observed(df.limit(0), f"file://{tmp_path}/p", none=F.bool_and(F.col("v") > 0)) == {"none": False}
    both = {r.id: (r.rows_n, r.predictions_n) for r in checks.answered_rows(df, spark.createDataFrame([("b", 1.0), ("b", 2.0), ("c", 0.0)], "id string, s double")).collect()}
    assert both == {"a": (1, None), "b": (1, 2), "c": (None, 1)}


OUTLINE = """Preface
1.  One
text one
1.2.  Early
  a "quoted   line"
1.2.1.  Deep
here
1.10.  Late
a "quoted line" again
Appendix A. Table
not a section
2.  Two
2.1.1.  Skips a level
10.  Ten
3.  Three"""


def test_outline(spark):
    df = spark.createDataFrame([(1, OUTLINE), (2, None), (3, "no header"), (4, "")], "doc_id long, text string")
    found = outlines.sections(df).cache()
    got = {r.number: (r.level, r.parent, r.body) for r in found.where("doc_id = 1").collect()}
    assert {n: v[:2] for n, v in got.items()} == {"1": (1, None), "1.2": (2, "1"), "1.2.1": (3, "1.2"), "1.10": (2, "1"), "2": (1, None), "2.1.1": (3, "2"), "10": (1, None), "3": (1, None)}
    assert got["1.10"][2] == '1.10.  Late\na "quoted line" again' and found.count() == 8
    assert [r.number for r in outlines.in_order(found).orderBy("place").collect()] == ["1", "1.2", "1.2.1", "1.10", "2", "2.1.1", "3", "10"]
    assert [(r.doc_id, r.number) for r in outlines.containing(found, 'a "quoted line"').collect()] == [(1, "1.2")]


def test_missing_answer(spark):
    """A report over all rows stops at a row without an answer; a partial one says that it is not complete."""
    from claimworks.plans import checkers

    rows = spark.createDataFrame([(str(i), "A", i % 2) for i in range(6)], "id string, dataset string, label int")
    cache = rows.where("id <> '3'").select("id", F.lit(0.5).alias("score"))
    checker = checkers.Checker("m", "score")
    assert not checkers.report(rows, cache, checker).first().complete
    with pytest.raises(ValueError, match="no answer for 3"):
        checkers.report(rows, cache, checker, whole=True)
    assert checkers.report(rows.where("id <> '3'"), cache, checker, whole=True).first().complete


def test_packs(spark, tmp_path):
    from claimworks.operators import joins
    from claimworks.sources import scans

    for name, threshold in (("a", 0.3), ("b", 0.6)):
        (tmp_path / f"{name}.json").write_text(f'{{"questions": {{}},\n "decision": {{"score": "s", "threshold": {threshold}}}}}')
    found = scans.packs(spark, f"file://{tmp_path}/*.json")
    assert set(found) == {"a", "b"} and {r.pack: r.threshold for r in joins.packs_by_digest(spark, found).collect()} == {"a": 0.3, "b": 0.6}


def test_run_stops(spark, tmp_path):
    """A scorer that fails from row 50 on stops the run long before row 1,000; what was scored and what failed is kept."""
    pending, place = f"file://{tmp_path}/pending", f"file://{tmp_path}/run"
    spark.range(0, 1000, 1, 2).select(F.col("id").cast("string").alias("id"), F.col("id").alias("n")).write.parquet(pending)
    score = lambda batch: batch.withColumn("error", F.when(F.col("n") >= 50, "down"))
    with pytest.raises(Exception, match="rows failed"):
        windows.score_windows(spark, pending, place, score, 20)
    assert spark.read.parquet(f"{place}/cache").count() == 50 and spark.read.parquet(f"{place}/errors").count() == 30
    windows.score_windows(spark, pending, place, lambda b: b.withColumn("error", F.lit(None).cast("string")), 400)
    got = spark.read.parquet(f"{place}/cache")
    assert got.count() + spark.read.parquet(f"{place}/errors").count() == 1000
