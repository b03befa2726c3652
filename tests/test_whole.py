"""Queries over whole tables: that no row is left out, and by brute force."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import TABLES

from claimworks.operators import calibration, graph, joins
from claimworks.plans import binding
from claimworks.plans import queries as core


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def test_candidates(spark, sf_dir, duck):
    """A claim without candidates meets each document."""
    n = duck.execute("select count(*) from documents").fetchone()[0]
    met = core.QUERIES["candidate_join"](spark, sf_dir).groupBy("claim_id").count().collect()
    assert {r.claim_id for r in met if r["count"] == n} == {str(i) for (i,) in duck.execute("select item_id from benchmark where item_id % 4 = 0").fetchall()}


@pytest.mark.parametrize("name, source", [("numeric_cells", "orders"), ("summary_projection", "events"), ("context_graph", "orders")])
def test_every_row(spark, sf_dir, duck, name, source):
    got = core.QUERIES[name](spark, sf_dir).toPandas()
    n = duck.execute(f"select count(*) from {source}").fetchone()[0]
    assert n == (got["triples"].sum() if name == "context_graph" else len(got))


def test_every_repeat(spark, sf_dir):
    assert core.QUERIES["bootstrap_ci"](spark, sf_dir).first()["repeats"] == 1000
    assert core.QUERIES["bootstrap_exact"](spark, sf_dir).first()["repeats"] == 1000


def test_every_candidate(spark, sf_dir, monkeypatch):
    tried, choose = [], calibration.one_standard_error
    monkeypatch.setattr(calibration, "out_of_fold", lambda rows, features, c, folds, *, logits=False: tried.append((logits, c, folds)) or rows.withColumn("score", F.lit(0.5 + c / 100)))
    monkeypatch.setattr(calibration, "one_standard_error", lambda df: df)
    got = core.QUERIES["one_se_choice"](spark, sf_dir)
    want = [(logits, c) for logits in (False, True) for c in (0.01, 0.1, 1.0, 10.0)]
    assert tried == [(*x, 5) for x in want] and sorted((r.logits, r.c) for r in got.collect()) == want
    tie = spark.createDataFrame([(0.1, 0.8, 0.01, True), (0.1, 0.8, 0.01, False)], "c double, mean double, se double, logits boolean")
    assert not choose(tie).first()["logits"]


def test_fits_read_no_texts(spark, sf_dir, monkeypatch):
    """What the fits read is short rows of a file: no text, nothing held in memory, weights as they come without each fold."""
    given = []
    monkeypatch.setattr(calibration, "out_of_fold", lambda rows, *a, **b: given.append(rows) or rows.withColumn("score", F.lit(0.5)))
    core.QUERIES["one_se_choice"](spark, sf_dir)
    rows = given[0]
    assert all(x is rows for x in given) and {"fold", "label"} <= set(rows.columns) and not {"doc", "claim", "id"} & set(rows.columns)
    assert not rows.storageLevel.useMemory and rows.inputFiles()
    for f in range(5):
        want = calibration.with_weights(rows.where(F.col("fold") != f)).select("fold", "dataset", "label", "support", F.round("weight", 12)).collect()
        got = rows.where(F.col("fold") != f).select("fold", "dataset", "label", "support", F.round(F.col("fold_weights")[f], 12)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_long_path(spark):
    """One part, however late the least label arrives; a node tied to itself alone is a part."""
    path = [*range(60), *range(119, 59, -1)]
    triples = spark.createDataFrame([*zip(path, path[1:]), (500, 500), (600, 601), (601, 600)], "a long, b long")
    labels = graph.parts(triples)
    assert {r.node: r.part for r in labels.collect()} == {n: 0 for n in path} | {500: 500, 600: 600, 601: 600}
    assert {r.part: (r.triples, r.nodes) for r in graph.shapes(triples, labels).collect()} == {0: (119, 120), 500: (1, 1), 600: (2, 2)}


def test_choice_at_threshold(spark, sf_dir, duck):
    """Rows right at 0.8 are there, and automatic."""
    got = core.QUERIES["choice_verdict"](spark, sf_dir).toPandas().set_index("id")["route"]
    assert len(got) == duck.execute("select count(*) from documents join labels using (doc_id)").fetchone()[0]
    at = duck.execute(f"with {binding.scored_sql()} select id from scored where h_complete in (20, 80)").df()["id"]
    assert len(at) and set(got[at]) == {"auto"}


def test_quotes(spark):
    """Quotes of any number of words, also within words, against each text by itself."""
    texts = ["a bb ccc dddd e f g", "xa bb ccc dddd ex", "bb", "", "ccc dddd e f g h i bb ccc dddd e f g h", None]
    quotes = ["a bb ccc dddd e", "bb ccc", "b", "ccc dddd e f g h", "ccc dddd e f", "zz a bb ccc dddd e f", "f g h i bb ccc dddd e", None, "c dddd e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    asked = spark.createDataFrame(list(enumerate(quotes)), "item_id long, q string")
    for some in (asked, asked.where("length(q) > 7"), asked.limit(0)):
        ids = {r.item_id for r in some.collect()}
        want = sorted((i, d) for i, q in enumerate(quotes) for d, t in enumerate(texts) if i in ids and q is not None and t is not None and q in t)
        assert sorted((r.item_id, r.doc_id) for r in joins.containing(docs, some).collect()) == want
