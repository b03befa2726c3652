import re

from pyspark.sql import functions as F

from claimworks.operators import chunking as c
from claimworks.operators import graph, joins, leaderboard
from claimworks.operators.metrics import metrics


def greedy(text, limit):
    out, words = [], 0
    for s in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", (text or "").strip()))):
        n = len(s.split())
        if out and words + n <= limit:
            out[-1], words = out[-1] + " " + s, words + n
        else:
            out.append(s)
            words = n
    return out


def test_packing(spark):
    texts = ["", None, "One.", "a b c. d e! f g h i j k l? m. n o p. q", "x " * 30 + ". y."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for limit in (1, 4, 7, 100):
        got = [r.p for r in df.select("i", c.packed(F.col("t"), limit).alias("p")).orderBy("i").collect()]
        assert got == [greedy(t, limit) for t in texts]


def test_chunk_maximum(spark):
    docs = [(f"test:{i}", d, t, y) for i, (d, t, y) in enumerate((d, t, y) for d in ("Wice", "Reveal") for t, y in (("no|yes", 1), ("no|no", 0), ("yes", 1), ("no", 0)))]
    df = spark.createDataFrame(docs, "id string, dataset string, doc string, label int").withColumn("claim", F.lit("c"))
    parts = c.exploded(df, F.split("doc", "[|]")).select("id", "claim", "chunk_index", "chunk")
    model = lambda: lambda chunks, claims: [0.9 if "yes" in x else 0.1 for x in chunks]
    got = c.folded(c.scored_by(parts, model, 2))
    found = {r.id: r for r in got.collect()}
    assert found["test:0"].score == 0.9 and found["test:0"].best_chunk == 1 and found["test:1"].score == 0.1 and found["test:1"].best_chunk == 0
    joined = df.join(got, "id")
    assert {r.scope: r.balanced_accuracy for r in metrics(joined, "score").collect()}["(macro)"] == 1.0


def test_no_chunks(spark):
    df = spark.createDataFrame([("1", "")], "id string, doc string").withColumn("claim", F.lit("c"))
    parts = c.exploded(df, c.packed(F.col("doc"), 5)).select("id", "claim", "chunk_index", "chunk")
    assert tuple(c.folded(c.scored_by(parts, c.hash_model)).first()) == ("1", 0.0, 0, None)


def test_graph(spark):
    triples = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("c", "d"), ("b", "e")], "a string, b string")
    labels = graph.parts(triples)
    assert {r.node: r.part for r in labels.collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "x": "x", "y": "x"}
    assert {tuple(r) for r in graph.shapes(triples, labels).select("part", "triples", "nodes", "branched").collect()} == {("a", 4, 5, True), ("x", 1, 2, False)}


def test_marked_table(spark):
    board = leaderboard.read_markdown(spark, "| model | x | y |\n|---|---|---|\n| a | **1.5** | 2 |\n| b | 1.5 | 3 |\n| c | 0.5 | <u>1,000</u> |\n| d | n/a | 0 |\n")
    got = {r.model: (r.x, r.y) for r in leaderboard.marked(board, "model", ["x", "y"]).collect()}
    assert got == {"a": ("**1.5**", "2"), "b": ("**1.5**", "<u>3</u>"), "c": ("<u>0.5</u>", "**1,000**"), "d": ("n/a", "0")}


def test_best_anywhere(spark):
    """Equal chunks are scored once, for their first place; the rest as brute force, claims in several parts, on ties and nulls."""
    chunks = [("b", 0, "x"), ("a", 3, "x"), ("a", 4, "y"), ("c", 0, None), (None, 0, "z"), *[(f"d{i}", 0, "x") for i in range(200)], *[(f"é{i}", i, f"t{i % 40}") for i in range(90)]]
    df = spark.createDataFrame(chunks, "file string, chunk_index int, chunk string").repartition(3)
    claims = [str(i) for i in range(30)] + [None, "7"]
    seen = spark.sparkContext.accumulator(0)

    def make():
        model = c.hash_grid()

        def run(texts, asked):
            seen.add(len(texts) * len(asked))
            return model(texts, asked)

        return run

    asked = spark.createDataFrame([(x,) for x in claims], "claim_id string")
    got = {r.claim_id: (r.file, r.chunk_index, r.support) for r in joins.best_anywhere(asked, df, make, part=7, batch=64).collect()}
    assert seen.value == 42 * 31
    one, sound = c.hash_grid(), [x for x in chunks if x[0] is not None and x[2] is not None]
    for claim in set(claims) - {None}:
        value = lambda x: float(one([x[2]], [claim])[0, 0])  # noqa: B023, E731
        b = min(sound, key=lambda x: (-value(x), x[0], x[1]))
        assert got[claim] == (b[0], b[1], value(b))
    assert got[None] == ("a", 3, None) and len(got) == 31
    assert joins.best_anywhere(asked, df.limit(0), make).count() == 0 and joins.best_anywhere(asked.limit(0), df, make).count() == 0
