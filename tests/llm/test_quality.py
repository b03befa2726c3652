import math
import random
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from claimworks.llm import quality as q


def test_scores_against_plain_formula():
    r = np.random.default_rng(2)
    x = [r.normal(c, 1 + c, (200, 4)) for c in range(2)]
    m = q.Model(np.array([200.0, 200.0]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), np.zeros(4), 1.0, 0.2, 0.1)
    both = sum(np.cov(a.T, bias=True) for a in x) / 2
    logs = []
    for a in x:
        s = 0.8 * np.cov(a.T, bias=True) + 0.2 * both
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + np.eye(4) * (1e-6 + 1e-3 * np.diag(both))
        d = x[0] - a.mean(0)
        logs.append(-0.5 * (d @ np.linalg.inv(s) * d).sum(1) - 0.5 * np.log(np.linalg.det(s)))
    assert np.allclose(m.margins(x[0]), logs[1] - logs[0])


def plain(text):
    """The statistics, character by character and word by word."""
    b, n = text.encode(), len(text.encode())
    if not n:
        return [0.0] * 36
    words, lines = b.split(), [x for x in b.split(b"\n") if x.strip()]
    kind = {k: sum(f(c) for c in b) for k, f in dict(upper=lambda c: 65 <= c <= 90, lower=lambda c: 97 <= c <= 122, digit=lambda c: 48 <= c <= 57, space=lambda c: c in b"\t\n\x0b\x0c\r ", mark=lambda c: 32 < c < 127 and not chr(c).isalnum(), high=lambda c: c > 127).items()}
    w, sizes = len(words), [len(x) for x in words] or [0]
    mean = sum(sizes) / len(sizes)
    share = [b.count(c) / n for c in set(b)]
    count = [
        math.log(1 + n), math.log(1 + w), sum(sizes), math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes)) * w, kind["upper"], kind["mark"], kind["digit"], kind["space"], kind["high"],
        len(set(words)), max([words.count(x) for x in words], default=0), len(lines) - len(set(lines)), -sum(p * math.log2(p) for p in share) * n,
        sum(x == y and 32 < x < 127 and not chr(x).isalnum() for x, y in zip(b, b[1:])), sum(len(x) <= 3 for x in words), sum(c in b".!?" for c in b), b.count(10), len(zlib.compress(b, 1)),
    ]
    return count + [0, 0, w, w, kind["upper"] + kind["lower"] + kind["high"], n, n, n, n, w, w, len(lines), n, n, w, w, w, n]


def texts():
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["The", "of", "thing", "médecin", "table.", "and", "over", "9"]) for _ in range(r.randrange(1, 90))) + "\n" * r.randrange(2)
    bad = lambda: "".join(r.choice("#$%!! aZ7\n") for _ in range(r.randrange(1, 300)))
    return [(i, good() if i % 2 else bad(), i % 2) for i in range(240)] + [(400, "", 0), (401, " \n ", 1)]


def test_statistics_by_hand():
    for _, text, _ in texts():
        assert np.allclose(q.statistics(text.encode()), plain(text)), text


def test_fit_by_hand(spark):
    """Usual rates, folds, moments and the choice from the grid, from all training rows in one matrix; held-out rows don't matter."""
    rows = texts()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    grid = ((3.0, 0.1, 0.0), (12.0, 0.6, 0.2), (48.0, 0.02, 0.05))
    got = q.fit(docs, labels, grid=grid)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    x, y = np.array([plain(t) for _, t, _ in train]), np.array([c for *_, c in train])
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.expr(f"pmod(xxhash64(doc_id), {q.FOLDS})").alias("f")).collect()}
    fold = np.array([fold[i] for i, *_ in train])
    usual = x[:, :18].sum(0) / np.maximum(x[:, 18:].sum(0), 1)

    def model(rows, w, common, diagonal):
        z = q.transformed(x[rows], usual, w)
        own = [z[y[rows] == c] for c in range(2)]
        return q.Model(np.array([float(len(a)) for a in own]), np.array([a.sum(0) for a in own]), np.array([a.T @ a for a in own]), usual, w, common, diagonal)

    loss = []
    for g in grid:
        odds = np.zeros(len(y))
        for f in range(q.FOLDS):
            odds[fold == f] = model(fold != f, *g).margins(q.transformed(x[fold == f], usual, g[0]))
        loss.append(np.log1p(np.exp(np.where(y == 1, -odds, odds))).sum())
    best = grid[int(np.argmin(loss))]
    assert np.allclose(got.usual, usual) and (got.weight, got.common, got.diagonal) == best
    assert np.allclose(got.scores(x), model(np.ones(len(y), bool), *best).scores(x))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(q.fit(docs, turned, grid=grid).scores(x), got.scores(x))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = q.op3_quality(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got.index)
    labels = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").df().set_index("doc_id").quality
    test = labels[[i for i in labels.index if got.held_out[i]]]
    assert (got.predicted[test.index] == test).mean() > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (None, "a b c", 0.2), (3, "x" * 100000, 0.3), (3, "x", 0.3)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (3, 5), (None, 1)], "doc_id long, quality int")
    model = q.fit(docs, labels)
    got = q.scored(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert q.scored(docs.limit(0), model).count() == 0
    assert q.fit(docs.limit(0), labels.limit(0)).scores(np.zeros((1, 2 * q.FEATURES)))[0] == 0.5
