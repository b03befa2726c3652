import math
import random

import numpy as np
import pytest

from claimworks.operators import calibration, metrics as m


def frame(spark, rows, scores):
    return spark.createDataFrame([(d, y, float(s)) for (d, y), s in zip(rows, scores)], "dataset string, label int, score double")


def by_scope(df):
    return {r.scope: r for r in df.collect()}


ROWS = [("A", 0), ("A", 1), ("B", 0), ("B", 1), ("B", 1), ("B", 1)]


def test_macro_and_pooled(spark):
    got = by_scope(m.metrics(frame(spark, ROWS, [0.2, 0.8, 0.1, 0.1, 0.1, 0.1]), "score", 0.5))
    assert got["(macro)"].balanced_accuracy == 0.75 and got["(pooled)"].balanced_accuracy == 0.625 and got["(pooled)"].accuracy == 0.5
    assert got["A"].roc_auc == 1.0 and got["B"].roc_auc == 0.5 and got["(pooled)"].n == 6


def test_threshold_is_strict(spark):
    assert by_scope(m.metrics(frame(spark, ROWS[:2], [0.5, 0.5]), "score", 0.5))["(pooled)"].supported_recall == 0.0


def test_one_class_has_no_macro(spark):
    got = by_scope(m.metrics(frame(spark, [("A", 1)], [0.8]), "score", 0.5))
    assert got["(macro)"].balanced_accuracy is None and got["A"].roc_auc is None


@pytest.mark.parametrize("rows, scores", [([("A", 2)], [0.5]), ([("A", 1)], [float("nan")]), ([("A", 1)], [float("inf")])])
def test_unsound_rows_stop(spark, rows, scores):
    with pytest.raises(Exception, match="labels are 0 or 1"):
        m.metrics(frame(spark, rows, scores), "score", 0.5).collect()


@pytest.mark.parametrize(
    "rows, scores, want",
    [(ROWS[:2], [0.2, 0.8], 0.5), (ROWS[:2], [0.7, 0.8], 0.7), ([("A", 1), ("A", 0), ("A", 1), ("A", 0)], [0.5, 0.51, 0.9, 0.1], 0.51)],
)
def test_tuning(spark, rows, scores, want):
    got = m.tuned(frame(spark, rows, scores), "score").collect()
    assert [r.threshold for r in got] == [want]


def test_unsound_sets_stop(spark):
    """Tuning needs rows of both labels in each source, metrics need rows."""
    for rows, scores in (([("A", 1)], [0.8]), ([*ROWS, ("C", 0)], [0.5] * 7), ([], [])):
        with pytest.raises(Exception, match="both labels"):
            m.tuned(frame(spark, rows, scores), "score").collect()
        assert m.tuned(frame(spark, rows, scores), "score", strict=False).collect() == []
    with pytest.raises(Exception, match="need rows"):
        m.metrics(frame(spark, [], []), "score").collect()


def test_draws_in_first_seen_order(spark):
    """The same generator over the same order gives the same intervals as a loop over rows."""
    r = np.random.default_rng(5)
    rows = [(i, f"t{r.integers(12)}", "AB"[i % 2], int(r.integers(2)), float(r.random()), float(r.random())) for i in range(90)]
    df = spark.createDataFrame(rows, "n long, doc string, dataset string, label int, a double, b double").repartition(5)
    got = m.bootstrap_exact(m.clusters(df, "a", "b", 0.5, 0.5, order="n"), 50, seed=3).first()
    groups: dict = {"A": {}, "B": {}}
    for _, doc, d, y, a, b in rows:
        c = groups[d].setdefault(doc, np.zeros(6))
        c += [y, 1 - y, y * (a > 0.5), (1 - y) * (a <= 0.5), y * (b > 0.5), (1 - y) * (b <= 0.5)]
    g, kept = np.random.default_rng(3), []
    for _ in range(50):
        sums = []
        for d in "AB":
            every = np.array(list(groups[d].values()))
            t = every[g.integers(len(every), size=len(every))].sum(0)
            if not t[0] or not t[1]:
                break
            sums.append(((t[2] / t[0] + t[3] / t[1]) / 2, (t[4] / t[0] + t[5] / t[1]) / 2))
        else:
            kept.append(np.mean(sums, axis=0))
    low, high = np.percentile(np.array(kept)[:, 0], [2.5, 97.5])
    assert math.isclose(got.primary_low, low) and math.isclose(got.primary_high, high) and got.valid_repeats == len(kept)


def test_tuned_in_pool(spark):
    r = random.Random(4)
    rows = [("m" if i % 2 else "k", r.choice(["tune", "selection"]), r.choice("AB"), r.randrange(2), r.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "model string, pool string, dataset string, label int, score double")
    got = {(x.model, r): t for x in m.tuned_in_pool(df, "score", ["model"], fixed=30).collect() for r, t in (("fitted", (x.threshold, x.selection_macro)), ("fixed", (0.3, x.fixed_macro)))}
    want = {(x.model, x.rule): (x.threshold, x.macro) for x in calibration.transferred(df.where("pool = 'tune'"), df.where("pool = 'selection'"), "score").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_grid_and_auc_against_numpy(spark):
    r = random.Random(1)
    rows = [(r.choice("ABC"), r.randrange(2)) for _ in range(300)]
    scores = [r.choice([round(r.random(), 2), r.random()]) for _ in rows]
    df = frame(spark, rows, scores)
    best = []
    for step in range(1, 100):
        t, each = np.arange(100)[step] / 100, []
        for d in "ABC":
            own = [(y, s) for (x, y), s in zip(rows, scores) if x == d]
            tpr = np.mean([s > t for y, s in own if y])
            tnr = np.mean([s <= t for y, s in own if not y])
            each.append((tpr + tnr) / 2)
        best.append((round(float(np.mean(each)), 12), -abs(step - 50), step))
    got = m.tuned(df, "score").first()
    assert (got.threshold, got.macro) == (max(best)[2] / 100, max(best)[0])
    got = by_scope(m.metrics(df, "score"))
    for d in "ABC":
        p = [s for (x, y), s in zip(rows, scores) if x == d and y]
        q = [s for (x, y), s in zip(rows, scores) if x == d and not y]
        assert math.isclose(got[d].roc_auc, np.mean([[(a > b) + (a == b) / 2 for b in q] for a in p]))


def test_intervals_of_clusters(spark):
    rows = [("A", 0, "One  document", 0.1, 0.9), ("A", 1, "One\ndocument", 0.9, 0.1)]
    df = spark.createDataFrame(rows, "dataset string, label int, doc string, a double, b double")
    counts = m.clusters(df, "a", "b", 0.5, 0.5)
    assert counts.count() == 1
    exact = m.bootstrap_exact(counts, 20).first()
    assert tuple(exact) == (1, 1, 0, 0, 1, 1, 20, 20)
    hashed = m.bootstrap(counts, 20).first()
    assert tuple(hashed)[:6] == (1, 1, 0, 0, 1, 1) and 5 <= hashed.valid_repeats < 20 and hashed.repeats == 20


def test_transfer(spark):
    r = random.Random(2)
    rows = [("m", d, y, min(1.0, max(0.0, r.gauss(0.65 if y else 0.35, 0.2)))) for d in "AB" for y in (0, 1) for _ in range(60)]
    df = spark.createDataFrame(rows, "model string, dataset string, label int, score double")
    got = {x.rule: x for x in calibration.transferred(df, df, "score").collect()}
    tuned = m.tuned(df, "score").first()
    assert got["fitted"].threshold == tuned.threshold and got["fitted"].macro == tuned.macro
    fixed = by_scope(m.metrics(df, "score", 0.30))["(macro)"].balanced_accuracy
    assert math.isclose(got["fixed"].macro, fixed, abs_tol=1e-9)


def test_logistic_against_newton(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + r.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([("A" if i % 3 else "B", int(b), float(p), float(q)) for i, (b, (p, q)) in enumerate(zip(y, x))], "dataset string, label int, p double, q double")
    weighted = calibration.with_weights(df)
    rows = weighted.toPandas()
    assert math.isclose(rows.weight.mean(), 1.0)
    model = calibration.fit(weighted, ["p", "q"], 0.5)
    a = np.column_stack([rows.p, rows.q, np.ones(len(rows))])
    w, beta, ridge = rows.weight.to_numpy(), np.zeros(3), np.diag([1, 1, 0]) / 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        beta -= np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (w * (p - rows.label)) + ridge @ beta)
    assert np.allclose([*model.weights, model.bias], beta, atol=1e-5)


def test_one_standard_error(spark):
    df = spark.createDataFrame([(0.01, 0.70, 0.02), (0.1, 0.74, 0.02), (1.0, 0.75, 0.02), (0.1, 0.735, 0.01)], "c double, mean double, se double")
    assert tuple(calibration.one_standard_error(df).first())[:2] == (0.1, 0.74)
