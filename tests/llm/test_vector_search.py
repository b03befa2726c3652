import math

import numpy as np

from claimworks.llm import vector_search as v


def brute(rows, k):
    ok = [(i, [float(x) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    out = []
    queries = {}
    for i, e in ok:
        if i % 100 == 0:
            queries[i] = min(e, queries.get(i, e))
    for i, e in queries.items():
        near = []
        for j, f in ok:
            if j != i and len(f) == len(e):
                t = 0.0
                for a, b in zip(e, f):
                    t += (a - b) * (a - b)
                near.append((math.sqrt(t), j))
        out += [(i, n + 1, j, d) for n, (d, j) in enumerate(sorted(near)[:k])]
    return out


def rows():
    r = np.random.default_rng(4)
    out = [(i, [float(x) for x in r.normal(size=6).astype(np.float32)]) for i in range(0, 900)]
    out += [(1000 + i, out[i][1]) for i in range(0, 200, 3)] + [(2000 + i, [1.0, 2.0, float(i)]) for i in range(0, 300, 50)]
    return out + [(3000, None), (3100, []), (3200, [0.0] * 6), (3300, [float("nan")] * 6), (3400, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (3500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (100, [9.0] * 6), (7, [1e-6] * 6)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(v, "QUERY_BLOCK", 4)
    df = spark.createDataFrame([(i, e, 0) for i, e in rows()], "vec_id long, embedding array<float>, rank int").repartition(5)
    data = [(r.vec_id, r.embedding) for r in df.collect()]
    got = v.nearest(df, df.where("vec_id % 100 = 0")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(data, 10))
    few = df.where("vec_id < 5 or vec_id = 100")
    assert sorted(map(tuple, v.nearest(few, few.where("vec_id % 100 = 0")).collect())) == sorted(brute([(r.vec_id, r.embedding) for r in few.collect()], 10))
    assert v.nearest(df.limit(0), df.limit(0)).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(1)
    for dim in (1, 3, 64, 1500):
        x, y = r.normal(size=(30, dim)) * 10, r.normal(size=(40, dim))
        (qa, sa, ea), (qb, sb, eb) = v.quantised(x), v.quantised(y)
        about = np.sqrt(((qa[:, None] * sa[:, None, None] - qb[None] * sb[None, :, None]) ** 2).sum(2))
        true = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
        assert (np.abs(about - true) <= ea[:, None] + eb[None, :] + 1e-9).all()


def in_one_tile(x, k=10):
    ids = np.arange(len(x))
    q = ids[::10]
    a, b, d = v.nearest_in_tile(q, x[q], ids, x, k, np.full(len(q), np.inf))
    best = v._best(a, ids[b], d, k)
    return {(int(q[i]), int(j)): float(s) for i, j, s in zip(a[best], ids[b][best], d[best])}, len(a)


def test_magnitudes():
    """Very large, very small and mixed components: as many neighbours as asked for, and the right ones."""
    r = np.random.default_rng(6)
    for scales in ([1e200], [1e-200], [1.0], [1e307], [1e-310], [1e-200, 1.0, 1e200], [1.0, 1e8]):
        x = r.normal(size=(300, 8)) * r.choice(scales, size=(300, 1))
        got, _ = in_one_tile(x)
        assert len(got) == 300
        for i in range(0, 300, 10):
            far = sorted((math.dist(x[i], x[j]) if np.isfinite(math.dist(x[i], x[j])) else math.inf, j) for j in range(300) if j != i)[:10]
            mine = sorted((d, j) for (q, j), d in got.items() if q == i)
            assert np.allclose([d for d, _ in mine], [d for d, _ in far], rtol=1e-12, atol=0), scales


def test_outlier():
    """One vector a hundred million times as long leaves the pruning of the others as it was."""
    r = np.random.default_rng(7)
    x = r.normal(size=(1000, 64))
    want, pairs = in_one_tile(x)
    longer = np.vstack([x, x[:1] * 1e8])
    got, after = in_one_tile(longer)
    assert {k: d for k, d in got.items() if k[0] != 1000} == want and after - pairs < 0.01 * 100 * 1000 + 1001


def test_many_pairs(monkeypatch):
    monkeypatch.setattr(v, "PAIRS", 7)
    x = np.ones((50, 3))
    got, pairs = in_one_tile(x)
    assert pairs == 5 * 49 and set(got.values()) == {0.0}


def test_driver_holds_no_vectors(spark, monkeypatch):
    """Copies of the queries for each task are no broadcast, however small the table looks to the planner."""
    monkeypatch.setattr(v, "TASK_PAIRS", 100, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.createDataFrame(rows(), "vec_id long, embedding array<float>").repartition(5)
        data = [tuple(r) for r in df.collect()]
        got = v.nearest(df, df.where("vec_id % 100 = 0"))
        assert sorted(map(tuple, got.collect())) == sorted(brute(data, 10))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "Exchange" in plan and "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sets_and_parts(spark, monkeypatch):
    """Several sets of queries and parts of candidates, of floats and of doubles, give what one task gives."""
    monkeypatch.setattr(v, "SET_NUMBERS", 200)
    monkeypatch.setattr(v, "TASK_PAIRS", 1000)
    monkeypatch.setattr(v, "QUERY_BLOCK", 3)
    monkeypatch.setattr(v._tables, "blocks_wanted", lambda spark: 12)
    grids, grid = [], v.grid
    monkeypatch.setattr(v, "grid", lambda *a: grids.append(grid(*a)) or grids[-1])
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows(), f"vec_id long, embedding array<{kind}>").repartition(40)
        data = [tuple(r) for r in df.collect()]
        assert sorted(map(tuple, v.nearest(df, df.where("vec_id % 100 = 0")).collect())) == sorted(brute(data, 10))
    assert all(sets > 1 and parts > 1 for sets, parts in grids)


def test_grid():
    assert v.grid((0, 0), (0, 0), 10, 200) == (1, 1)
    moved = []
    for n in (10**5, 10**6, 10**7):
        sets, parts = v.grid((n // 100, n // 100 * 64), (n, n * 64), 10, 200)
        assert sets * parts <= 2 * 200 and n // 100 * 94 / sets <= v.SET_NUMBERS
        moved.append((n * 64 * sets + n // 100 * 94 * parts) / n)
    assert max(moved) < 4 * 64
