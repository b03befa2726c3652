import random

from claimworks.llm import _components as c


def test_against_union_find(spark):
    """Paths, stars, a clique and edges at random, each way round and some twice."""
    r = random.Random(3)
    pairs = [(k, k + 1) for k in range(200, 260)] + [(k, k + 1) for k in range(400, 340, -1) if k != 370] + [(500, k) for k in range(450, 550)]
    pairs += [(i, j) for i in range(600, 612) for j in range(600, 612)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(220)]
    pairs = [p if r.random() < 0.5 else p[::-1] for p in pairs + pairs[:40]]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    want = sorted((x, root(x)) for x in up)
    assert sorted(map(tuple, c.components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect())) == want
    assert c.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_stars_need_no_round(spark, monkeypatch):
    """Groups whose members all know the least one are as they should be: the edges and the least neighbours are all that is written."""
    written = []
    monkeypatch.setattr(c, "cut", lambda df, cut=c.cut: written.append(cut(df)) or written[-1])
    found = c.components(spark.createDataFrame([(s, s + k) for s in (0, 100) for k in range(1, 60)], "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(s + k, s) for s in (0, 100) for k in range(60)]
    assert len(written) == 2
