import random
import re

from claimworks.llm import jaccard_join as j


def brute(docs):
    names, sets = [], []
    for _, text in docs:
        b = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode())
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", b)
        s = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([text or ""])
        sets.append(s)
        names.append(s)
    distinct = list(dict.fromkeys(sets))
    up = {s: s for s in distinct}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = dict.fromkeys(distinct, 0)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 5 * len(a & b) >= 4 * len(a | b):
                links[a] += 1
                links[b] += 1
                if root(a) != root(b):
                    up[root(a)] = root(b)
    least = {}
    for (d, _), s in zip(docs, sets):
        if d is not None:
            least[root(s)] = min(d, least.get(root(s), d))
    return [(d, least.get(root(s)), links[s], sets.count(s)) for (d, _), s in zip(docs, sets)]


def rows():
    r = random.Random(8)
    words = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    base = words(160)
    docs = [(1, None), (2, ""), (3, "..."), (4, "a"), (4, "A!"), (5, "a b c"), (6, "a b c d")]
    for i in range(60):
        w = base[:]
        for _ in range(r.randrange(1, 6)):
            w[r.randrange(160)] = f"n{r.randrange(9999)}"
        docs.append((100 + i, " ".join(w)))
    for i in range(30):
        w = words(r.randrange(6, 120))
        docs += [(200 + 3 * i, " ".join(w)), (201 + 3 * i, " ".join(w + words(len(w) // 8))), (202 + 3 * i, " ".join(w).upper())]
    line = words(12)
    docs += [(400 + i, " ".join(words(20) + line + words(10))) for i in range(40)]
    return docs + [(None, docs[-1][1]), (None, "x y z")]


def test_against_brute_force(spark):
    docs = rows()
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in docs], "doc_id long, text string, name string, size int").repartition(4)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    want = sorted(brute(docs), key=key)
    assert sorted(map(tuple, j.similarity_classes(df).collect()), key=key) == want
    assert sorted(map(tuple, j.similarity_classes(df, bucket=6, tile=7).collect()), key=key) == want


def test_empty_table(spark):
    assert j.similarity_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert j.runs_for() == 14


def pairs_at(low, high, n, shared, seed):
    """Pairs of texts whose shingles are alike by low to high; the first words are the same in all of them."""
    r = random.Random(seed)
    head = [f"h{k}" for k in range(shared)]
    out = []
    while len(out) < 2 * n:
        a = head + [f"w{r.randrange(10**9)}" for _ in range(60)]
        b = a[:]
        for _ in range(r.randrange(1, 4)):
            b[r.randrange(shared, len(b))] = f"v{r.randrange(10**9)}"
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        if low <= len(x & y) / len(x | y) <= high:
            out += [(len(out), " ".join(a)), (len(out) + 1, " ".join(b))]
    return out


def test_recall_at_the_threshold(spark):
    """Pairs alike by 0.80 to 0.85: in small buckets, and where 30 of 90 words are in all texts, so that buckets of the shared picks are split."""
    for shared, bucket in ((0, 512), (30, 20)):
        docs = pairs_at(0.80, 0.85, 400, shared, shared)
        got = {r.doc_id: r for r in j.similarity_classes(spark.createDataFrame(docs, "doc_id long, text string"), bucket=bucket).collect()}
        found = sum(got[i].class_id == got[i + 1].class_id for i in range(0, len(docs), 2))
        print(shared, found)
        assert found >= 0.995 * len(docs) / 2


def test_bands_and_tiles(spark):
    """Near copies that grow word by word, so that links cross bands and tiles."""
    docs = [(i, " ".join(f"w{k}" for k in range(8 + i))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = sorted(brute(docs))
    assert sorted(map(tuple, j.similarity_classes(df, bucket=40, tile=10).collect())) == want


def stages(spark, group, run):
    """What it returns, and how many stages ran for it."""
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    ids = {s for k in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(k).stageIds}
    return out, sum(x.numCompletedTasks > 0 for x in map(tracker.getStageInfo, ids) if x)


def test_few_stages_for_large_groups(spark):
    """A group of near copies whose buckets are split at every level: stages of few rows, each with files for every pair of tasks, are the most of the disk on many partitions."""
    r = random.Random(8)
    base = [f"w{r.randrange(10**9)}" for _ in range(60)]
    docs = [(i, " ".join([*base, *[f"v{i * 31 + k}" for k in range(i % 5)]])) for i in range(160)]
    docs += [(1000 + i, " ".join([*base[:12], *[f"u{r.randrange(10**9)}" for _ in range(30)]])) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got, n = stages(spark, "large-groups", lambda: sorted(map(tuple, j.similarity_classes(df, bucket=20, tile=30).collect())))
    print(n, "stages")
    assert got == sorted(brute(docs))
    assert n <= 110
