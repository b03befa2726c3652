import hashlib
import re

from claimworks.llm import decontamination as d


def brute(docs, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
    out = []
    for doc_id, text in docs:
        w, hit, seen = words(text), set(), set()
        for item, t in items:
            if item is None or t is None:
                continue
            x = words(t)
            n = min(13, len(x))
            for i in range(len(x) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == x[i : i + n]:
                        hit.update(range(j, j + n))
                        seen.add(str(item))
        digest = hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(seen), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def rows():
    long = " ".join(f"w{i % 29}" for i in range(60))
    items = [(1, "Alpha beta-gamma"), (10, long), (2, "x"), (3, None), (None, "y"), (4, "..."), (5, " ".join(f"w{i}" for i in range(13)))]
    docs = [
        (1, None), (2, ""), (3, "ALPHA, beta gamma alpha beta gamma"), (4, "a " * 300 + long), (5, "b " * 3000 + long[:60]),
        (6, " ".join(f"w{i}" for i in range(12))), (6, "x X é"), (7, long + "é"), (8, "z" * 70000 + " x " + "q" * 140000),
    ]
    return docs, items


def test_against_brute_force(spark):
    docs, items = rows()
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, n_words int, items string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"index_bytes": 200}):
        assert sorted(map(tuple, d.contamination(df, bench, **options).collect())) == sorted(brute(docs, items))


def test_empty_tables(spark):
    docs, items = rows()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert d.contamination(df.limit(0), bench).count() == 0
    assert {r.n_hit for r in d.contamination(df, bench.limit(0)).collect()} == {0}
