import hashlib
import random
from collections import Counter

import numpy as np

from claimworks.llm import relative_lz as z


def brute(docs, window):
    lists = [(i, (t or "").encode().split()) for i, t in docs]
    seen = Counter(tuple(w[k : k + window]) for _, w in lists for k in range(len(w) - window + 1))
    out = []
    for i, w in lists:
        gone = {p for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for p in range(k, k + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return out


def rows():
    r = random.Random(3)
    words = lambda n: " ".join(r.choice(["a", "be", "é", "thé", "tion", "on.", "x\0y"]) for _ in range(n))
    base, line, long = words(150), words(34), words(600)
    docs = [(i, base) for i in range(15)] + [(20 + i, base[: 30 * i] + " new " + base[30 * i :]) for i in range(12)]
    docs += [(40 + i, words(20) + "\n" + line + "\t" + words(20)) for i in range(12)]
    docs += [(60, "a " * 300), (61, "a b " * 60), (62, words(34)), (63, None), (64, ""), (64, "  \n "), (65, long + " " + long), (66, long[300:].replace(" ", "\r\n")), (None, long[100:900])]
    return docs + [(70, "q" * 70000 + " " + base), (71, "q" * 70000 + " " + base[:200])]


def test_against_brute_force(spark):
    docs = rows()
    df = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, block int").repartition(5)
    assert sorted(map(tuple, z.remove_passages(df).collect()), key=str) == sorted(brute(docs, 35), key=str)
    assert sorted(map(tuple, z.remove_passages(df, window=9, gram=3).collect()), key=str) == sorted(brute(docs, 9), key=str)
    assert sorted(map(tuple, z.remove_passages(df, hot=1).collect()), key=str) == sorted(brute(docs, 35), key=str)
    assert sorted(map(tuple, z.remove_passages(df, window=9, gram=3, hot=1).collect()), key=str) == sorted(brute(docs, 9), key=str)
    assert z.remove_passages(df.limit(0)).count() == 0


def test_factors():
    """Greedy factors by brute force; without them no window is found."""
    r, window = random.Random(9), 5
    for _ in range(60):
        passages = [[r.choice("ab") if r.random() < 0.9 else "c" for _ in range(r.randrange(window, 30))] for _ in range(r.randrange(1, 7))]
        counts = np.array([len(p) - window + 1 for p in passages])
        begins = np.cumsum(counts) - counts
        starts = np.arange(counts.sum()) + np.repeat(np.arange(len(counts)) * (window - 1), counts)
        words = np.array([ord(w) for p in passages for w in p])
        heads, sizes = z.parse(z.Index(words, counts + window - 1, starts), begins, counts)
        rest = [p[k:] for p in passages for k in range(len(p) - window + 1)]

        def longest(i):
            return max([next((n for n, (x, y) in enumerate(zip(rest[i], o)) if x != y), min(len(rest[i]), len(o))) for j, o in enumerate(rest) if j != i], default=0)

        want = []
        for b, n in zip(begins.tolist(), counts.tolist()):
            at = b
            while at < b + n:
                want.append((at, max(1, longest(at))))
                at += want[-1][1]
        assert sorted(zip(heads.tolist(), sizes.tolist())) == want
        found = z.duplicates([" ".join(p).encode() for p in passages], counts, window)
        assert found.tolist() == [longest(i) >= window for i in range(len(rest))]


def test_windows_come_from_factors(monkeypatch):
    passage = b"a b c d e f g"
    assert z.duplicates([passage, passage], np.array([3, 3]), 5).all()
    monkeypatch.setattr(z, "parse", lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert not z.duplicates([passage, passage], np.array([3, 3]), 5).any()
