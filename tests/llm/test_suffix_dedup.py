import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from claimworks.llm import suffix_dedup as s


def brute(docs, length):
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            gone[i : i + length] |= w in seen
            seen.add(w)
        gone[-1] = False
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.append(False, gone[:-1]).astype(int)) == 1).sum()) if len(b) else 0
        out.append((doc_id, len(b), len(b) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


def rows():
    r = random.Random(5)
    word = lambda n: "".join(r.choice(["the", "é", " ", "tion", "on", ".\n", "\0"]) for _ in range(n))
    base, line, long = word(200), word(30), word(900)
    docs = [(i, base) for i in range(20)] + [(20 + i, base[: 40 * i] + word(3) + base[40 * i :]) for i in range(9)]
    docs += [(40 + i, word(20) + line + word(20)) for i in range(12)] + [(60, "ab" * 400), (61, "a" * 900), (62, "a" * 99), (63, "a" * 100)]
    docs += [(70, long + long), (71, long[77:] + word(9)), (72, None), (73, ""), (None, long[5:300]), (74, line), (74, line * 9), (74, line * 9), (75, "\0" * 150), (76, "\0" * 300)]
    return docs


def test_against_brute_force(spark, monkeypatch):
    docs = rows()
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in docs], "doc_id long, text string, n_bytes int, block string").repartition(5)
    got = sorted(map(tuple, s.remove_repeats(df).collect()), key=str)
    assert got == sorted(brute(docs, 100), key=str)
    got = sorted(map(tuple, s.remove_repeats(df, length=40, gram=16, hot=1).collect()), key=str)
    assert got == sorted(brute(docs, 40), key=str)
    assert sorted(map(tuple, s.remove_repeats(df, hot=1).collect()), key=str) == sorted(brute(docs, 100), key=str)
    assert s.remove_repeats(df.limit(0)).count() == 0


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(s, "PIECE", 300)
    r = np.random.default_rng(1)
    data = r.integers(0, 3, 5000).astype(np.uint8)
    whole = s.anchors(data, np.array([0, 0, 5000, 5000]))
    monkeypatch.setattr(s, "PIECE", 1 << 20)
    once = s.anchors(data, np.array([0, 0, 5000, 5000]))
    windows = lambda a: sorted((int(p), int(x)) for x, lo, hi in zip(*a[:3]) for p in range(lo, hi + 1))
    assert windows(whole) == windows(once)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=20).map(str.encode), max_size=8), min_size=1, max_size=7))
def test_merge(runs):
    wide, made = 24, []
    for run in runs:
        strings = sorted(x.ljust(wide, b"\0") for x in run)
        shared = [0] + [next((i for i in range(wide) if a[i] != b[i]), wide) for a, b in zip(strings, strings[1:])]
        made.append((shared[: len(strings)], strings))
    order, common = s.merge(made, wide)
    every = [x for _, strings in made for x in strings]
    assert [every[i] for i in order] == sorted(every) and sorted(order) == list(range(len(every)))
    for (a, b), c in zip(zip(order, order[1:]), common[1:]):
        assert c == next((i for i in range(wide) if every[a][i] != every[b][i]), wide)
