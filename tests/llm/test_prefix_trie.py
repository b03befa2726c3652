import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from claimworks.llm import prefix_trie as p


def brute(rows):
    """Every node by its turns, with the contract's columns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            label = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0), role, label, text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + v[h:])
    at = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            at[v[:d]].append(c)
    children = defaultdict(list)
    for k in at:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in sorted(at, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] += (len(at[k]) - 1) * words
        leaves[k] += not children[k]
        if k:
            saved[k[:-1]] += saved[k]
            leaves[k[:-1]] += leaves[k]
    ends = {k: hashlib.sha256(",".join(map(str, sorted(c for c in v if built[c] == k))).encode()).hexdigest() for k, v in at.items()}
    return sorted(((min(v), len(k), min(at[k[:-1]]) if k else None, len(v), len(children[k]), leaves[k], saved[k], ends[k]) for k, v in at.items()), key=str)


def got(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, hi long").repartition(parts)
    return sorted((tuple(r) for r in p.nodes(df).collect()), key=str)


ODD = [
    (0, 0, "user", "a b"), (0, 1, None, None), (0, 2, "user", "c"), (0, 3, "user", "d e f"), (1, 1, "user", "a b"), (1, None, "user", "q"), (1, None, "user", "q"), (2, 0, "", ""), (2, 0, "user", "x"),
    (2, 0, "bot", "x"), (3, 5, "user", "a b"), (5, 0, "user", "a b"), (19, 9, None, "z"), (27, 0, "user", "nohost"), (27, 1, "user", "y y"), (33, 0, "user", "nohost"), (-3, 0, "user", "a b"), (-20, 1, "u", "neg"), (-23, 1, "u", "neg"),
    (None, 0, "user", "lost"), (40, 0, "r", "x" * 50000 + " y"), (41, 0, "r", "x" * 50000 + " y"), (41, 1, "s", ""), (2**63 - 1, 0, "r", "far"),
]


def test_odd_rows(spark):
    """Null and empty values, repeated and equal turns, absent hosts, negative and very large ids, other columns of the same names."""
    assert got(spark, ODD) == brute(ODD)
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "a", "b")]) == []
    assert got(spark, [(7, 1, "a", "b")]) == brute([(7, 1, "a", "b")])


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed, monkeypatch):
    """Long conversations that span ranges, copies, deep shared prefixes; small bands and pieces, so that all ways are taken."""
    monkeypatch.setattr(p, "BAND", 64)  # four levels a band
    monkeypatch.setattr(p, "PIECE", 20)
    monkeypatch.setattr(p, "IDS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = random.Random(seed)
        rows = []
        for c in range(60):
            kind = r.random()
            line = [("user", "same thing")] * 30 if kind < 0.35 else [("user", r.choice("ab")) for _ in range(r.randrange(12))]
            if c in (17, 44):
                line = [("user", str(i % 5)) for i in range(300)]
            rows += [(c, i, *x) for i, x in enumerate(line)]
        r.shuffle(rows)
        assert got(spark, rows, 4) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_louds():
    """The bits of a small forest by hand, parents read off them, sums from the deepest level up."""
    # 0 -> 1, 2; 1 -> 3; 4 alone. Rows are out of order; names are their numbers.
    name = np.array([3, 0, 4, 2, 1], np.int64)
    up = np.array([1, 99, 98, 0, 0], np.int64)
    depth = np.array([7, 5, 9, 6, 6], np.int64)
    trie = p.Louds.build(name, name, up, up, depth)
    assert name[trie.rows].tolist() == [0, 4, 1, 2, 3] and trie.starts.tolist() == [0, 2, 4, 5]
    assert "".join(map(str, np.unpackbits(trie.bits, count=11))) == "110" + "110" + "0" + "10" + "0" + "0"
    assert trie.parents().tolist() == [-1, -1, 0, 0, 2]
    (total,) = trie.rolled(np.array([1, 10, 100, 1000, 10000]))
    assert dict(zip(name.tolist(), total.tolist())) == {0: 11011, 4: 100, 1: 10001, 2: 1000, 3: 1}
    n, above = trie.degrees()
    assert dict(zip(name.tolist(), n.tolist())) == {0: 2, 4: 0, 1: 1, 2: 0, 3: 0} and above.tolist() == [4, -1, -1, 1, 1]
