import hashlib
import math
import random
import uuid
import zlib
from collections import defaultdict
from datetime import datetime

import pyarrow.parquet as pq
import pytest

from claimworks.llm import cow_upsert as u
from claimworks.llm._lineage import shared_folder

CLIENT = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
CHANGE = "change_id long, client_id long, seq long, op string, source string, segment string, city string, balance double"
crc = lambda x: zlib.crc32(str(x).encode())


def brute(clients, changes):
    """first id, rows, rewritten of each file, by the contract's words."""
    size = 1 + len(clients) // 1000
    table = sorted((r for r in clients if r[0] is not None and crc(r[0]) % 7 > 3), key=lambda r: r[0])
    starting = [table[i : i + size] for i in range(0, len(table), size)]
    if not starting:
        return []
    home = lambda i: max((k for k, f in enumerate(starting) if f[0][0] <= i), default=0)
    last = {}
    for c in changes:
        if c[1] is not None:
            rank = lambda c: tuple((x is not None, x if x is not None else 0) for x in (c[2], c[0]))
            if c[1] not in last or rank(c) > rank(last[c[1]]):
                last[c[1]] = c
    after = [{r[0]: r for r in f} for f in starting]
    for i, c in last.items():
        k = home(i)
        h = crc(starting[k][0][0]) % 16
        if h > 7:
            continue
        if c[3] == "D" or c[0] is not None and crc(c[0]) % 8 < h:
            after[k].pop(i, None)
        else:
            old = list(after[k].get(i, [i, *[None] * 9]))
            old[2], old[8], old[6], old[9] = c[4:8]
            after[k][i] = tuple(old)
    files = []
    for k, f in enumerate(starting):
        rows = [after[k][i] for i in sorted(after[k])]
        if rows == f:
            files.append([f, False])
            continue
        n = -(-len(rows) // size)
        at = 0
        for j in range(n):
            m = len(rows) // n + (j < len(rows) % n)
            files.append([rows[at : at + m], True])
            at += m
    out = []
    for rows, again in files:
        if out and again and out[-1][1] and len(out[-1][0]) + len(rows) <= size:
            out[-1][0] = out[-1][0] + rows
        else:
            out.append([rows, again])
    return out


def summary(rows, again):
    cents = sum(0 if r[9] is None else math.floor(100 * r[9] + 0.5) for r in rows)
    return (rows[0][0], len(rows), cents, sum(zlib.crc32("|".join(x or "" for x in (r[2], r[8], r[6])).encode()) for r in rows), hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest(), again)


def check(spark, clients, changes):
    folder = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    got = u.applied(spark.createDataFrame(clients, CLIENT).repartition(3), spark.createDataFrame([(*c, 5) for c in changes], f"{CHANGE}, home int").repartition(3), folder).collect()
    want = brute(clients, changes)
    assert sorted((r.first_id, r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in got) == sorted(summary(*f) for f in want)
    # The files on disk are these and no others, sorted, with all columns.
    import glob

    there = glob.glob(f"{folder.removeprefix('file://')}/**/*.parquet", recursive=True)
    assert sorted(there) == sorted(r.path.removeprefix("file://") for r in got)
    for r in got:
        t = pq.ParquetFile(r.path.removeprefix("file://")).read()
        assert ",".join(t.column_names) == r.columns
        rows = next(rows for rows, _ in want if rows[0][0] == r.first_id)
        assert [tuple(x.values()) for x in t.to_pylist()] == rows
    return want


def client(r, i):
    return (i, i % 7, r.choice(["web", "crm", None]), datetime(2024, 1, 1 + i % 28) if i % 5 else None, f"n{i}", None, r.choice(["Köln", "", None]), i % 25, r.choice(["a", "b"]), r.choice([None, 0.005, -1.234, 99.995, i / 3]))


def change(r, c, i):
    return (c, i, r.choice([0, 1, 2, 5, None]), r.choice("IUUUD"), r.choice(["web", "crm", None]), r.choice(["a", "b", None]), r.choice(["Köln", "", None]), r.choice([None, 0.005, 7.0]))


@pytest.mark.parametrize("seed, n, m", [(1, 2100, 300), (2, 1100, 3000)])
def test_against_brute_force(spark, seed, n, m):
    """Few and many changes, inserts between and beyond all ids, one id with a third of the changes, repeated changes, null keys."""
    r = random.Random(seed)
    clients = [client(r, i * 2) for i in range(n)] + [(None, *client(r, 1)[1:]), client(r, -5)]
    changes = [change(r, c, r.choice([r.randrange(-50, 2 * n + 300), 8, r.randrange(2 * n)])) for c in range(m)]
    changes += [change(r, 10**6 + c, 3 * n + c) for c in range(100 * (seed == 2))]  # many to the last home
    changes += changes[:50] + [(m + 7, None, 1, "U", "a", "b", "c", 1.0), (None, 4, 9, None, None, None, None, None)]
    want = check(spark, clients, changes)
    assert {again for _, again in want} == {True, False} or m > 2000


def test_same_again(spark):
    """Changes that set what is there rewrite nothing; deletes of absent ids neither."""
    r = random.Random(5)
    clients = [client(r, i) for i in range(1500)]
    changes = [(10**9 + i, c[0], 1, "U", c[2], c[8], c[6], c[9]) for i, c in enumerate(clients) if crc(c[0]) % 7 > 3] + [(i, 10**7 + i, 1, "D", "x", "y", "z", 1.0) for i in range(50)]
    changes = [c for c in changes if crc(c[0]) % 8 == 7 or c[3] == "D"]
    assert not any(again for _, again in check(spark, clients, changes))


def test_odd_tables(spark):
    check(spark, [], [])
    check(spark, [], [change(random.Random(1), 1, 1)])
    check(spark, [client(random.Random(1), i) for i in range(40)], [])
    check(spark, [(None, *client(random.Random(1), 1)[1:])], [change(random.Random(1), 1, 1)])


def test_shared_keys(spark):
    """Of rows with one key the largest stays."""
    folder = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, "c"), (None, "d")], "k long, v string")
    u.start(df, folder, "k", 1)
    assert sorted((r.k, r.v, r[u.FILE]) for r in u.read(spark, folder, df.schema).collect()) == [(1, "b", 0), (2, "c", 1)]


def test_cuts():
    assert u._cuts([(0, 3, True), (1, 2, True), (2, 5, False), (3, 4, True), (4, 0, True), (5, 1, True), (6, 13, True), (7, 1, True)], 5) == [(0, 3, 0, 0), (1, 2, 0, 0), (3, 4, 0, 1), (5, 1, 0, 1), (6, 4, 1, 2), (7, 1, 0, 4)]
