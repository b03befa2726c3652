import uuid
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from claimworks.llm import kd_shards as k
from claimworks.llm._lineage import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(points, dimensions, shards, first=0):
    """Shard of each point (size, keys ..., ties ...) by sorting: the tree's own rules, without its search."""
    if shards == 1 or not points:
        return {p: first for p in points}
    few = shards // 2
    spread = [max(p[1 + i] for p in points) - min(p[1 + i] for p in points) for i in range(dimensions)]
    d = spread.index(max(spread))
    order = sorted(points, key=lambda p: (p[1 + d], *p[1 + dimensions :]))
    want, total, at = sum(p[0] for p in points) * few / shards, 0, 0
    while total + order[at][0] < want:
        total += order[at][0]
        at += 1
    at += not order[at][0] - (want - total) > want - total
    return brute(order[:at], dimensions, few, first) | brute(order[at:], dimensions, shards - few, first + few)


def lawful(rows, docs, n):
    """Every document once, its size and checksum, slots without gaps, sizes as equal as whole documents allow."""
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == sorted(((d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in docs), key=str)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append((r.slot, r.doc_id))
        sizes[r.shard] += r.size
    assert set(slots) <= set(range(n))
    for s in slots.values():
        assert [x for x, _ in sorted(s)] == list(range(len(s)))
        assert [d for _, d in sorted(s)] == sorted((d for _, d in s), key=lambda d: (d is not None, d or 0))
    return [sizes[i] for i in range(n)]


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")]).repartition(3)
    keyed, names = k._keyed(docs, k.Dimensions())
    points = keyed.select("doc_id", *names).collect()
    want = brute([tuple(p[c] for c in (*names, "doc_id")) for p in points], 4, 40)
    got = k.shards(docs, 40).collect()
    assert {r.doc_id: r.shard for r in got} == {p[-1]: s for p, s in want.items()}
    sizes = lawful(got, [tuple(r)[:2] for r in docs.collect()], 40)
    assert max(sizes) - sum(sizes) / 40 <= max(p.size for p in points)


def test_even(spark):
    """A source and a text with a third of the rows each, many small documents: all shards within a hundredth of their target."""
    rows = [(i, "copy of one text" if i % 3 == 0 else f"text {i} " * (i % 40), None if i % 11 == 0 else ["en", "de"][i % 2], "hot" if i % 3 == 1 else f"s{i % 50}", i % 40) for i in range(20000)]
    sizes = lawful(k.shards(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect(), rows, 40)
    assert max(abs(s / (sum(sizes) / 40) - 1) for s in sizes) < 0.01


def test_odd_rows(spark):
    """Equal rows, null and empty values, one very long text, other columns of the operator's names."""
    rows = [(5, "same", "en", "a", 4)] * 400 + [(None, None, None, None, None), (None, "", "", "", -7), (7, "x" * 200000, "en", "a", 200000), (-(2**62), "é", "en", None, 2**62)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], f"{SCHEMA}, size string, by_row int").repartition(5)
    sizes = lawful(k.shards(df, 4).collect(), rows, 4)
    assert sorted(sizes)[-1] >= 200016 and min(sizes) > 0
    equal = lawful(k.shards(spark.createDataFrame(rows[:400], SCHEMA), 4).collect(), rows[:400], 4)
    assert max(equal) - min(equal) <= 2 * 20
    assert k.shards(spark.createDataFrame([], SCHEMA)).count() == 0
    lawful(k.shards(spark.createDataFrame(rows[-2:], SCHEMA)).collect(), rows[-2:], 40)


def test_write(spark):
    rows = [(i, f"t{i}" * (i % 9), "en", f"s{i % 3}", i) for i in range(500)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{SCHEMA}, size int")
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    k.write(df, folder, 5)
    back = spark.read.parquet(folder)
    assert sorted(tuple(r) for r in back.select(*df.columns).collect()) == sorted(tuple(r) for r in df.collect())
    by = {r.shard: r.n for r in back.groupBy("shard").agg(F.sum(F.octet_length("text") + 16).alias("n")).collect()}
    assert sorted(by) == list(range(5)) and max(by.values()) - min(by.values()) <= 2 * (16 + 36)


@pytest.mark.parametrize("n", [1, 3])
def test_any_number(spark, n):
    rows = [(i, "x" * (i % 30), "en", "s", i) for i in range(300)]
    sizes = lawful(k.shards(spark.createDataFrame(rows, SCHEMA), n).collect(), rows, n)
    assert len(sizes) == n and max(sizes) - min(sizes) <= 2 * 46
