"""Streams by byte ranges, caches by lines, windows of rows."""

import glob
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimworks.sources import arrow_streams, scans, schemas
from claimworks.streaming import windows


def test_ranges(spark, tmp_path):
    """Ranges cover the stream's batches once, in order; dictionaries and null and nested columns come back."""
    t = pa.table({"i": list(range(1000)), "s": [None if i % 7 == 0 else "ü" * (i % 50) for i in range(1000)], "l": [[i, None] for i in range(1000)], "d": pa.array([f"k{i % 3}" for i in range(1000)]).dictionary_encode()})
    path = str(tmp_path / "t.arrow")
    with pa.OSFile(path, "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
        for batch in t.to_batches(max_chunksize=64):
            w.write_batch(batch)
    with pa.memory_map(path) as f:
        found = list(arrow_streams.messages(f))
        size = f.size()
    assert [m.kind for m in found] == [1, 2] + [3] * 16
    assert found[0].start == 0 and all(a.end == b.start for a, b in zip(found, found[1:])) and found[-1].end == size - len(arrow_streams.END)
    for limit in (1, 6000, 1 << 30):
        cut = arrow_streams.ranges(path, path, limit)
        assert cut[0].start == found[1].start and cut[-1].end == found[-1].end and all(a.end == b.start for a, b in zip(cut, cut[1:]))
        arrow_streams.register(spark)
        got = spark.read.format("arrow_stream").option("range", limit).load(path)
        assert got.rdd.getNumPartitions() == len(cut)
        assert sorted((r.i, r.s, r.l, r.d) for r in got.collect()) == [tuple(x.values()) for x in t.to_pylist()]
    assert scans.table(spark, path).count() == 1000
    with open(path, "rb") as f:
        broken = f.read()[:-300]
    (tmp_path / "b.arrow").write_bytes(broken)
    with pytest.raises(Exception, match="ends within"):
        scans.table(spark, str(tmp_path / "b.arrow")).count()


def test_written_streams(spark, tmp_path):
    """Streams of all partitions appear together; a task that fails leaves none; an empty table has a schema."""
    arrow_streams.register(spark)
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.repeat(F.lit("x"), (F.col("id") % 9).cast("int"))).alias("s"), F.array("id").alias("a")).repartition(5)
    folder = f"file://{tmp_path}/w"
    df.write.format("arrow_stream").mode("append").save(folder)
    assert len(glob.glob(f"{tmp_path}/w/part-*.arrow")) == 5 and not glob.glob(f"{tmp_path}/w/_*")
    assert sorted(map(tuple, spark.read.format("arrow_stream").load(folder).collect())) == sorted(map(tuple, df.collect()))
    bad = df.select(F.when(F.col("id") == 4999, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("arrow_stream").mode("append").save(f"file://{tmp_path}/bad")
    assert not glob.glob(f"{tmp_path}/bad/*.arrow")
    assert len(glob.glob(f"{tmp_path}/bad/_*")) <= 4  # of killed tasks, hidden
    df.limit(0).write.format("arrow_stream").mode("append").save(f"file://{tmp_path}/none")
    none = spark.read.format("arrow_stream").load(f"file://{tmp_path}/none")
    assert none.count() == 0 and none.schema.names == df.schema.names


def test_lines_over_splits(spark, tmp_path):
    """Numbers and the last record by position, whatever the splits."""
    r = random.Random(1)
    records = [{"id": f"k{r.randrange(300)}", "score": i / 1000, "n_chunks": i} for i in range(3000)]
    path = tmp_path / "cache.jsonl"
    path.write_text("\n".join([json.dumps({"identity": {"m": 1}}), *(json.dumps(x) for x in records[:1500]), "", *(json.dumps(x) for x in records[1500:])]) + "\n")
    want = {x["id"]: (x["score"], x["n_chunks"]) for x in records}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for most in ("7000", "100m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            numbered = scans.lines(spark, str(path))
            assert (spark.read.text(str(path)).rdd.getNumPartitions() > 5) == (most == "7000")
            assert [x.line for x in sorted(numbered.collect(), key=lambda x: x.number)] == path.read_text().split("\n")[:-1]
            assert {x.id: (x.score, x.n_chunks) for x in scans.cache(spark, str(path), {"m": 1}, schemas.CHUNK_CACHE).collect()} == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    with pytest.raises(ValueError):
        scans.cache(spark, str(path), {"m": 2}, schemas.CHUNK_CACHE)


def test_windows_go_on(spark, tmp_path):
    """Killed in its third window, a run has kept two; the next adds exactly the rest, a third nothing."""
    pending, place = f"file://{tmp_path}/pending", f"file://{tmp_path}/run"
    spark.range(0, 95, 1, 3).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).write.parquet(pending)
    seen = []

    def score(batch):
        ids = sorted(r.id for r in batch.collect())
        if len(seen) == 2 and ids[0] == 40:
            seen.append("dies")
            raise RuntimeError("dies")
        seen.append(ids)
        return batch.withColumn("score", F.col("id") / 100)

    with pytest.raises(Exception, match="dies"):
        windows.score_windows(spark, pending, place, score, 20)
    kept = spark.read.parquet(f"{place}/cache")
    assert sorted(r.id for r in kept.collect()) == list(range(40))
    windows.score_windows(spark, pending, place, score, 20)
    assert seen == [list(range(0, 20)), list(range(20, 40)), "dies", list(range(40, 60)), list(range(60, 80)), list(range(80, 95))]
    windows.score_windows(spark, pending, place, score, 20)
    got = spark.read.parquet(f"{place}/cache").collect()
    assert len(seen) == 6 and sorted((r.id, r.window) for r in got) == [(i, i // 20) for i in range(95)]


def test_window_bounds():
    """Asked again, a window stays; slices of a window are its rows; a new reader goes on where it is told."""
    reader = windows._Windows("/none", 10, 0, 3)
    reader.groups = [("a", 0, 0, 7), ("a", 1, 7, 9), ("b", 0, 16, 9)]
    assert reader.latestOffset() == reader.latestOffset() == {"row": 10}
    cut = reader.partitions({"row": 0}, {"row": 10})
    assert [(s.path, s.group, s.first, s.last) for s in cut] == [("a", 0, 0, 4), ("a", 0, 4, 7), ("a", 1, 0, 3)]
    assert reader.latestOffset() == {"row": 20}
    assert [(s.path, s.group, s.first, s.last) for s in reader.partitions({"row": 10}, {"row": 20})] == [("a", 1, 3, 7), ("a", 1, 7, 9), ("b", 0, 0, 4)]
    assert reader.latestOffset() == {"row": 25} and not reader.partitions({"row": 25}, {"row": 25})
