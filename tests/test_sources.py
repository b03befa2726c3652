import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimworks.sources import scans, schemas, sinks
from claimworks.streaming import resume


def test_user_rows(spark, tmp_path):
    tides = [("north", "High water at the pier is at six.", "The tide is high at six.", 1), ("north", "The gate shuts at low water.", "The gate never shuts.", 0), ("south", "Two boats lie in the basin.", "The basin is empty.", 0)]
    rows = [{"id": f"t{n}", "document": d, "claim": c, "label": y, "dataset": s} for n, (s, d, c, y) in enumerate(tides)]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "p"))
    a = scans.user_rows(scans.json_lines(spark, str(tmp_path / "r.jsonl"), spark.createDataFrame(rows).schema))
    b = scans.user_rows(spark.read.parquet(str(tmp_path / "p")))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    bare = scans.user_rows(spark.createDataFrame([("d", "c", True)], "doc string, claim string, label boolean")).first()
    assert tuple(bare) == ("row:0", "all", "d", "c", 1)
    for odd in ([("d", "c", 3)], [("", "c", 1)], [("d", None, 0)]):
        with pytest.raises(Exception):
            scans.user_rows(spark.createDataFrame(odd, "doc string, claim string, label int")).collect()


def test_benchmark_ids(spark, tmp_path):
    spark.createDataFrame([("s", f"d{i}", "c", i % 2, "x") for i in range(9)], schemas.BENCHMARK).coalesce(1).write.parquet(str(tmp_path / "b"))
    got = {r.id: r.doc for r in scans.benchmark(spark, str(tmp_path / "b")).repartition(3).collect()}
    assert got == {f"dev:{i}": f"d{i}" for i in range(9)}


def test_cache(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"identity": {"m": 1}}\n{"id": "1", "score": 0.1, "n_chunks": 2}\n\n{"id": "2", "score": 0.2, "n_chunks": 1}\n{"id": "1", "score": 0.9, "n_chunks": 2}\n')
    got = scans.cache(spark, str(path), {"m": 1}, schemas.CHUNK_CACHE)
    assert sorted(map(tuple, got.collect())) == [("1", 0.9, 2), ("2", 0.2, 1)]
    with pytest.raises(ValueError):
        scans.cache(spark, str(path), {"m": 2}, schemas.CHUNK_CACHE)


def test_claims_and_corpus(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"claim_id": "1", "claim": "x", "year": 2001}')
    (tmp_path / "b.json").write_text('[{"claim_id": "2", "claim": "y", "candidate_documents": ["d.txt"]}, {"claim_id": "3", "claim": "z"}]')
    (tmp_path / "d.txt").write_bytes(b"ok \xff end")
    got = {r.claim_id: r for r in scans.claims(spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].claim_metadata["year"] == "2001" and got["2"].candidate_documents == ["d.txt"] and got["3"].candidate_documents is None
    assert tuple(scans.corpus(spark, str(tmp_path)).first()) == ("d.txt", "ok � end")
    assert scans.fingerprints(spark, str(tmp_path / "d.txt")).first().bytes == 8
    assert scans.only_file(spark, str(tmp_path), "d.txt").endswith("d.txt")
    with pytest.raises(FileNotFoundError):
        scans.only_file(spark, str(tmp_path), "*.json")
    (tmp_path / "e.json").write_text('{"claim_id": "9"}')
    with pytest.raises(Exception, match="lacks"):
        scans.claims(spark, str(tmp_path)).collect()


def test_arrow_stream(spark, tmp_path):
    table = pa.table({"doc": ["a", "b", None], "label": [1, 0, 1]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        for b in table.to_batches(max_chunksize=1):
            w.write_batch(b)
    df = scans.table(spark, str(tmp_path / "t.arrow"))
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("a", 1), ("b", 0), (None, 1)], key=str) and df.rdd.getNumPartitions() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", 0.5, None), ("2", None, "timeout")], "id string, score double, error string")
    for _ in range(2):
        sinks.append_scored(df, str(tmp_path / "cache"), str(tmp_path / "errors"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2 and spark.read.parquet(str(tmp_path / "errors")).first().error == "timeout"
    with pytest.raises(Exception):
        sinks.write_once(df, str(tmp_path / "cache"))
    key = sinks.write_report(str(tmp_path), {"b": 1, "a": "é"})
    assert (tmp_path / f"report-{key}.json").read_text() == (tmp_path / "report.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'
    sinks.lock(str(tmp_path / "run"))
    with pytest.raises(FileExistsError):
        sinks.lock(str(tmp_path / "run"))


def test_stream_resumes(spark, tmp_path):
    place = resume.run_location(f"file://{tmp_path}", {"model": "m"})
    assert place != resume.run_location(f"file://{tmp_path}", {"model": "n"})
    schema = "id string, dataset string, label int, score double"
    calls = []

    def score(new):
        calls.append(new.count())
        return new

    for rows in ([("1", "A", 1, 0.9), ("2", "A", 0, 0.8)], [("2", "A", 0, 0.8), ("3", "B", 1, 0.1), ("3", "B", 1, 0.1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        resume.score_new_files(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), place, score)
    assert calls == [2, 1]
    counts = resume.running_confusion(spark, spark.readStream.schema(schema).parquet(f"{place}/cache"), F.col("score") > 0.5, place)
    assert sorted(map(tuple, counts.collect())) == [("A", 1, 0, 1, 0), ("B", 0, 1, 0, 0)]
