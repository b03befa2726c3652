import json

import pytest

from claimworks.__main__ import main
from claimworks.operators import checks, joins
from claimworks.sources import scans, schemas


def test_prepare(spark, tmp_path):
    rows = [("S", f"doc {i % 40}", f"c{i}", i % 2, "x") for i in range(200)]
    spark.createDataFrame(rows, schemas.BENCHMARK).write.parquet(str(tmp_path / "d"))
    main(["prepare", str(tmp_path / "d"), str(tmp_path / "pools"), "--size", "10"])
    got = spark.read.parquet(str(tmp_path / "pools"))
    assert max(r["count"] for r in got.groupBy("pool", "dataset", "label").count().collect()) <= 10
    with pytest.raises(Exception):
        main(["prepare", str(tmp_path / "d"), str(tmp_path / "pools")])


def test_score_resumes_and_reports(spark, tmp_path, capsys):
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps({"id": str(i), "doc": f"d{i}", "claim": "c", "label": i % 2, "dataset": "AB"[i // 2 % 2]}) for i in range(12)))
    main(["score", str(tmp_path / "r.jsonl"), str(tmp_path / "out"), "--limit", "4"])
    place = capsys.readouterr().out.strip()
    assert spark.read.parquet(place + "/cache").count() == 4
    main(["score", str(tmp_path / "r.jsonl"), str(tmp_path / "out")])
    cache = spark.read.parquet(place + "/cache")
    assert cache.count() == 12 and cache.select("id").distinct().count() == 12
    main(["report", str(tmp_path / "r.jsonl"), place])
    assert "(macro)" in capsys.readouterr().out
    main(["check", "d", "c", '{"support": 0.2}'])
    assert json.loads(capsys.readouterr().out) == {"score": 0.2, "verdict": "Refuted"}


def test_small_joins(spark, tmp_path):
    sample = spark.createDataFrame([(1, "a"), (2, "b")], "review_index int, id string")
    notes = spark.createDataFrame([(1, "x", "y", "z"), (2, "x", "y", "z")], "index int, cluster string, assessment string, reason string")
    assert joins.zipped(sample, notes).count() == 2
    with pytest.raises(Exception, match="no pair for number 2"):
        joins.zipped(sample, notes.where("index = 1")).collect()
    (tmp_path / "f.txt").write_text("x")
    files = scans.fingerprints(spark, str(tmp_path / "f.txt"))
    assert checks.tampered(files, {"f.txt": files.first().sha256}).isEmpty()
    assert sorted(r.name for r in checks.tampered(files, {"f.txt": "0", "g.txt": "1"}).collect()) == ["f.txt", "g.txt"]
    line = {"id": "1", "usage": {"input_tokens": 1000, "output_tokens": 10}}
    (tmp_path / "p1.jsonl").write_text(json.dumps(line) + "\n" + json.dumps(line))
    assert scans.spent(spark, str(tmp_path / "p*.jsonl"), 1.0, 2.0) == pytest.approx(0.00204)
    packs = joins.packs_by_digest(spark, {"a": {"decision": {"threshold": 0.3}}})
    assert packs.first().threshold == 0.3
