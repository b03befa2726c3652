"""Outputs that appear together, leases, and one resolved model for each name."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from claimworks.sources import committed
from claimworks.streaming import pinning


def test_published(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    df = spark.createDataFrame([(f"c/{i}", ["Supported", "Refuted"][i % 2], i / 10) for i in range(20)] + [("c_1", None, None)], "claim_id string, verdict string, p double").repartition(4)
    assert committed.manifest(folder) is None
    committed.publish(df, folder, {"threshold": 0.3})
    first = committed.manifest(folder)
    assert first["parameters"] == {"threshold": 0.3}
    assert json.loads(Path(f"{tmp_path}/out/{first['summary']}").read_text()) == {"claims": 21, "verdicts": {"Refuted": 10, "Supported": 10, "none": 1}}
    assert {r.claim_id: r.verdict for r in committed.published(spark, folder).collect()} == {r.claim_id: r.verdict for r in df.collect()}
    bad = df.withColumn("p", F.when(F.col("claim_id") == "c/7", F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("p")))
    with pytest.raises(Exception, match="broken"):
        committed.publish(bad, folder, {})
    assert committed.manifest(folder) == first and committed.published(spark, folder).count() == 21  # killed tasks may leave a folder that nothing names
    committed.publish(df.limit(0), folder, {"none": True})
    assert committed.manifest(folder)["parameters"] == {"none": True}


def test_lease(spark, tmp_path):
    now = [1000.0]
    lease = lambda: committed.Lease(spark, f"file://{tmp_path}/run", 10, clock=lambda: now[0])
    with lease() as a:
        with pytest.raises(committed.Held):
            lease().take()
        now[0] += 8
        a.renew()
        now[0] += 8
        with pytest.raises(committed.Held):
            lease().take()
        now[0] += 5  # a crashed
        b = lease()
        b.take()
        with pytest.raises(committed.Held):
            a.renew()
    with pytest.raises(committed.Held):
        lease().take()  # a's end left b's lease alone
    b.release()
    with lease():
        pass
    assert not any(Path(f"{tmp_path}/run").iterdir())


def test_pinned(spark, tmp_path):
    """The first answer fixes a name's model over batches and restarts; a name with a version is itself."""
    place, schema = f"file://{tmp_path}/p", "requested string, model string, id long"
    batches = [
        [("m", "m-1.2", 5), ("m", "m-1.3", 7), ("m", "m-1.2", 9), ("n-2.0", "n-2.1", 1), ("n-2.0", "n-2.0", 2), ("k", None, 1), (None, "x", 3)],
        [("m", "m-1.3", 1), ("m", "m-1.2", 2), ("k", "k-3.0", 4), ("k", "k-3.1", 6)],
    ]
    everything = []
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        everything += rows
        pinning.first_answers(df, "id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("requested string, model string, id long").parquet(f"{tmp_path}/in")
        found = pinning.pin(spark, stream, place, "id")
    assert {(r.requested, r.resolved) for r in found.collect()} == {("m", "m-1.2"), ("n-2.0", "n-2.0"), ("k", "k-3.0")}
    got = {(r.requested, r.model, r.id): r.refused for r in pinning.refused(spark.createDataFrame(everything, schema), found).collect()}
    assert {k: v for k, v in got.items() if v} == {
        ("m", "m-1.3", 7): "another model than before", ("m", "m-1.3", 1): "another model than before", ("n-2.0", "n-2.1", 1): "another model than the pinned one",
        ("k", None, 1): "no model", ("k", "k-3.1", 6): "another model than before", (None, "x", 3): "another model than before",
    }
