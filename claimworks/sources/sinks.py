"""Writing results: records, resumable logs, errors apart, reports and manifests."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimworks.functions.hashing import configuration_digest


def append_scored(scored: DataFrame, cache: str, errors: str) -> None:
    """Rows with an error go to their own log, the others to the cache. scored is computed once."""
    kept = scored.persist()
    try:
        kept.where("error is null").drop("error").write.mode("append").parquet(cache)
        kept.where("error is not null").select("id", "error").write.mode("append").parquet(errors)
    finally:
        kept.unpersist()


def write_json_lines(df: DataFrame, folder: str, order: list[str] | None = None) -> None:
    """One ordered file where an order is asked for, else a file for each partition."""
    (df.repartition(1).sortWithinPartitions(*order) if order else df).write.mode("overwrite").json(folder)


def write_once(df: DataFrame, folder: str) -> None:
    """Fails where the folder exists."""
    df.write.mode("errorifexists").parquet(folder)


def write_manifest(folder: str, parameters: dict, name: str = "manifest.json") -> Path:
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(parameters, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    return path


def write_report(folder: str, report: dict) -> str:
    """report.json and a copy under its own digest; returns the digest's start."""
    key = configuration_digest(report)[:12]
    for name in (f"report-{key}.json", "report.json"):
        write_manifest(folder, report, name)
    return key


def lock(folder: str) -> int:
    """Takes a run's folder for this process; another holder is an error."""
    os.makedirs(folder, exist_ok=True)
    return os.open(os.path.join(folder, "lock"), os.O_CREAT | os.O_EXCL | os.O_RDWR)


def review(sample: DataFrame) -> DataFrame:
    """review_index, markdown: a case of an error sample as an appendix entry."""
    body = F.format_string("### %d. %s / %s\n\n- id: `%s`\n- claim: %s\n", "review_index", "dataset", "outcome", "id", "claim")
    return sample.select("review_index", body.alias("markdown"))
