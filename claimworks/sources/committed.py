"""Outputs that appear whole or not at all: a file for each claim, a summary and a manifest, published by one move."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from claimworks.sources.arrow_streams import opened


def file_name(claim_id: str) -> str:
    """A claim's file: its id as far as a path can have it, and what tells ids apart that look alike there."""
    return f"{re.sub(r'[^A-Za-z0-9_.-]', '_', claim_id)[:80]}-{hashlib.sha256(claim_id.encode()).hexdigest()[:12]}.json"


@dataclass
class _Done(WriterCommitMessage):
    counts: Counter = field(default_factory=Counter)


class _Writer(DataSourceWriter):
    """Tasks write into a folder of the run, which nobody looks for before the manifest names it."""

    def __init__(self, uri: str, parameters: str):
        self.uri, self.parameters, self.run = uri, parameters, f"run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Done:
        system, folder = opened(self.uri)
        system.create_dir(f"{folder}/{self.run}/claims", recursive=True)
        done = _Done()
        for row in iterator:
            # A task that is run again writes the same names.
            with system.open_output_stream(f"{folder}/{self.run}/claims/{file_name(row['claim_id'])}") as out:
                out.write(row["value"].encode())
            done.counts[row["verdict"] or "none"] += 1
        return done

    def commit(self, messages: list) -> None:
        system, folder = opened(self.uri)
        counts = sum((m.counts for m in messages if m is not None), Counter())
        system.create_dir(f"{folder}/{self.run}/claims", recursive=True)
        summary = {"claims": sum(counts.values()), "verdicts": dict(sorted(counts.items()))}
        manifest = {"run": self.run, "summary": f"{self.run}/summary.json", "parameters": json.loads(self.parameters)}
        for name, what in ((f"{self.run}/summary.json", summary), (f"{self.run}/manifest.json", manifest)):
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write((json.dumps(what, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode())
        system.move(f"{folder}/{self.run}/manifest.json", f"{folder}/manifest.json")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, folder = opened(self.uri)
        if system.get_file_info(f"{folder}/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.run}")


class ClaimFiles(DataSource):
    """options: path, parameters (JSON, for the manifest). Rows: claim_id, verdict, value (the claim's JSON)."""

    @classmethod
    def name(cls) -> str:
        return "claim_files"

    def schema(self) -> StructType:
        raise ValueError("claim_files are written; published() reads them")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("parameters", "{}"))


def publish(results: DataFrame, folder: str, parameters: dict) -> None:
    """results: claim_id, verdict and whatever a claim's file is to hold. Whoever reads sees the last results until all of these are there."""
    results.sparkSession.dataSource.register(ClaimFiles)
    rows = results.select("claim_id", "verdict", F.to_json(F.struct("*")).alias("value"))
    rows.write.format("claim_files").option("parameters", json.dumps(parameters)).mode("append").save(folder)


def manifest(folder: str) -> dict | None:
    """The manifest of what is published, None before anything is."""
    from pyarrow import fs

    system, path = opened(folder)
    if system.get_file_info(f"{path}/manifest.json").type != fs.FileType.File:
        return None
    with system.open_input_file(f"{path}/manifest.json") as f:
        return json.loads(f.read())


def published(spark: SparkSession, folder: str) -> DataFrame:
    """claim_id, verdict, value of what is published."""
    files = spark.read.text(f"{folder}/{manifest(folder)['run']}/claims", wholetext=True)
    return files.select(F.get_json_object("value", "$.claim_id").alias("claim_id"), F.get_json_object("value", "$.verdict").alias("verdict"), "value")


class Held(RuntimeError):
    pass


class Lease:
    """A run's folder for one holder, as long as the holder renews it; one that crashed loses it when its time is over.

    with Lease(spark, folder, 60) as lease: ... lease.renew()
    """

    def __init__(self, spark: SparkSession, folder: str, seconds: float, clock=time.time):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._folder, self._seconds, self._clock = self._path(folder), seconds, clock
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.owner, self._until = uuid.uuid4().hex, 0.0

    def _name(self, owner: str, until: float) -> str:
        return f"{until:.3f}-{owner}"

    def _holder(self) -> str | None:
        place = self._path(self._folder, "lease")
        if not self._files.exists(place):
            return None
        names = sorted(x.getPath().getName() for x in self._files.listStatus(place))
        return names[-1] if names else ""

    def take(self) -> None:
        """The lease is a folder with one name in it: its end and its holder. Making the folder is what only one can do."""
        place = self._path(self._folder, "lease")
        found = self._holder()
        if found is not None:
            if found and float(found.split("-")[0]) > self._clock():
                raise Held(f"{self._folder} is held until {found.split('-')[0]}")
            self._files.rename(place, self._path(self._folder, f"lease-{self.owner}"))  # of several, one moves it
            self._files.delete(self._path(self._folder, f"lease-{self.owner}"), True)
        self._files.mkdirs(self._folder)
        mine = self._path(self._folder, f"take-{self.owner}")
        self._until = self._clock() + self._seconds
        self._files.mkdirs(self._path(mine, self._name(self.owner, self._until)))
        if self._files.exists(place) or not self._files.rename(mine, place) or self._holder() != self._name(self.owner, self._until):
            self._files.delete(mine, True)
            raise Held(f"{self._folder} was taken by another")

    def renew(self) -> None:
        if self._holder() != self._name(self.owner, self._until):
            raise Held(f"{self._folder} is no longer held")
        place, before = self._path(self._folder, "lease"), self._name(self.owner, self._until)
        self._until = self._clock() + self._seconds
        self._files.rename(self._path(place, before), self._path(place, self._name(self.owner, self._until)))

    def release(self) -> None:
        if self._holder() == self._name(self.owner, self._until):
            self._files.delete(self._path(self._folder, "lease"), True)

    def __enter__(self) -> Lease:
        self.take()
        return self

    def __exit__(self, *_) -> None:
        self.release()
