"""Scoring in windows of so many rows, each kept as soon as it is done.

The pending rows are a Parquet table; a streaming source gives them N at a time, by row number, and each micro-batch replaces
the folder of its own number, so a batch that is run again leaves what one run leaves. A run that dies keeps all windows that
were done, and the next one goes on behind them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from claimworks.operators.lineage import exists, kept
from claimworks.sources.arrow_streams import opened


class Slice(InputPartition):
    """Rows first to last - 1 of a row group."""

    def __init__(self, uri: str, path: str, group: int, first: int, last: int):
        super().__init__((path, group, first))
        self.uri, self.path, self.group, self.first, self.last = uri, path, group, first, last


class _Windows(DataSourceStreamReader):
    """Offsets are row numbers: files by name, row groups in a file, rows in a group."""

    def __init__(self, uri: str, rows: int, done: int, slices: int):
        self.uri, self.rows, self.at, self.slices = uri, rows, done, slices
        self.groups: list[tuple[str, int, int, int]] | None = None  # path, group, number of the first row, rows

    def _index(self) -> list[tuple[str, int, int, int]]:
        """From the files' footers; the table does not change while it is read."""
        if self.groups is None:
            import pyarrow.parquet as pq
            from pyarrow import fs

            system, folder = opened(self.uri)
            self.groups, at = [], 0
            for path in sorted(x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.path.endswith(".parquet")):
                with system.open_input_file(path) as source:
                    meta = pq.read_metadata(source)
                for g in range(meta.num_row_groups):
                    n = meta.row_group(g).num_rows
                    self.groups.append((path, g, at, n))
                    at += n
        return self.groups

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        """One window past what has been planned; asking twice moves nothing."""
        groups = self._index()
        total = groups[-1][2] + groups[-1][3] if groups else 0
        return {"row": min(total, self.at + self.rows)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.at = max(self.at, end["row"])
        step = max(1, -(-(end["row"] - start["row"]) // self.slices))
        out = []
        for path, g, at, n in self._index():
            low, high = max(at, start["row"]), min(at + n, end["row"])
            out += [Slice(self.uri, path, g, s - at, min(s + step, high) - at) for s in range(low, high, step)]
        return out

    def read(self, partition: Slice) -> Iterator:
        import pyarrow.parquet as pq

        system, _ = opened(partition.uri)
        with system.open_input_file(partition.path) as source:
            at = 0
            for batch in pq.ParquetFile(source).iter_batches(row_groups=[partition.group]):
                low, high = max(partition.first - at, 0), min(partition.last - at, batch.num_rows)
                if low < high:
                    yield batch.slice(low, high - low)
                at += batch.num_rows
                if at >= partition.last:
                    return


class RowWindows(DataSource):
    """options: path, rows (of a window), done (rows that earlier runs have planned), slices (tasks of a window)."""

    @classmethod
    def name(cls) -> str:
        return "row_windows"

    def schema(self) -> StructType:
        raise ValueError("row_windows needs the table's schema")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        o = self.options
        return _Windows(o["path"], int(o["rows"]), int(o.get("done", 0)), int(o.get("slices", 8)))


def planned(spark: SparkSession, checkpoint: str) -> int:
    """The last row number in a checkpoint's log of offsets, 0 if there is none."""
    if not exists(spark, f"{checkpoint}/offsets"):
        return 0
    lines = spark.read.text(f"{checkpoint}/offsets").where("value like '{\"row\"%'").collect()  # a line for each window that the log still has
    return max((json.loads(r.value)["row"] for r in lines), default=0)


class TooManyErrors(RuntimeError):
    pass


def score_windows(spark: SparkSession, pending: str, location: str, score: Callable[[DataFrame], DataFrame], rows: int, *, cache: str | None = None, errors: str | None = None, most: int = 10) -> None:
    """Scores the Parquet table pending in windows of so many rows, in order, into cache/window=0, 1 ... (location/cache).

    Where score gives a column error, rows that have one go to errors/window=0, 1 ... (location/errors) instead, and after a
    window in which there have come to be more than most of them the run stops. An error in score ends the run too; what was
    done stays either way, and the next call goes on behind it.
    """
    spark.dataSource.register(RowWindows)
    slices = max(1, spark.sparkContext.defaultParallelism)
    checkpoint, failed = f"{location}/windows", 0
    cache, errors = cache or f"{location}/cache", errors or f"{location}/errors"
    stream = spark.readStream.format("row_windows").schema(spark.read.parquet(pending).schema).option("rows", rows).option("slices", slices).option("done", planned(spark, checkpoint)).load(pending)

    def run(batch: DataFrame, number: int) -> None:
        nonlocal failed
        if failed > most:
            raise TooManyErrors(f"{failed} rows failed")
        found = score(batch)
        if "error" not in found.columns:
            found.write.mode("overwrite").parquet(f"{cache}/window={number}")
            return
        found = kept(found)  # scored once
        bad = found.where("error is not null").select("id", "error")
        found.where("error is null").drop("error").write.mode("overwrite").parquet(f"{cache}/window={number}")
        bad.write.mode("overwrite").parquet(f"{errors}/window={number}")
        failed += bad.count()

    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    if failed > most:
        raise TooManyErrors(f"{failed} rows failed")
