"""Reading tables and passing Arrow text columns to numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: long texts make a batch of the default 10,000 rows too large for a Python worker.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def blocks_wanted(spark: SparkSession) -> int:
    """How many blocks the rows are dealt into: the session's shuffle width, which the operator of the cluster sizes."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_block(df: DataFrame, key: str, blocks: int) -> DataFrame:
    return df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))


def flat(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    return column.cast(pa.large_binary())


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one run of UTF-8 bytes, with the offsets of each; null counts as empty."""
    column = pc.fill_null(flat(column), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column) -> list[bytes]:
    """Each text as UTF-8 bytes; null counts as empty."""
    return pc.fill_null(flat(column), b"").to_pylist()
