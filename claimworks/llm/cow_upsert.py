"""Copy-on-write upsert of a keyed table in sorted Parquet files, without a join of table and changes.

A table is a folder of Parquet files, each a stretch of the keys in order. An id's home is the file whose stretch it falls
into. Changes are tagged with their home, the rows of homes that any change reaches are read and put under the changes, and
one group-by of the key keeps the row (if there is one) and the last change (max_by); the two say what the row becomes and
whether that differs. Only homes with a difference are written again: their rows are numbered in key order (a number for
each range of keys and home is all that is summed up, so a home that a third of all ids falls into is no single task),
numbers are cut evenly into files, and small neighbours are put together. New files are written before old ones are deleted.

What the driver holds is the list of homes: a first key, a number of rows and a flag for each starting file. The changes of
one key are combined before they are moved.

Defined results: of rows that share a key the largest (by its columns, in order) is the one that a table starts with; rows
and changes without a key take no part; of changes with equal order the largest by their other columns counts, so repeated
changes are one; a change without order values comes before all others; a delete of an absent key and a change to what is
there already change nothing; a table without starting files has no home, so nothing is inserted; rows may have any further
columns, which inserted rows have as null.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from claimworks.llm import _tables
from claimworks.llm._lineage import cut, shared_folder
from claimworks.llm._ranks import ranked

VERSION, FILE = "cow_version", "cow_file"


def crc32(value: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8, or of a number's decimal digits."""
    return F.crc32(value.cast("string").cast("binary"))


def _write(rows: DataFrame, folder: str, key: str, version: int) -> None:
    """rows with FILE: each file by one task, in key order, as it streams by."""
    # Spark keeps an order that begins with the columns a write is partitioned by; a constant among them would have it sort anew, by these alone.
    dealt = rows.repartition(_tables.blocks_wanted(rows.sparkSession), FILE).sortWithinPartitions(FILE, key)
    dealt.write.partitionBy(FILE).parquet(f"{folder}/{VERSION}={version}")


def start(rows: DataFrame, folder: str, key: str, size: int) -> None:
    """Writes a table: files of so many rows by key, the last one with the rest."""
    whole = F.struct(*rows.columns)
    single = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(whole).alias("_row")).select("_row.*")
    _write(ranked(single, [key], name="_rank").withColumn(FILE, F.expr(f"cast(_rank div {size} as int)")).drop("_rank"), folder, key, 0)


def read(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The table's rows with VERSION and FILE; schema: that of the rows alone. A table without rows is read as an empty one."""
    return spark.read.schema(StructType([*schema.fields, StructField(VERSION, IntegerType()), StructField(FILE, IntegerType())])).parquet(folder)


def _cuts(homes: list[tuple[int, int, bool]], size: int) -> list[tuple[int, int, int, int]]:
    """home, even, longer, offset of each home that is written again; homes: (number, rows, differs) in key order.

    The first longer of its files have even + 1 rows, the others even; the number of a file is offset and its place. A home's
    first file that goes into its left neighbour gets that one's number.
    """
    out, free, left = [], 0, None  # left: number and rows of the neighbour that a file may join
    for home, n, differs in homes:
        if not differs:
            left = None
        elif n:
            k = -(-n // size)
            even, longer = divmod(n, k)
            first = even + (longer > 0)
            joins = left is not None and left[1] + first <= size
            offset = left[0] if joins else free
            out.append((home, even, longer, offset))
            free = offset + k
            left = (free - 1, n + (left[1] if joins else 0) if k == 1 else even)
    return out


def upsert(spark: SparkSession, folder: str, schema: StructType, changes: DataFrame, *, key: str, order: list[str], sets: list[str], size: int, ignored: Column, deleted: Column) -> None:
    """Applies each key's last change to the table in the folder.

    order: columns of changes, the greatest of which is last; sets: columns that a change sets, also to null; ignored, deleted:
    of changes, which also have home_first, the first key of their home. A change that is not deleted is an update or an insert.
    """
    table = read(spark, folder, schema).where(F.col(VERSION) == 0)
    firsts = sorted((r[FILE], r.first) for r in table.groupBy(FILE).agg(F.min(key).alias("first")).collect())  # a row for each file
    if not firsts:
        return
    begins = np.array([f for _, f in firsts], np.int64)

    @F.pandas_udf("int")
    def home(ids: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(begins, ids.to_numpy(np.int64), side="right") - 1, 0).astype(np.int32))

    named = F.broadcast(spark.createDataFrame(firsts, "home int, home_first long"))  # a row for each file
    rest = [c for c in changes.columns if c != key]
    tagged = changes.where(F.col(key).isNotNull()).withColumn("home", home(F.col(key))).join(named, "home").where(~F.coalesce(ignored, F.lit(False)))
    tagged = tagged.withColumn("gone", F.coalesce(deleted, F.lit(False)))
    reached = [r.home for r in tagged.select("home").distinct().collect()]  # a row for each file
    columns = [f.name for f in schema.fields]
    row = F.struct(*columns)
    base = table.where(F.col(FILE).isin(reached)).select(F.col(FILE).alias("home"), F.col(key).alias("id"), row.alias("base"))
    change = tagged.select("home", F.col(key).alias("id"), F.struct("gone", *sets).alias("change"), F.struct(*order, *sorted(set(rest) - set(order))).alias("at"))
    both = base.unionByName(change, allowMissingColumns=True).groupBy("home", "id").agg(F.any_value("base", F.lit(True)).alias("base"), F.max_by("change", "at").alias("change"))
    new = F.struct(*[(F.col("id") if c == key else F.col(f"change.{c}") if c in sets else F.col(f"base.{c}")).cast(schema[c].dataType).alias(c) for c in columns])
    after = F.when(F.col("change").isNull(), F.col("base")).when(~F.col("change.gone"), new)
    states = cut(both.select("home", "id", "base", after.alias("after")).select("home", "id", "after", (~F.col("after").eqNullSafe(F.col("base"))).alias("differs")))
    found = {r.home: (r.n, r.differs) for r in states.groupBy("home").agg(F.count("after").alias("n"), F.bool_or("differs").alias("differs")).collect()}  # a row for each file
    again = [h for h, _ in firsts if found.get(h, (0, False))[1]]
    cuts = _cuts([(h, *found.get(h, (1, False))) for h, _ in firsts], size)
    if cuts:
        rows = ranked(states.where(F.col("after").isNotNull() & F.col("home").isin([c[0] for c in cuts])).select("home", "id", "after"), ["home", "id"], "home", "place")
        plan = F.broadcast(spark.createDataFrame(cuts, "home int, even long, longer long, offset long"))  # a row for each file
        long_rows = F.expr("longer * (even + 1)")
        file = F.when(F.col("place") < long_rows, F.expr("place div (even + 1)")).otherwise(F.col("longer") + F.expr("(place - longer * (even + 1)) div even")) + F.col("offset")
        _write(rows.join(plan, "home").select("after.*", file.cast("int").alias(FILE)), folder, key, 1)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for h in again:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"{VERSION}=0/{FILE}={h}"), True)


# What the contract asks of each file.

_SUMS = ["cents", "crc"]
_OUT = "path string, rewritten boolean, first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string"
_OUT_ARROW = pa.schema([("path", pa.string()), ("rewritten", pa.bool_()), ("first_id", pa.int64()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("ids_sha256", pa.string())])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file; rows come in file order and none are held."""
    at, out = None, []
    for b in batches:
        paths = b.column("path").to_numpy(zero_copy_only=False)
        if not len(paths):
            continue
        begins = np.flatnonzero(np.concatenate([[True], paths[1:] != paths[:-1]]))
        ids, version, cents, crc = (b.column(c).to_numpy() for c in ("id", "version", *_SUMS))
        for s, e in zip(begins, np.append(begins[1:], len(paths))):
            text = ",".join(map(str, ids[s:e].tolist())).encode()
            if at is None or at[0] != paths[s]:
                if at is not None:
                    out.append(at)
                at = [paths[s], bool(version[s]), int(ids[s]), 0, 0, 0, hashlib.sha256(text)]
            else:
                at[6].update(b"," + text)
            at[3] += int(e - s)
            at[4] += int(cents[s:e].sum())
            at[5] += int(crc[s:e].sum())
    if at is not None:
        out.append(at)
    columns = list(zip(*[(*r[:6], r[6].hexdigest()) for r in out])) or [()] * 7
    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _OUT_ARROW)], schema=_OUT_ARROW)


def files(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """path, rewritten, first_id, n_rows, cents, rows_crc, ids_sha256, columns of every data file, read back. An amount that is no number counts 0."""
    amount = F.col("balance") * 100 + 0.5
    cents = F.when(F.abs(amount) < 9e15, F.floor(amount)).otherwise(0).cast("long")
    text = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("source", "segment", "city")])
    rows = read(spark, folder, schema).select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:///").alias("path"), F.col("_metadata.row_index").alias("i"), F.col("client_id").alias("id"), F.col(VERSION).alias("version"), F.coalesce(cents, F.lit(0)).cast("long").alias("cents"), crc32(text).alias("crc"))
    each = rows.repartition(_tables.blocks_wanted(spark), "path").sortWithinPartitions("path", "i").mapInArrow(_summed, _OUT)
    return each.withColumn("columns", F.lit(",".join(f.name for f in schema.fields)))


def applied(clients: DataFrame, changes: DataFrame, folder: str) -> DataFrame:
    """The contract's table and changes, in a new folder: files() of what is left."""
    spark = clients.sparkSession
    size = 1 + clients.count() // 1000
    start(clients.where(crc32(F.col("client_id")) % 7 > 3), folder, "client_id", size)
    h = crc32(F.col("home_first")) % 16
    gone = F.coalesce(F.col("op") == "D", F.lit(False)) | F.coalesce(crc32(F.col("change_id")) % 8 < h, F.lit(False))
    upsert(spark, folder, clients.schema, changes, key="client_id", order=["seq", "change_id"], sets=["source", "segment", "city", "balance"], size=size, ignored=h > 7, deleted=gone)
    return files(spark, folder, clients.schema)


def op12_cow_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    changes = spark.read.parquet(f"{sf_dir}/client_changes.parquet").select("change_id", "client_id", "seq", "op", "source", "segment", "city", "balance")
    return applied(spark.read.parquet(f"{sf_dir}/clients.parquet"), changes, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_cow_upsert": op12_cow_upsert}
