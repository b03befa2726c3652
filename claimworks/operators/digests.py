"""Digests of whole tables, whatever the order of their rows, that say which rows differ.

A row's digest is the SHA-256 of its columns by name. Rows are dealt into leaves by a hash of their key; a leaf's digest is the
sum of its rows' digests, so rows may come in any order and repeated rows count. Leaves make a tree of fixed size: two tables
are equal if their roots are, and if they are not, only leaves that differ are looked into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimworks.operators.lineage import written

LEAVES, FAN = 4096, 64
_PARTS = 4


def row_digests(df: DataFrame, key: str) -> DataFrame:
    """key, leaf, d0 ... d3: a row's digest as four numbers of 60 bits (the rest is left out)."""
    whole = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.conv(F.substring(whole, 1 + 15 * i, 15), 16, 10).cast("long").alias(f"d{i}") for i in range(_PARTS)]
    return df.select(key, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(LEAVES)).cast("int").alias("leaf"), *parts)


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(F.col(f"d{i}").cast("decimal(38,0)")).alias(f"d{i}") for i in range(_PARTS)]]


def _digest(*parts: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256)


def tree(rows: DataFrame) -> DataFrame:
    """level (0: root, 1, 2: leaves), node, n, digest; rows: row_digests(). One count over the table, then a row for each leaf."""
    leaves = rows.groupBy("leaf").agg(*_sums()).select(F.col("leaf").alias("node"), "n", _digest("n", *[f"d{i}" for i in range(_PARTS)]).alias("digest"))
    both = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat_ws(":", x["node"].cast("string"), x["digest"])), ",")
    inner = leaves.groupBy(F.floor(F.col("node") / FAN).cast("int").alias("up")).agg(F.sum("n").alias("n"), F.sha2(both, 256).alias("digest")).withColumnRenamed("up", "node")
    root = inner.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(both, 256).alias("digest")).withColumn("node", F.lit(0))
    order = ["level", "node", "n", "digest"]
    return root.withColumn("level", F.lit(0)).select(*order).unionByName(inner.withColumn("level", F.lit(1)).select(*order)).unionByName(leaves.withColumn("level", F.lit(2)).select(*order))


def store(df: DataFrame, key: str, folder: str) -> str:
    """Writes the table's tree and its rows' digests into a new folder; the root."""
    spark = df.sparkSession
    row_digests(df, key).withColumn("part", F.floor(F.col("leaf") / FAN).cast("int")).repartition("part").write.partitionBy("part").parquet(f"{folder}/rows")
    tree(spark.read.schema(_rows_schema(df, key)).parquet(f"{folder}/rows")).coalesce(1).write.parquet(f"{folder}/tree")
    return stored_root(spark, folder)


def _rows_schema(df: DataFrame, key: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}, leaf int, {', '.join(f'd{i} long' for i in range(_PARTS))}, part int"


def stored_root(spark: SparkSession, folder: str) -> str:
    return spark.read.parquet(f"{folder}/tree").where("level = 0").first().digest


def root(df: DataFrame, key: str) -> str:
    return tree(row_digests(df, key)).where("level = 0").first().digest


def changed(df: DataFrame, key: str, folder: str) -> DataFrame:
    """key, change ('added', 'removed' or 'changed') of the rows that are not what store() saw.

    Keys that repeat are compared with all their rows together.
    """
    spark = df.sparkSession
    now = written(row_digests(df, key))  # the table is read once
    then = spark.read.parquet(f"{folder}/tree").where("level = 2").select("node", F.col("digest").alias("then"))
    leaves = tree(now).where("level = 2").select("node", "digest").join(then, "node", "full_outer").where(~F.col("digest").eqNullSafe(F.col("then")))
    wanted = [r.node for r in leaves.select("node").collect()]  # LEAVES at most
    before = spark.read.schema(_rows_schema(df, key)).parquet(f"{folder}/rows").where(F.col("part").isin(sorted({n // FAN for n in wanted})) & F.col("leaf").isin(wanted))
    whole = lambda rows, name: rows.groupBy(F.col(key).alias("_key")).agg(*_sums()).select("_key", _digest("n", *[f"d{i}" for i in range(_PARTS)]).alias(name))
    a, b = whole(before, "then"), whole(now.where(F.col("leaf").isin(wanted)), "now")
    both = a.join(b, a["_key"].eqNullSafe(b["_key"]), "full_outer").where(~F.col("then").eqNullSafe(F.col("now")))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.select(F.coalesce(a["_key"], b["_key"]).alias(key), change.alias("change"))
