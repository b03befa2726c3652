"""Shards of nearly equal bytes by a k-d tree over the documents' metadata.

Each document is a point: its source and language (by hash), its length and its id, each from 0 to 1, and weighs its bytes.
A node that is to become k shards is split where k // 2 / k of its bytes lie to the left, along the dimension in which its
points spread widest, until every leaf is one shard, which then has its target, the total over the shards. All nodes of a
level are split at once.

A split is a weighted quantile found without moving rows: sums of bytes by node and range of the value go to the driver (at
most BINS numbers for all nodes of a level, whatever the input), the range in which the quantile falls is cut again, and so on. Points with equal values are told apart by their text's hash, so that equal texts with equal metadata lie side by
side, then by their id's hash, then by their row number; a hot source or a group of copies is therefore cut like any other.
A node's rows are named by an expression of its splits, so no level writes or shuffles anything.

Defined results: null texts weigh the fixed 16 bytes only; null and unknown metadata are a value like any other, at 0; rows
that are equal in every column are spread like others; an empty table gives an empty one; with fewer rows than shards some
shards are empty; further columns are ignored by shards() and kept by write().
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimworks.llm._lineage import cut
from claimworks.llm._ranks import ranked

SHARDS, BASE = 40, 16
#: Sums that go to the driver at once, over all nodes of a level.
BINS = 1 << 14
#: A quantile is found when a range holds less than this part of a shard, or a single point.
CLOSE = 2000
_TOP = 1 << 40


def size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + BASE


def _hashed(*columns: Column | str) -> Column:
    """From 0 to 2^40, even."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 24)


def _scaled(value: Column, low: float | None, high: float | None) -> Column:
    if low is None or high is None or not high > low:
        return F.lit(0).cast("long")
    part = (value - F.lit(low)) / F.lit(high - low) * (_TOP - 1)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(float(_TOP)), F.when(~F.isnan(part), part))).cast("long"), F.lit(0).cast("long"))


@dataclass(frozen=True)
class Dimensions:
    """names: looked up by hash; numbers: on a line (logarithmic for those in logs)."""

    names: tuple[str, ...] = ("source", "lang")
    numbers: tuple[str, ...] = ("doc_id",)
    logs: tuple[str, ...] = ("n_chars",)

    def columns(self, docs: DataFrame) -> list[Column]:
        values = {c: F.col(c).cast("double") for c in self.numbers} | {c: F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in self.logs}
        ends = docs.agg(*[f(v).alias(f"{n}_{c}") for c, v in values.items() for n, f in (("low", F.min), ("high", F.max))]).first() if values else None
        return [F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(_hashed(c)) for c in self.names] + [_scaled(v, ends[f"low_{c}"], ends[f"high_{c}"]) for c, v in values.items()]


@dataclass
class Node:
    """shards from first on, or the split of them: a point is left of it if its keys come before those of at."""

    first: int
    shards: int
    dimension: int = -1
    at: tuple[int, ...] = ()
    left: Node | None = None
    right: Node | None = None

    def below(self) -> str:
        """The number of the leaf that a row falls into, as SQL."""
        if self.left is None:
            return str(self.first)
        before = "false"
        for key, value in reversed(list(zip((f"d{self.dimension}", *_TIES), self.at))):
            before = f"{key} < {value}" if before == "false" else f"({key} < {value} OR {key} = {value} AND ({before}))"
            if value == 0:  # no key is less than 0
                before = "false" if before.endswith("< 0") else before
        return f"CASE WHEN {before} THEN {self.left.below()} ELSE {self.right.below()} END"


_TIES = ("by_text", "by_id", "by_row")


@dataclass
class _Search:
    """A quantile on its way: what lies before low is less than want; keys before stage have one value each."""

    node: Node
    want: float
    dimension: int
    low: int
    high: int
    stage: int = 0
    fixed: tuple[int, ...] = ()
    before: int = 0
    width: int = 1


def _searched(points: DataFrame, searches: list[_Search], close: float) -> None:
    """Narrows all searches down at once, until each has its split. points: with their node."""
    active = list(searches)
    while active:
        for s in active:
            s.width = -(-(s.high - s.low + 1) // max(2, BINS // len(active)))
        rows = [(s.node.first, s.dimension, s.stage, s.low, s.high, s.width, *(list(s.fixed) + [None] * 4)[:3]) for s in active]
        asked = F.broadcast(points.sparkSession.createDataFrame(rows, "node int, dimension int, stage int, low long, high long, width long, f0 long, f1 long, f2 long"))  # a row for each node
        dimensions = [c for c in points.columns if c[0] == "d" and c[1:].isdigit()]
        wide = f"element_at(array({', '.join(dimensions)}), dimension + 1)"
        key = f"CASE stage WHEN 0 THEN {wide} WHEN 1 THEN by_text WHEN 2 THEN by_id ELSE by_row END"
        near = points.join(asked, "node").where(f"(f0 IS NULL OR f0 = {wide}) AND (f1 IS NULL OR f1 = by_text) AND (f2 IS NULL OR f2 = by_id)")
        near = near.select("node", "size", "low", "high", "width", F.expr(key).alias("key")).where("key BETWEEN low AND high")
        sums = near.groupBy("node", F.expr("(key - low) div width").alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()  # BINS at most
        found: dict[int, list[tuple[int, int, int, int, int]]] = {}
        for r in sums:
            found.setdefault(r.node, []).append((r.bin, r.bytes, r.n, r.low, r.high))
        going = []
        for s in active:
            total = s.before
            for _, n, points_in, low, high in sorted(found[s.node.first]):
                if total + n >= s.want:
                    break
                total += n
            s.before, s.low, s.high = total, low, high
            rest, more = s.want - s.before, n > close and points_in > 1
            if s.low < s.high and more:
                going.append(s)
            elif more and s.stage < len(_TIES):
                s.stage, s.fixed, s.low, s.high = s.stage + 1, (*s.fixed, s.low), 0, _TOP
                going.append(s)
            else:  # the range goes to the side that leaves less over
                s.node.at = (*s.fixed, s.low if n - rest > rest else s.high + 1, *[0] * (len(_TIES) - s.stage))
        active = going


def tree(points: DataFrame, dimensions: int, shards: int) -> Node:
    """points: size, d0 ... and the ties. The k-d tree whose leaves are the shards."""
    root = Node(0, shards)
    level = [root]
    total = points.agg(F.sum("size")).first()[0] or 0
    close = total / shards / CLOSE
    while level := [n for n in level if n.shards > 1]:
        placed = points.withColumn("node", F.expr(root.below()))
        spread = [f(f"d{i}").alias(f"{n}{i}") for i in range(dimensions) for n, f in (("low", F.min), ("high", F.max))]
        stats = {r.node: r for r in placed.groupBy("node").agg(F.sum("size").alias("bytes"), *spread).collect()}  # a row for each node
        searches = []
        for node in level:
            few = node.shards // 2
            r = stats.get(node.first)
            node.left, node.right = Node(node.first, few), Node(node.first + few, node.shards - few)
            if r is None:  # no rows
                node.dimension, node.at = 0, (0,) * (1 + len(_TIES))
                continue
            widest = max(range(dimensions), key=lambda i: r[f"high{i}"] - r[f"low{i}"])
            node.dimension = widest
            searches.append(_Search(node, r.bytes * few / node.shards, widest, r[f"low{widest}"], r[f"high{widest}"]))
        _searched(placed, searches, close)
        level = [child for node in level for child in (node.left, node.right)]
    return root


def _keyed(docs: DataFrame, dimensions: Dimensions) -> tuple[DataFrame, list[str]]:
    """Documents with size and keys, and the names of these."""
    chosen = dimensions.columns(docs)
    keyed = docs.withColumns({"size": size(F.col("text")), **{f"d{i}": c for i, c in enumerate(chosen)}, "by_text": _hashed("text"), "by_id": _hashed("doc_id"), "by_row": F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 24)})
    return keyed, ["size", *[f"d{i}" for i in range(len(chosen))], *_TIES]


def shards(docs: DataFrame, n: int = SHARDS, dimensions: Dimensions = Dimensions()) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (the place within the shard, by doc_id) of every document."""
    keyed, names = _keyed(docs, dimensions)
    points = cut(keyed.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), *names))
    found = tree(points, len(names) - 1 - len(_TIES), n)
    placed = points.select("doc_id", "size", "text_crc32", F.expr(found.below()).cast("int").alias("shard"), "by_row")
    return ranked(placed, ["shard", "doc_id", "text_crc32", "by_row"], "shard", "slot").drop("by_row")


def write(docs: DataFrame, folder: str, n: int = SHARDS, dimensions: Dimensions = Dimensions()) -> None:
    """Writes the documents with all their columns, a folder for each shard, large shards as several files."""
    keyed, names = _keyed(docs.select(F.struct(*docs.columns).alias("_row"), *dict.fromkeys(["doc_id", "text", *dimensions.names, *dimensions.numbers, *dimensions.logs])), dimensions)
    found = tree(cut(keyed.select(*names)), len(names) - 1 - len(_TIES), n)
    keyed.select("_row", F.expr(found.below()).alias("shard")).hint("rebalance", "shard").select("_row.*", "shard").write.partitionBy("shard").parquet(folder)


def op13_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return shards(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_kd_shards": op13_kd_shards}
