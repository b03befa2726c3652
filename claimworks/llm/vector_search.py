"""Nearest neighbours by a block matrix join over int8 tiles.

Queries are dealt into sets and candidates into parts, and a cell of the grid of sets and parts is a task: the blocks of its set
come first and are held, those of its part stream past, and each pair of blocks is a tile. Sets are as many as a task's memory
asks for, or more where that moves fewer bytes; nothing but four sums goes to the driver. A vector is rounded to int8 with a scale of
its own, and the length of what rounding took away is kept. Products of a tile's int8 matrices are exact in floating point
and give distances that are off by those two lengths at most; pairs whose least possible distance is beyond the k-th largest
possible one are out. The distances of the rest are computed again from the original vectors in double precision, term by
term in order, and go into a heap for each query; heaps of a cell's tiles are merged before the exchange, the others after.

Every query gets its exact neighbours: nothing is sampled or left to chance.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components take no part, nor do rows
without vec_id; vectors of different dimensions are never compared; a query id on several rows counts once, with its least
vector, and none of its rows is a candidate of its own; a repeated candidate is a candidate each time; with fewer candidates
than wanted, all are returned; empty tables give empty tables; further columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimworks.llm import _tables

NEAREST = 10
QUERY_BLOCK = 1024
#: Products of int8 numbers over so many components are exact in single precision.
EXACT = 1024
#: Pairs whose vectors are brought together at a time.
PAIRS = 1 << 15
#: Numbers of eight bytes that a task holds of its queries: their components and heaps.
SET_NUMBERS = 1 << 22
#: Pairs of a query and a candidate that are worth a task of their own.
TASK_PAIRS = 1 << 20


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (floats where they are given as such, doubles otherwise) of the rows that take part."""
    v = F.col("embedding").cast("array<float>" if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else "array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).select("vec_id", v.alias("v"), odd.alias("odd")).where(~F.col("odd") & F.exists("v", lambda x: x != 0)).select("vec_id", "v")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components (as floats), scales, lengths of the rounding errors."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.float32), scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], EXACT):
        out += a[:, i : i + EXACT] @ b[:, i : i + EXACT].T
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, term by term; where squares leave the range of doubles, of the terms by their largest one."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        for i in range(a.shape[1]):
            d = a[:, i] - b[:, i]
            total += d * d
        out = np.sqrt(total)
        far = np.flatnonzero(~np.isfinite(total) | (total < 1e-280))
        if len(far):
            d = np.abs(a[far] - b[far])
            top = d.max(1)
            some = np.isfinite(top) & (top > 0)
            out[far] = top
            out[far[some]] = top[some] * np.sqrt(((d[some] / top[some, None]) ** 2).sum(1))
    return out


def nearest_in_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries, rows of vectors and distances of all pairs that may be among the k nearest, and within bound.

    Distances are estimated in units of the tile's largest component, so no square leaves the range of doubles from above; what
    rounding may add is bounded pair by pair, so one very long vector blurs its own pairs only.
    """
    unit = max(np.abs(queries).max(), np.abs(vectors).max())
    (qa, sa, ea), (qb, sb, eb) = quantised(queries / unit), quantised(vectors / unit)
    na, nb = sa**2 * (qa.astype(np.float64) ** 2).sum(1), sb**2 * (qb.astype(np.float64) ** 2).sum(1)
    square = na[:, None] + nb[None, :] - 2 * products(qa, qb) * sa[:, None] * sb[None, :]
    about = np.sqrt(np.maximum(square, 0))
    slack = (ea[:, None] + eb[None, :]) * (1 + 1e-9) + 1e-7 * (np.sqrt(na)[:, None] + np.sqrt(nb)[None, :]) + 1e-300
    own = query_ids[:, None] == ids[None, :]
    upper = np.where(own, np.inf, about + slack)
    bound = bound / unit * (1 + 1e-9)
    if upper.shape[1] > k:
        bound = np.minimum(bound, np.partition(upper, k - 1, axis=1)[:, k - 1])
    a, b = np.nonzero((about - slack <= bound[:, None]) & ~own)
    return a, b, np.concatenate([exact(queries[a[i : i + PAIRS]], vectors[b[i : i + PAIRS]]) for i in range(0, len(a), PAIRS)] or [np.zeros(0)])


def _best(a: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of each query row's k least by distance and id."""
    order = np.lexsort((ids, d, a))
    first = np.append(True, np.diff(a[order]) != 0) if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
    return order[rank < k]


def _packed(ids: np.ndarray, x: np.ndarray) -> dict:
    return {"dim": pa.array([x.shape[1]], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary())}


def _unpacked(dim: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block, as doubles."""
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vectors, np.float32 if len(vectors) == 4 * dim * len(i) else np.float64).reshape(-1, dim).astype(np.float64)


def _blocks(rows: DataFrame, parts: int) -> DataFrame:
    """The vectors of each Arrow batch as matrices, by dimension, and dealt out in turn."""

    def run(batches):
        part = random.Random(TaskContext.get().partitionId()).randrange(parts)
        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for dim in np.unique(sizes).tolist():
                k = np.flatnonzero(sizes == dim)
                x = flat[ends[k][:, None] + np.arange(dim)]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32())} | _packed(ids[k], x))
                part = (part + 1) % parts

    return rows.select("vec_id", "v").mapInArrow(run, "part int, dim int, ids binary, vectors binary")


def _extent(rows: DataFrame) -> tuple[int, int]:
    """Rows and components, of those that take no part too."""
    return rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size("embedding"), F.lit(0))), F.lit(0))).first()


def grid(asked: tuple[int, int], held: tuple[int, int], k: int, width: int) -> tuple[int, int]:
    """How many sets and parts, from rows and components of queries and candidates.

    A set goes to each part with its heaps, and a part to each set, so the cells of fewest bytes are those where both weigh the same.
    """
    tasks = max(1, min(width, math.ceil(asked[0] * held[0] / TASK_PAIRS)))
    numbers = asked[1] + 3 * k * asked[0]
    sets = max(1, math.ceil(numbers / SET_NUMBERS), round(math.sqrt(tasks * numbers / max(1, held[1]))))
    return sets, math.ceil(tasks / sets)


def nearest(rows: DataFrame, queries: DataFrame, *, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows, the nearest first, ties by vec_id."""
    extent = _extent(queries)
    sets, parts = grid(extent, _extent(rows), k, _tables.blocks_wanted(rows.sparkSession))
    n_blocks = max(sets, math.ceil(extent[0] / QUERY_BLOCK))
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")).withColumn("dim", F.size("v"))

    def matrix(table: pa.Table) -> pa.Table:
        lists = pa.concat_arrays(table.column("v").chunks)
        return pa.table({"block": table.column("block")[:1]} | _packed(table.column("vec_id").to_numpy(), lists.flatten().to_numpy().reshape(len(lists), -1)))

    asked_blocks = dealt.groupBy("dim", "block").applyInArrow(matrix, "block int, dim int, ids binary, vectors binary")
    spread = asked_blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("set", F.col("block") % sets).withColumn("held", F.lit(False))
    held = _blocks(usable(rows), parts).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))).withColumn("held", F.lit(True))
    columns = ["held", "dim", "ids", "vectors", (F.col("set") * parts + F.col("part")).alias("cell")]
    # No join, whose plan would take a set's size before it is copied for the size of all copies and broadcast them.
    cells = spread.select(columns).unionByName(held.select(columns)).repartitionById(sets * parts, "cell").sortWithinPartitions("held")

    def run(batches):
        heaps: dict[int, list[tuple]] = defaultdict(list)
        for b in batches:
            for streams, dim, i, v in zip(*(b.column(c).to_pylist() for c in range(4))):
                ids, y = _unpacked(dim, i, v)
                if not streams:
                    heaps[dim].append((ids, y, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
                    continue
                for at, (query_ids, x, a0, i0, d0) in enumerate(heaps.get(dim, ())):
                    bound = np.full(len(query_ids), np.inf)
                    full = np.flatnonzero(np.bincount(a0, minlength=len(bound)) == k)
                    if len(full):
                        worst = np.zeros(len(bound))
                        np.maximum.at(worst, a0, d0)
                        bound[full] = worst[full]
                    a, p, d = nearest_in_tile(query_ids, x, ids, y, k, bound)
                    a, j, d = np.concatenate([a0, a]), np.concatenate([i0, ids[p]]), np.concatenate([d0, d])
                    best = _best(a, j, d, k)
                    heaps[dim][at] = (query_ids, x, a[best], j[best], d[best])
        for query_ids, _, a, j, d in (h for some in heaps.values() for h in some):
            yield pa.record_batch([pa.array(query_ids[a]), pa.array(j), pa.array(d)], names=["query_id", "vec_id", "score"])

    found = cells.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tables.read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 100 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_vector_search": op5_vector_search}
ORACLE = {
    "op5_vector_search": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
ok AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0 AND len(q.e) = len(c.e)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
}
