"""Chunks of documents: sentences packed greedily into a limit of words, scored, and folded back by their maximum."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sentences(text: Column) -> Column:
    """Sentences of a text, cut after a full stop, question or exclamation mark and white space."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def packed(text: Column, limit: int) -> Column:
    """Chunks of whole sentences with up to limit words; a longer sentence is a chunk alone. An empty text has none."""
    return packs(F.transform(sentences(F.coalesce(text, F.lit(""))), lambda s: F.struct(s.alias("s"), F.size(F.split(s, r"\s+")).alias("n"))), limit)


def packs(parts: Column, limit: int) -> Column:
    """packed() of sentences that are given with their words: an array of s, n."""
    # Where chunks begin is folded, not their texts: each text is copied once, when its chunk is joined up.
    none = F.expr("cast(array() as array<int>)")
    empty = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), none.alias("starts"))

    def add(a: Column, x: Column) -> Column:
        fits = (a["n"] == 0) & (F.size(a["starts"]) > 0) | (a["n"] + x["n"] <= limit) & (a["i"] > 0)
        n = F.when(fits, a["n"] + x["n"]).otherwise(x["n"])
        return F.struct((a["i"] + 1).alias("i"), n.cast("int").alias("n"), F.when(fits, a["starts"]).otherwise(F.concat(a["starts"], F.array(a["i"]))).alias("starts"))

    # The parts are bound to a name of their own, or they would be worked out again for each chunk.
    def joined(every: Column) -> Column:
        starts = F.aggregate(every, empty, add, lambda a: a["starts"])
        spans = lambda s: F.transform(s, lambda x, i: F.struct(x.alias("a"), F.coalesce(F.get(s, i + 1), F.size(every)).alias("z")))
        bound = F.get(F.transform(F.array(starts), spans), F.lit(0))
        return F.transform(bound, lambda x: F.array_join(F.transform(F.slice(every, x["a"] + 1, x["z"] - x["a"]), lambda y: y["s"]), " "))

    return F.get(F.transform(F.array(parts), joined), F.lit(0))


def exploded(rows: DataFrame, chunks: Column) -> DataFrame:
    """A row for each chunk; rows without any keep one with nulls."""
    return rows.select("*", F.posexplode_outer(chunks).alias("chunk_index", "chunk"))


def folded(scored: DataFrame, key: str = "id") -> DataFrame:
    """key, score, n_chunks, best_chunk: the largest support, 0 without chunks, and the first chunk that has it."""
    best = F.max(F.struct(F.col("support"), -F.col("chunk_index")))
    out = scored.groupBy(key).agg(F.count("chunk_index").alias("n_chunks"), F.max("support").alias("score"), best.alias("b"))
    return out.select(key, F.coalesce("score", F.lit(0.0)).alias("score"), "n_chunks", F.when(F.col("n_chunks") > 0, -F.col("b")["col2"]).alias("best_chunk"))


def scored_by(rows: DataFrame, make: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = 32) -> DataFrame:
    """rows (id, claim, chunk and others) with a column support, from a model that make() loads once for each worker.

    Batches are scored longest chunk first, so that chunks of like length are padded together.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            order = frame.chunk.fillna("").str.len().sort_values(ascending=False, kind="stable").index
            got = pd.Series(index=frame.index, dtype=float)
            for i in range(0, len(order), batch):
                k = [x for x in order[i : i + batch] if frame.chunk[x] is not None]
                if k:
                    got[k] = model(frame.chunk[k].tolist(), frame.claim[k].tolist())
            yield frame.assign(support=got)

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("support", DoubleType())]))


def hash_model() -> Callable[[list[str], list[str]], list[float]]:
    """A stand-in model: two decimals from a hash of chunk and claim."""
    import hashlib

    return lambda chunks, claims: [int(hashlib.sha256(f"{c}\n{q}".encode()).hexdigest()[:8], 16) % 101 / 100.0 for c, q in zip(chunks, claims)]


def hash_grid() -> Callable[[list[str], list[str | None]], np.ndarray]:
    """A stand-in model for every pair of chunk and claim: two decimals from a hash of both. A chunk is hashed once for all claims."""
    import hashlib

    def run(chunks: list[str], claims: list[str | None]) -> np.ndarray:
        ends, got = [f"|{c}".encode() for c in claims], []
        for chunk in chunks:
            head = hashlib.sha256(chunk.encode())
            for end in ends:
                h = head.copy()
                h.update(end)
                got.append(h.digest()[:4])
        grid = np.frombuffer(b"".join(got), ">u4").reshape(len(chunks), len(claims)) % 101 / 100.0
        grid[:, [c is None for c in claims]] = np.nan
        return grid

    return run
