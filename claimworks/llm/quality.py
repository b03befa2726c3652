"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every text gives FEATURES statistics. Most are rates, counts by totals; a rate has the usual one of all training rows mixed in, with
a weight, so that a text of a few words is no outlier, and is then transformed to be closer to normal. Each class of the
labelled training rows has a mean and a covariance, from sums that the executors add up; the covariance is shrunk towards that
of both classes together and towards its own diagonal. A score is the logistic function of the difference of the classes' log
densities and log shares: Mahalanobis distances through inverted Cholesky factors, computed once when the model is made.

Nothing is tuned by hand. The weight and both shares of shrinkage are those of GRID with the least log loss over FOLDS folds of
the training rows, and the usual rates are those of the training rows. Training takes every labelled row that is not held out (crc32 of doc_id as text,
modulo 3, is 1), and nothing else looks at labels; labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts have all statistics of an empty text and a score like any other; labels other than 0
and 1, or null, are ignored, several labels of a document count each; where a class has fewer than two training rows, every
score is the share of label 1, or a half without any; rows with a null doc_id are not held out and have no label; empty tables give
empty tables; further columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimworks.llm import _tables
from claimworks.llm._lineage import cut

FEATURES = 18
#: What is tried: weight of the usual rate in words, shares of the common covariance and of the own diagonal.
GRID = tuple(itertools.product((3.0, 12.0, 48.0), (0.02, 0.1, 0.3, 0.6), (0.0, 0.05, 0.2)))
FOLDS = 5
HELD_OUT = 1
#: What each statistic is a count by: nothing (it is no rate), words, bytes or lines, as units that a weight of one word makes.
_UNITS = np.array([0, 0, 1, 1, 5, 5, 5, 5, 5, 1, 1, 1 / 3, 5, 5, 1, 1, 1, 5])
_LOG, _ROOT = [2, 9, 15, 17], [4, 5, 6, 7, 8, 10, 11, 13, 14, 16]

_KIND = np.zeros(256, np.int64)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[x for x in range(33, 127) if not chr(x).isalnum()]] = 5
_KIND[128:] = 6
_MARKS = _KIND == 5


def statistics(text: bytes) -> np.ndarray:
    """The counts of one text and what they are counts by: FEATURES numbers each, one list after the other."""
    out = np.zeros((2, FEATURES))
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if not n:
        return out.ravel()
    counts = np.bincount(data, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=7)
    words = text.split()
    w = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    mark = _MARKS[data]
    share = counts[counts > 0] / n
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, w) if words else np.zeros(1, np.int64)
    marks = counts[[33, 46, 63]].sum()
    out[0] = [
        np.log1p(n), np.log1p(w), sizes.sum(), sizes.std() * w, kinds[2], kinds[5], kinds[3], kinds[4], kinds[6], len(seen), max(seen.values(), default=0),
        len(lines) - len(set(lines)), -(share * np.log2(share)).sum() * n, (mark[1:] & (data[1:] == data[:-1])).sum(), (sizes <= 3).sum() if w else 0, marks, counts[10], len(zlib.compress(text, 1)),
    ]
    out[1] = [0, 0, w, w, kinds[1] + kinds[2] + kinds[6], n, n, n, n, w, w, len(lines), n, n, w, w, w, n]
    return out.ravel()


def transformed(x: np.ndarray, usual: np.ndarray, weight: float) -> np.ndarray:
    """Statistics as rates with so much of the usual ones mixed in, closer to normal."""
    count, by = x[:, :FEATURES], x[:, FEATURES:]
    more = weight * _UNITS
    out = np.where(_UNITS > 0, (count + more * usual) / np.maximum(by + more, 1e-9), count)
    out[:, 3] = np.log1p(out[:, 3])
    out[:, _LOG] = np.log(np.maximum(out[:, _LOG], 1e-6))
    out[:, _ROOT] = np.sqrt(np.maximum(out[:, _ROOT], 0))
    return out


class Model:
    """Means and inverted Cholesky factors of two classes."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, usual: np.ndarray, weight: float, common: float, diagonal: float):
        """Per class 0 and 1: rows, sums of the transformed statistics, sums of their products."""
        self.usual, self.weight, self.common, self.diagonal = usual, weight, common, diagonal
        self.share = float(counts[1] / counts.sum()) if counts.sum() else 0.5
        self.ready = bool((counts >= 2).all())
        if not self.ready:
            return
        self.means = sums / counts[:, None]
        own = [squares[c] / counts[c] - np.outer(self.means[c], self.means[c]) for c in range(2)]
        both = (counts[0] * own[0] + counts[1] * own[1]) / counts.sum()
        floor = np.eye(len(both)) * (1e-6 + 1e-3 * np.diag(both))
        self.inverse, self.offset = [], []
        for c in range(2):
            cov = (1 - common) * own[c] + common * both
            cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + floor
            factor = np.linalg.cholesky(cov)
            self.inverse.append(np.linalg.inv(factor))
            self.offset.append(np.log(counts[c]) - np.log(np.diag(factor)).sum())

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1; x: transformed."""
        if not self.ready:
            return np.full(len(x), np.log(max(self.share, 1e-12) / max(1 - self.share, 1e-12)))
        density = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.means, self.inverse, self.offset)]
        return np.clip(density[1] - density[0], -500, 500)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of statistics."""
        return np.full(len(x), self.share) if not self.ready else 1 / (1 + np.exp(-self.margins(transformed(x, self.usual, self.weight))))


def _matrix(column) -> np.ndarray:
    texts = _tables.texts(column)
    return np.array([statistics(t) for t in texts]).reshape(len(texts), 2 * FEATURES)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


def _added(rows: DataFrame, add: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sums over all rows (label, fold, x) of what add(labels, folds, statistics) gives for some of them: size numbers."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += add(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).flatten().to_numpy().reshape(-1, 2 * FEATURES))
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(total)], names=["place", "value"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():  # as many rows as the models have numbers
        out[r.place] = r.value
    return out


def fit(docs: DataFrame, labels: DataFrame, *, grid: tuple[tuple[float, float, float], ...] = GRID) -> Model:
    """The model of all labelled rows that are not held out; grid: (weight, common, diagonal) to choose from."""

    def described(batches):
        for b in batches:
            x = _matrix(b.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 2 * FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch([b.column(0), flat], names=["doc_id", "x"])

    wanted = labels.where("quality in (0, 1)").select(F.col("doc_id"), F.col("quality").cast("int").alias("label"))
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out()).mapInArrow(described, "doc_id long, x array<double>")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    rows = cut(rows.join(wanted, "doc_id").select("label", fold.alias("fold"), "x"))

    totals = _added(rows, lambda label, fold, x: x.sum(0), 2 * FEATURES)
    usual = totals[:FEATURES] / np.maximum(totals[FEATURES:], 1)
    weights = sorted({w for w, _, _ in grid})
    width = 1 + FEATURES + FEATURES**2

    def moments(label, fold, x):
        out = np.zeros((len(weights), FOLDS, 2, width))
        for w, weight in enumerate(weights):
            z = transformed(x, usual, weight)
            for f in range(FOLDS):
                for c in range(2):
                    own = z[(label == c) & (fold == f)]
                    out[w, f, c] = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        return out.ravel()

    sums = _added(rows, moments, len(weights) * FOLDS * 2 * width).reshape(len(weights), FOLDS, 2, width)

    def model(part: np.ndarray, weight: float, common: float, diagonal: float) -> Model:
        return Model(part[:, 0], part[:, 1 : 1 + FEATURES], part[:, 1 + FEATURES :].reshape(2, FEATURES, FEATURES), usual, weight, common, diagonal)

    if len(grid) == 1:
        return model(sums[0].sum(0), *grid[0])
    tried = [[model(sums[weights.index(g[0])].sum(0) - sums[weights.index(g[0])][f], *g) for f in range(FOLDS)] for g in grid]

    def losses(label, fold, x):
        z = {w: transformed(x, usual, w) for w in weights}
        out = np.zeros(len(grid))
        for k, g in enumerate(grid):
            for f in range(FOLDS):
                m = fold == f
                if m.any():
                    out[k] += np.logaddexp(0, np.where(label[m] == 1, -1, 1) * tried[k][f].margins(z[g[0]][m])).sum()
        return out

    best = grid[int(np.argmin(_added(rows, losses, len(grid))))]
    return model(sums[weights.index(best[0])].sum(0), *best)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with a column score."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    rest = [c for c in docs.columns if c != "score"]

    def run(batches):
        for b in batches:
            yield pa.record_batch([*(b.column(c) for c in rest), pa.array(model.scores(_matrix(b.column("text"))))], names=[*rest, "score"])

    docs = docs.select(*rest)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _tables.read(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, _tables.read(spark, sf_dir, "labels", "doc_id", "quality"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_quality": op3_quality}
