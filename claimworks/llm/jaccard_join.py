"""Similarity join of documents by the Jaccard index of their five-word shingles: chosen-path splitting.

Documents with the same shingle set are one class of copies and are joined as one. A run is a tree: every set picks one of its
shingles, the one that comes first in the run's random order, and sets that picked the same shingle meet in a bucket. A bucket
of more than BUCKET sets is split again on each set's next pick, down to DEPTH picks. A set is one row of each run at every
level, so rows never exceed runs x sets; a run's picks for all levels travel in the row. Two sets of similarity s stay
together over k picks with probability s^k, so the number of runs follows from the target recall at DEPTH picks. Small
buckets are compared by brute force on sketches, with a margin of six standard deviations below the threshold. A part that keeps
the threshold's share of its bucket is as good as unsplit, its sets being alike, and is held together as it is, as is one that is still large after
DEPTH picks. What this ties together is a group of candidates. Each group's sets are then compared exactly, every pair once,
whole shingle sets against each other. A group of more than TILE sets is cut by size into bands, as the sizes of two similar sets
differ by the threshold at most, and each band into tiles; tiles of one band or of neighbouring bands meet, each pair in a task of its own.

No pairs are ever rows: buckets and tiles give a spanning forest and each set's number of links. The recall of the join is
that of the runs: TARGET for a pair right at the threshold whose buckets are all large, and 1 - (1 - s)^runs for one whose
buckets are small. What it reports is exact.

Defined results: words are what is left of a text between anything but A-Z, a-z, 0-9 and characters beyond ASCII, after
lower-casing A-Z; a text of fewer than five words has one shingle, all its words; texts without words (null, empty or
punctuation only) equal only the same text; repeated rows and rows sharing an id are separate documents; a class takes the
least doc_id in it; empty tables give empty tables; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimworks.llm import _grams, _tables
from claimworks.llm._components import components
from claimworks.llm._lineage import cut
from claimworks.llm.decontamination import _LETTER, _LOWER

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
TARGET = 0.999
BUCKET = 512
TILE = 512
DEPTH = 4
SKETCH = 64
PIECE = 1 << 20

_rng = np.random.default_rng(20)
_FACTOR = _rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def runs_for(threshold: float = float(THRESHOLD), target: float = TARGET, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has stayed together over so many picks with the target's probability."""
    return math.ceil(math.log(1 - target) / math.log(1 - threshold**depth))


def shingle_sets(column, shingle: int = SHINGLE):
    """For runs of texts: the first text's place and, for each, its distinct shingle hashes in ascending order."""
    data, offsets = _tables.utf8(column)
    for i, j in _grams.cuts(offsets, PIECE):
        part = _LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, first = _grams.words(part, offsets[i : j + 1] - offsets[i], _LETTER)
        h = _grams.word_hashes(part, starts, ends)
        whole = _grams.gram_hashes(h, shingle)
        sets = []
        for k, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if z - a >= shingle:
                sets.append(np.unique(whole[a : z - shingle + 1]))
            elif z > a:
                sets.append(_grams.gram_hashes(h[a:z], z - a) ^ np.uint64(z - a))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield i, sets, lambda k: data[offsets[k] : offsets[k + 1]].tobytes()


def _name(s: np.ndarray, text: Callable[[], bytes]) -> bytes:
    """Sixteen bytes that stand for a set; for a text without words, for the text."""
    if not len(s):
        import hashlib

        return hashlib.md5(text()).digest()
    a = _grams.mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = _grams.mixed(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64) ^ np.uint64(len(s))
    return a.tobytes() + b.tobytes()


def _sketch(s: np.ndarray) -> np.ndarray:
    out = np.empty(SKETCH, np.uint32)
    for i in range(0, SKETCH, 16):
        out[i : i + 16] = ((s[None, :] * _FACTOR[i : i + 16, None] + _SHIFT[i : i + 16, None]) >> np.uint64(32)).min(1)
    return out


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, name of the shingle set, its size, its first shingles under SKETCH random orders (none without words)."""

    def run(batches):
        for b in batches:
            names, sizes, firsts = [], [], []
            for top, sets, text in shingle_sets(b.column(1), shingle):
                for k, s in enumerate(sets):
                    names.append(_name(s, lambda: text(top + k)))
                    sizes.append(len(s))
                    firsts.append(_sketch(s).view(np.int32) if len(s) else np.zeros(0, np.int32))
            lengths = np.cumsum([0, *map(len, firsts)])
            picked = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *firsts])))
            yield pa.record_batch([b.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), picked], names=["doc_id", "name", "size", "picks"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, name binary, size long, picks array<int>")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Each node's root under these edges, the least node of its tree."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [root(x) for x in range(n)]


def _close(picks: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sketches that agree in so many places."""
    out_a, out_b = [], []
    step = max(1, (1 << 22) // max(1, picks.size))
    for i in range(0, len(picks), step):
        same = (picks[i : i + step, None, :] == picks[None, :, :]).sum(2) >= least
        a, b = np.nonzero(same)
        a += i
        out_a.append(a[a < b])
        out_b.append(b[a < b])
    return np.concatenate(out_a), np.concatenate(out_b)


def _groups(keys: np.ndarray):
    """Places of each key's rows, for keys with more than one."""
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.diff(keys[order])) + 1
    for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(order)]):
        if z - a > 1:
            yield order[a:z]


_EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _leaf_edges(least: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("name")  # so that buckets of the same sets have the same root
        keys = table.column("bucket").to_numpy()
        names = table.column("name").to_pylist()
        picks = table.column("picks").combine_chunks()
        picks = (picks.chunk(0) if isinstance(picks, pa.ChunkedArray) else picks).flatten().to_numpy().reshape(len(names), SKETCH)
        out = set()
        for rows in _groups(keys):
            for k, r in enumerate(_forest(len(rows), *_close(picks[rows], least))):
                if k != r:
                    out.add((names[rows[k]], names[rows[r]]))
        return pa.Table.from_pylist([{"a": x, "b": y} for x, y in sorted(out)], schema=_EDGES)

    return run


def candidate_groups(sets: DataFrame, *, threshold: Fraction = THRESHOLD, target: float = TARGET, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """node, root: groups of sets (columns name, picks) that hold all pairs which met and look alike.

    A bucket that is held together is tied to a node that stands for its head, of nine bytes and mostly less than any name, which
    may be a group's root. Small buckets of all levels get their sketches in one join, and of those seven bits a place are
    enough, as they agree wherever the picks do.
    """
    runs = runs_for(float(threshold), target, depth)
    if runs * depth > SKETCH:
        raise ValueError("the sketch is too short for so many runs and levels")
    deal = 4 * _tables.blocks_wanted(sets.sparkSession)
    s = float(threshold)
    least = math.floor(SKETCH * s - 6 * math.sqrt(SKETCH * s * (1 - s)))
    paths = F.array(*[F.slice("picks", r * depth + 1, depth) for r in range(runs)])
    rows = sets.where("size(picks) > 0").select("name", F.posexplode(paths).alias("r", "path")).select("name", "path", F.lit(1 << 62).alias("above"), F.xxhash64("r", F.col("path")[0]).alias("bucket"))
    leaves, whole = [], []
    for level in range(depth):
        last = level + 1 == depth
        sizes = cut(rows.groupBy("bucket").agg(F.count("*").alias("held"), F.min(F.xxhash64("name")).alias("head")).where("held > 1"))
        met = cut(rows.join(sizes, "bucket"))
        leaves.append(met.where(F.col("held") <= bucket).select("bucket", "name"))
        large = met.where(F.col("held") > bucket)
        split = F.lit(False) if last else F.col("held") < s * F.col("above")
        whole.append(large.where(~split).select(F.col("name").alias("a"), F.concat(F.lit(b"\0"), F.unhex(F.lpad(F.hex("head"), 16, "0"))).alias("b")))
        if last:
            break
        rows = large.where(split).select("name", "path", F.col("held").alias("above"), F.xxhash64("bucket", F.col("path")[level + 1]).alias("bucket"))
        if rows.isEmpty():
            break
    short = F.transform("picks", lambda x: x.bitwiseAND(F.lit(127)).cast("tinyint")).alias("picks")
    met = reduce(DataFrame.unionByName, leaves).join(sets.select("name", short), "name")
    found = met.select("bucket", "name", "picks", F.pmod(F.xxhash64("bucket"), F.lit(deal)).alias("deal")).groupBy("deal").applyInArrow(_leaf_edges(least), "a binary, b binary")
    return components(reduce(DataFrame.unionByName, whole, found))


def _shared(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections, of the sets with each other or with others."""
    every = sets + (others or [])
    if len(every) == 2:
        both = len(np.intersect1d(*every, assume_unique=True))
        return np.array([[both]]) if others else np.array([[len(sets[0]), both], [both, len(sets[1])]])
    tokens, place, n = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(every)), list(map(len, every)))
    kept = n[place] > 1
    column = (np.cumsum(n > 1) - 1)[place[kept]]
    owner = owner[kept]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    k = len(sets)
    total = np.zeros((k, len(others) if others else k), np.float64)
    wide = 4096
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, z = np.searchsorted(column, [c, c + wide])
        m = np.zeros((len(every), wide), np.float32)
        m[owner[a:z], column[a:z] - c] = 1
        total += m[:k] @ (m[k:] if others else m).T
    return total.astype(np.int64)


def _verify(threshold: Fraction):
    up, down = threshold.numerator, threshold.denominator

    def run(table: pa.Table) -> pa.Table:
        keys = list(zip(*(table.column(c).to_pylist() for c in ("root", "low", "high"))))
        names, mine, sets = table.column("name").to_pylist(), table.column("tile").to_pylist(), [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        groups: dict[tuple, dict[bytes, int]] = {}
        for k, key in enumerate(keys):
            groups.setdefault(key, {})[names[k]] = k
        out = []
        for (_, i, j), held in groups.items():
            left = [k for _, k in sorted(held.items()) if mine[k] == i]
            right = [k for _, k in sorted(held.items()) if mine[k] == j] if i != j else []
            if i != j and not (left and right):
                continue
            a, b = [sets[k] for k in left], [sets[k] for k in right]
            both = _shared(a, b) if i != j else _shared(a) if len(a) > 1 else np.array([[len(a[0])]])
            size_a = np.array(list(map(len, a)))
            size_b = np.array(list(map(len, b))) if i != j else size_a
            near = down * both >= up * (size_a[:, None] + size_b[None, :] - both)
            if i == j:
                np.fill_diagonal(near, False)
            x, y = np.nonzero(near)
            rows = left + right
            if i == j:
                links = near.sum(1).tolist()
                root = _forest(len(rows), x[x < y], y[x < y])
            else:
                links = near.sum(1).tolist() + near.sum(0).tolist()
                root = _forest(len(rows), x, y + len(left))
            out += [(names[k], int(n), names[rows[r]]) for k, n, r in zip(rows, links, root) if n]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), _LINKS.types)], schema=_LINKS) if out else _LINKS.empty_table()

    return run


_LINKS = pa.schema([("name", pa.binary()), ("links", pa.int64()), ("tree", pa.binary())])


def _member_sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """name, set of each member (columns name, rep_id and others), from the text of one of its documents."""
    joined = docs.select("doc_id", "text").join(members.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep_id"))).drop("doc_id", "rep_id")
    rest = [c for c in joined.columns if c != "text"]

    def run(batches):
        for b in batches:
            want, keep, sets = b.column("name").to_pylist(), [], []
            for top, found, text in shingle_sets(b.column("text"), shingle):
                for k, s in enumerate(found):
                    if _name(s, lambda: text(top + k)) == want[top + k]:
                        keep.append(top + k)
                        sets.append(s.tobytes())
            part = b.select(rest).take(pa.array(keep, pa.int64()))
            yield pa.record_batch([*part.columns, pa.array(sets, pa.binary())], names=[*rest, "set"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return joined.select("text", *rest).mapInArrow(run, StructType([*joined.select(*rest).schema.fields, StructField("set", BinaryType())]))


def _tile_pairs(members: DataFrame, tile: int) -> DataFrame:
    """Members (columns name, rep_id, root, band) with their tile and the pairs of tiles they meet in.

    A group of a tile's sets is one tile, -1. A larger one is cut into bands, whose sizes differ by less than the threshold, so
    that similar sets are in one band or in neighbouring ones; tiles are numbered by band and by a hash of the name. A group has
    as few bands as its sizes have powers of the threshold between them, so that a window over them is short.
    """
    wide = F.lit(1 << 32)
    group = Window.partitionBy("root")
    counts = members.groupBy("root", "band").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(group)).where(F.col("all") > tile)
    tiles = counts.select("root", "band", F.ceil(F.col("n") / tile).cast("long").alias("tiles"))

    def beside(at, step):
        ordered = group.orderBy("band")
        return F.when(at("band").over(ordered) == F.col("band") + step, at("tiles").over(ordered))

    plan = cut(tiles.select("root", "band", "tiles", beside(F.lag, -1).alias("below"), beside(F.lead, 1).alias("beyond")))
    at = members.join(plan, ["root", "band"], "left")
    own = F.col("band") * wide + F.pmod(F.xxhash64("name"), F.col("tiles"))

    def meets(band, n):
        other = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: band * wide + j)
        pair = lambda j: F.struct(F.least("tile", j).alias("low"), F.greatest("tile", j).alias("high"))
        return F.when(n > 0, F.transform(other, pair)).otherwise(F.array().cast("array<struct<low:bigint,high:bigint>>"))

    every = F.concat(meets(F.col("band"), F.col("tiles")), meets(F.col("band") + 1, F.col("beyond")), meets(F.col("band") - 1, F.col("below")))
    alone = F.array(F.struct(F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high")))
    return at.withColumn("tile", F.coalesce(own, F.lit(-1).cast("long"))).select("name", "rep_id", "root", "tile", F.when(F.col("tiles").isNull(), alone).otherwise(every).alias("meets"))


def similarity_classes(docs: DataFrame, *, threshold: Fraction = THRESHOLD, target: float = TARGET, shingle: int = SHINGLE, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every document.

    class_id: the least doc_id among the documents that links and copies lead to; n_links: how many different shingle sets
    have the threshold's similarity with this one's or more; n_copies: how many documents have this very set.
    """
    return set_classes(docs, threshold=threshold, target=target, shingle=shingle, bucket=bucket, tile=tile).select("doc_id", "class_id", "n_links", "n_copies")


def set_classes(docs: DataFrame, *, threshold: Fraction = THRESHOLD, target: float = TARGET, shingle: int = SHINGLE, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """similarity_classes() with name, the document's shingle set, and root, the least set of its class."""
    spark = docs.sparkSession
    every = cut(sketches(docs, shingle))
    sets = cut(every.groupBy("name").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("picks").alias("picks")))
    groups = candidate_groups(sets, threshold=threshold, target=target, bucket=bucket)
    band = F.floor(F.log("size") / -math.log(threshold)).cast("long").alias("band")
    members = cut(groups.join(sets.select(F.col("name").alias("node"), "rep_id", "size"), "node").select(F.col("node").alias("name"), "root", "rep_id", band))
    pairs = _tile_pairs(members, tile)
    held = _member_sets(docs, pairs, shingle).select("name", "set", "root", "tile", F.explode("meets").alias("x")).select("name", "set", "root", "tile", "x.low", "x.high")
    deal = F.when(F.col("tile") >= 0, F.xxhash64("root", "low", "high")).otherwise(F.pmod(F.xxhash64("root"), F.lit(4 * _tables.blocks_wanted(spark))))
    found = cut(held.withColumn("deal", deal).groupBy("deal").applyInArrow(_verify(threshold), "name binary, links long, tree binary"))
    links = found.groupBy("name").agg(F.sum("links").alias("n_links"))
    trees = components(found.select(F.col("name").alias("a"), F.col("tree").alias("b")))
    named = cut(sets.drop("picks", "size").join(links, "name", "left").join(trees.withColumnRenamed("node", "name"), "name", "left").select("name", "rep_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "name").alias("root")))
    least = cut(named.groupBy("root").agg(F.min("rep_id").alias("class_id")))  # written first, so that a large class is split in the join
    return every.select("doc_id", "name").join(named.join(least, "root").select("name", "root", "class_id", "n_links", "n_copies"), "name").select("doc_id", "name", "root", "class_id", "n_links", "n_copies")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(_tables.read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_jaccard_join": op2_jaccard_join}
ORACLE = {
    "op2_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN ['#' || t] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
k AS (SELECT doc_id, g, md5(array_to_string(list_sort(g), chr(10))) AS name FROM s),
sets AS (SELECT name, any_value(g) AS g, min(doc_id) AS rep, count(*) AS n_copies FROM k GROUP BY name),
tokens AS (SELECT name, len(g) AS n, unnest(g) AS x FROM sets),
shared AS (SELECT a.name AS a, b.name AS b, a.n AS n, b.n AS m, count(*) AS c FROM tokens a JOIN tokens b ON a.x = b.x AND a.name <> b.name GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 5 * c >= 4 * (n + m - c)),
reach AS (SELECT name AS node, rep AS label FROM sets UNION SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.node),
classes AS (SELECT node AS name, min(label) AS class_id FROM reach GROUP BY node),
degrees AS (SELECT a AS name, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, n_copies FROM k JOIN sets USING (name) JOIN classes USING (name) LEFT JOIN degrees USING (name)
"""
}
