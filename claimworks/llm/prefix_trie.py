"""Tries of the turns that conversations begin with, as LOUDS bit vectors by prefix shard.

Every conversation is rebuilt from the first turns of a host and its own later ones, and every sequence of first turns is a
node. A node's name is a 128-bit digest, the exclusive or of what each turn gives with its depth, so that the names along a
conversation are running values: turns are dealt by ranges of (conversation, turn), a conversation may span several ranges,
and a table of one row for each range carries numbers and running values from one to the next.

Nodes are counted by name in one aggregate. A node is heavy if more turns lie below it than a quarter of a block's share and
two conversations or more have it; all others hang in light subtrees, the prefix shards, none of which has more nodes than
that. (A single conversation's tail may be longer; it has no branches and is cut into pieces of that length.) Shards are
dealt by their top, and in each task numpy builds a forest in level order: the LOUDS bits (for every node its children as ones,
then a zero) and the arrays of labels. Parents are read off the bits by rank and select, and add.at over the levels, deepest
first, rolls leaves and tokens up. The heavy upper levels then take the sums of the shards below them, by the same code, in
bands of levels: at any depth there are at most four heavy nodes for each block, so a band is bounded and fits one task.

Defined results: null role or text is empty; turns that share a number are in the order of role, then of the digest of both;
repeated rows are repeated turns; a turn without a number is before all others; rows without conv_id belong to no
conversation and have no node; no conversation, no node (not even the root); further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from claimworks.llm import _tables
from claimworks.llm._grams import mixed
from claimworks.llm._lineage import cut

FAMILY, SHARED = 20, 4
#: Heavy nodes that one task takes, and rows of shards that a task builds at a time.
BAND, PIECE = 1 << 20, 1 << 16
#: Ids whose text is hashed as one piece.
IDS = 4096
_U = np.uint64
_ONE, _TWO = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_KEY = ["depth", "hi", "lo"]
_WORD = r"[^\x20\x09-\x0D]+"


def crc32(value: Column) -> Column:
    """Unsigned CRC-32 of the decimal digits, or of a text's UTF-8."""
    return F.crc32(value.cast("string").cast("binary"))


# Rebuilding.


def _labelled(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, label (16 bytes for role and text), words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    label = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return conversations.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), label.alias("label"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))


def _stream(turns: DataFrame) -> DataFrame:
    """A row for each turn (kind 1), after a row for its conversation (kind 0) that says what is put before it.

    skip: own turns that are left out; taken: turns of the host that come instead; len: turns of the rebuilt conversation.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "label")
    few = turns.withColumn("r", F.row_number().over(order)).where(F.col("r") < SHARED)  # limited before the shuffle
    heads = cut(few.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("r", "label", "words"))).alias("head")))
    infos = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("skip", crc32(F.col("conv_id")) % SHARED).withColumn("host", F.col("conv_id") - F.col("conv_id") % FAMILY)
    infos = infos.join(heads.select(F.col("conv_id").alias("host"), "head"), "host", "left").withColumn("taken", F.least("skip", F.coalesce(F.size("head"), F.lit(0)).cast("long")))
    turn = lambda i: F.when(F.col("taken") > i, F.get("head", F.lit(i)))
    inner = infos.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("label"), F.lit(0).cast("long").alias("words"), "skip", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("skip"), F.lit(0))).alias("len"), *[turn(i)[c].alias(f"{c}{i}") for i in range(SHARED - 1) for c in ("label", "words")])
    return inner.unionByName(turns.withColumn("kind", F.lit(1)), allowMissingColumns=True)


_STEP = pa.schema([(n, pa.int64()) for n in ("conv_id", "depth", "hi", "lo", "up_hi", "up_lo", "words", "len")] + [("part", pa.int32())])
_STEP_SQL = "conv_id long, depth long, hi long, lo long, up_hi long, up_lo long, words long, len long, part int"


def _digest(label: pa.Array, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What turns with these labels give at these depths; null labels give whatever is not asked for."""
    raw = np.frombuffer(b"".join(x if x is not None else bytes(16) for x in label.to_pylist()), _U).reshape(-1, 2)
    d = depth.astype(_U)
    return mixed(raw[:, 0] + mixed(d * _ONE)), mixed(raw[:, 1] + mixed(d * _TWO))


def _walk(batches: Iterator[pa.RecordBatch], carried: dict[int, tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """The nodes along each conversation. carried: for a range that begins within a conversation, the turns before it, skip, taken, len."""
    state, late = None, False  # k, skip, taken, len, hi, lo of the conversation that the last batch ended in; whether it began in an earlier range
    for b in batches:
        if not b.num_rows:
            continue
        col = lambda n: b.column(n).fill_null(0).to_numpy(zero_copy_only=False)  # noqa: E731, B023
        conv, kind, part = col("conv_id"), col("kind"), int(b.column("part")[0].as_py())
        if state is None:
            late = part in carried and kind[0] == 1
            state = [*carried[part], 0, 0] if late else [0] * 6
        at = np.arange(len(conv))
        head = np.maximum.accumulate(np.where(kind == 0, at, -1))
        own = head >= 0
        skip, taken, length = (np.where(own, col(n)[head], s) for n, s in zip(("skip", "taken", "len"), state[1:4]))
        k = np.where(own, at - head - 1, state[0] + at)
        depth = taken + k - skip + 1
        put = (kind == 1) & (k >= skip)
        hi, lo = (np.where(put, g, _U(0)) for g in _digest(b.column("label"), np.where(put, depth, 0)))
        out = []
        heads, up = at[kind == 0], [np.zeros((kind == 0).sum(), _U)] * 2
        if len(heads):
            zero = np.zeros(len(heads), np.int64)
            out.append((conv[heads], zero, *up, *up, zero, length[heads]))
            for i in range(SHARED - 1):
                has = taken[heads] > i
                g = [np.where(has, x, _U(0)) for x in _digest(b.column(f"label{i}").take(pa.array(heads)), np.full(len(heads), i + 1))]
                down = [x ^ y for x, y in zip(up, g)]
                out.append(tuple(x[has] for x in (conv[heads], zero + i + 1, *down, *up, col(f"words{i}")[heads], length[heads])))
                up = down
            hi[heads], lo[heads] = up
        every = [np.bitwise_xor.accumulate(x) for x in (hi, lo)]
        before = [np.where(own, np.where(head > 0, x[np.maximum(head - 1, 0)], _U(0)), _U(s)) for x, s in zip(every, state[4:])]
        now = [x ^ y for x, y in zip(every, before)]
        out.append(tuple(x[put] for x in (conv, depth, *now, now[0] ^ hi, now[1] ^ lo, col("words"), length)))
        parts = np.concatenate([np.full(len(o[0]), -1, np.int32) for o in out[:-1]] + [np.where(late & ~own[put], np.int32(part), np.int32(-1))])
        columns = [np.concatenate(x) for x in zip(*out)]
        yield pa.record_batch([pa.array(x.view(np.int64) if x.dtype == _U else x) for x in columns] + [pa.array(parts, pa.int32())], schema=_STEP)
        late = late and not own[-1]
        state = [int(k[-1]) + 1, int(skip[-1]), int(taken[-1]), int(length[-1]), int(now[0][-1]), int(now[1][-1])]


def steps(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, hi, lo (the node), up_hi, up_lo (its parent), words, len: the path of every rebuilt conversation, from the root."""
    spark = conversations.sparkSession
    order = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "label"]
    rows = cut(_stream(cut(_labelled(conversations))).repartitionByRange(_tables.blocks_wanted(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    runs = rows.groupBy("conv_id", "part").agg(F.count_if(F.col("kind") == 1).alias("n"), *[F.max(c).alias(c) for c in ("skip", "taken", "len")])
    spans = runs.withColumn("parts", F.count("*").over(Window.partitionBy("conv_id"))).where("parts > 1").orderBy("conv_id", "part").collect()  # two for each range at most
    carried, seen = {}, {}
    for r in spans:
        n, *info = seen.get(r.conv_id, (0, r.skip, r.taken, r.len))
        if r.conv_id in seen:
            carried[r.part] = (n, *info)
        seen[r.conv_id] = (n + r.n, *info)
    rows = rows.select("conv_id", "kind", "part", "label", "words", "skip", "taken", "len", *[f"{c}{i}" for i in range(SHARED - 1) for c in ("label", "words")])
    found = cut(rows.mapInArrow(lambda batches: _walk(batches, carried), _STEP_SQL))
    if not carried:
        return found.drop("part")
    # The running values of a conversation's earlier ranges are still to be added to those of the later ones.
    ends = found.join(F.broadcast(spark.createDataFrame([(c,) for c in seen], "conv_id long")), "conv_id").groupBy("conv_id", "part").agg(F.max(F.struct("depth", "hi", "lo")).alias("x")).orderBy("conv_id", "part").collect()  # two for each range at most
    fixes, total = [], {}
    for r in ends:
        hi, lo = total.get(r.conv_id, (0, 0))
        if r.part >= 0:
            fixes.append((r.conv_id, r.part, hi, lo))
        total[r.conv_id] = (hi ^ r.x.hi, lo ^ r.x.lo)
    if not fixes:
        return found.drop("part")
    fix = F.broadcast(spark.createDataFrame(fixes, "conv_id long, part int, x_hi long, x_lo long"))  # a row for each range at most
    mend = lambda c, x: F.col(c).bitwiseXOR(F.coalesce(x, F.lit(0).cast("long"))).alias(c)
    return found.join(fix, ["conv_id", "part"], "left").select("conv_id", "depth", *[mend(c, f"x_{c[-2:]}") for c in ("hi", "lo", "up_hi", "up_lo")], "words", "len")


# Tries.


@dataclass
class Louds:
    """A forest in level order: bits (packed; the tops' number as ones and a zero, then each node's children likewise), labels, rows, starts of levels."""

    bits: np.ndarray
    n: int
    labels: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray
    starts: np.ndarray

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, up_hi: np.ndarray, up_lo: np.ndarray, depth: np.ndarray) -> Louds:
        n = len(hi)
        # Numbers for names, so that each node finds its parent's row.
        d, a, b = np.concatenate([depth, depth - 1]), np.concatenate([hi, up_hi]), np.concatenate([lo, up_lo])
        order = np.lexsort((b, a, d))
        new = np.concatenate([[True], (d[order][1:] != d[order][:-1]) | (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
        number = np.empty(2 * n, np.int64)
        number[order] = np.cumsum(new) - 1
        row_of = np.full(2 * n, -1, np.int64)
        row_of[number[:n]] = np.arange(n)
        above = row_of[number[n:]]
        level = _levels(above, depth)
        by_level = np.argsort(level, kind="stable")
        starts = np.searchsorted(level[by_level], np.arange(level.max() + 2 if n else 1))
        place, rows = np.full(n, -1, np.int64), np.empty(n, np.int64)
        for s, e in zip(starts, starts[1:]):
            here = by_level[s:e]
            parent = np.where(above[here] < 0, -1, place[above[here]])
            here = here[np.lexsort((lo[here], hi[here], parent))]
            place[here] = np.arange(s, e)
            rows[s:e] = here
        degrees = np.bincount(np.where(above < 0, 0, place[above] + 1), minlength=n + 1)
        bits = np.ones(2 * n + 1, bool)
        bits[np.cumsum(degrees + 1) - 1] = False
        return cls(np.packbits(bits), n, (hi[rows], lo[rows]), rows, starts)

    def parents(self) -> np.ndarray:
        """The place of each node's parent, -1 of tops': the zeros before the node's one (rank of select)."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=2 * self.n + 1))
        return ones - np.arange(self.n) - 1

    def rolled(self, *values: np.ndarray) -> list[np.ndarray]:
        """Sums over each node's subtree, deepest level first; values and sums by row."""
        parent, out = self.parents(), []
        for value in values:
            total = value[self.rows].astype(np.int64)
            for s, e in reversed(list(zip(self.starts[1:], self.starts[2:]))):
                np.add.at(total, parent[s:e], total[s:e])
            back = np.empty(self.n, np.int64)
            back[self.rows] = total
            out.append(back)
        return out

    def degrees(self) -> tuple[np.ndarray, np.ndarray]:
        """By row: the number of children, the row of the parent (-1: none)."""
        parent = self.parents()
        n = np.empty(self.n, np.int64)
        n[self.rows] = np.bincount(parent + 1, minlength=self.n + 1)[1:]
        up = np.empty(self.n, np.int64)
        up[self.rows] = np.where(parent < 0, -1, self.rows[parent])
        return n, up


def _levels(above: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """How far each node is below the top of its tree: pointers to the parents are doubled until all are at a top."""
    to = np.where(above < 0, np.arange(len(above)), above)
    while True:
        further = to[to]
        if (further == to).all():
            return depth - depth[to]
        to = further


_OUT = "depth long, hi long, lo long, up_hi long, up_lo long, conv_id long, n_convs long, ends long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long, top boolean"
_OUT_ARROW = pa.schema([(x.split()[0], pa.bool_() if x.split()[1] == "boolean" else pa.int64()) for x in _OUT.split(", ")])


def _rolled(t: pa.Table) -> pa.RecordBatch:
    """The nodes of whole shards, or of a band, with what lies below them. more_*: what is known of children elsewhere."""
    v = {c: t.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for c in t.column_names}
    trie = Louds.build(v["hi"], v["lo"], v["up_hi"], v["up_lo"], v["depth"])
    children, up = trie.degrees()
    children = np.where(v["n_convs"] == 1, v["below"] > 0, children + v["more_children"])  # a tail's next piece may be another shard
    leaves, saved = trie.rolled(np.where((children == 0) | (v["n_convs"] == 1) & (trie.degrees()[0] == 0), 1, v["more_leaves"]), (v["n_convs"] - 1) * v["words"] + v["more_saved"])
    top = (up < 0) & (v["depth"] > 0) & (v["piece"] == 0)
    parent = np.where(up >= 0, v["conv_id"][up], v["conv_id"])  # a later piece's parent is in the same conversation
    none = top | (v["depth"] == 0)
    columns = [v[c] for c in ("depth", "hi", "lo", "up_hi", "up_lo", "conv_id", "n_convs", "ends")] + [children, leaves, saved]
    return pa.record_batch([pa.array(x.astype(np.int64)) for x in columns] + [pa.array(parent, mask=none), pa.array(top)], schema=_OUT_ARROW)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole shards at a time; rows come sorted by shard."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < PIECE:
            continue
        t = pa.Table.from_batches(held)
        key = [t.column(c).to_numpy() for c in ("top_hi", "top_lo", "piece")]
        edges = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0))
        if len(edges):
            end = int(edges[-1]) + 1
            yield _rolled(t.slice(0, end))
            held = t.slice(end).to_batches()
            n = t.num_rows - end
    if n:
        yield _rolled(pa.Table.from_batches(held))


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        yield _rolled(pa.Table.from_batches(held))


_MORE = ["more_children", "more_leaves", "more_saved"]


def _sums(tops: DataFrame) -> DataFrame:
    """What tops give to their parents."""
    return tops.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count("*").alias("more_children"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))


def rollup(path: DataFrame) -> DataFrame:
    """Every node of the paths that steps() gives: its columns, conv_id, n_convs, ends, n_children, n_leaves, saved_tokens, parent_conv_id."""
    spark = path.sparkSession
    blocks = _tables.blocks_wanted(spark)
    same = lambda c: F.max(c).alias(c)  # noqa: E731 - one value in a group
    counted = path.groupBy(*_KEY).agg(same("up_hi"), same("up_lo"), same("words"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("len") - F.col("depth")).alias("below"), F.count_if(F.col("len") == F.col("depth")).alias("ends"))
    nodes = cut(counted)
    root = nodes.where("depth = 0").first()
    if root is None:
        return spark.createDataFrame([], _OUT).drop("top")
    share = max(1, -(-root.below // (4 * blocks)))
    is_heavy = (F.col("below") > share) & (F.col("n_convs") > 1)
    heavy = cut(nodes.where(is_heavy))
    first = F.min(F.when(F.col("heavy").isNull(), F.struct(*_KEY))).alias("x")
    marks = path.select("conv_id", *_KEY).join(heavy.select(*_KEY, F.lit(1).alias("heavy")), _KEY, "left").groupBy("conv_id").agg(first)
    marks = cut(marks.where("x is not null").select("conv_id", F.col("x.depth").alias("top_depth"), F.col("x.hi").alias("top_hi"), F.col("x.lo").alias("top_lo")))
    none = [F.lit(0).cast("long").alias(c) for c in _MORE]
    light = nodes.where(~is_heavy).join(marks, "conv_id").withColumn("piece", F.expr(f"(depth - top_depth) div {share}")).select(*_KEY, "up_hi", "up_lo", "conv_id", "n_convs", "ends", "words", "below", "piece", "top_hi", "top_lo", *none)
    shard = ["top_hi", "top_lo", "piece"]
    parts = [cut(light.repartition(blocks, *shard).sortWithinPartitions(*shard).mapInArrow(_shards, _OUT))]
    more = _sums(parts[0].where("top"))
    levels = max(1, BAND // (4 * blocks))
    deepest = heavy.agg(F.max("depth")).first()[0]
    for b in range(deepest // levels, -1, -1) if deepest is not None else ():
        band = heavy.where(F.col("depth").between(b * levels, (b + 1) * levels - 1)).join(more, _KEY, "left").select(*_KEY, "up_hi", "up_lo", "conv_id", "n_convs", "ends", "words", "below", F.lit(0).alias("piece"), *_MORE)
        parts.append(cut(band.coalesce(1).mapInArrow(_band, _OUT)))  # at most BAND nodes
        if b:
            more = _sums(parts[-1].where("top")).unionByName(more).groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in _MORE])
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    above = heavy.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("found"))
    tops = every.where("top").join(above, ["depth", "up_hi", "up_lo"], "left").withColumn("parent_conv_id", F.col("found")).select(*[c.split()[0] for c in _OUT.split(", ")])
    return every.where(~F.col("top")).unionByName(tops).drop("top")


# Members that end at a node.

_CHUNK = "depth long, hi long, lo long, first long, ids string"
_CHUNK_ARROW = pa.schema([(n, pa.int64()) for n in ("depth", "hi", "lo", "first")] + [("ids", pa.string())])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined ids of stretches of rows of one node; rows come sorted."""
    for b in batches:
        if not b.num_rows:
            continue
        d, hi, lo, ids = (b.column(c).to_numpy() for c in (*_KEY, "conv_id"))
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
        ends = np.append(new[1:], len(ids))
        cuts = np.concatenate([np.arange(s, e, IDS) for s, e in zip(new, ends)]) if len(ids) > IDS else new
        texts = [",".join(map(str, ids[s:e].tolist())) for s, e in zip(cuts, np.append(cuts[1:], len(ids)))]
        yield pa.record_batch([pa.array(x[cuts]) for x in (d, hi, lo, ids)] + [pa.array(texts, pa.string())], schema=_CHUNK_ARROW)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node, over its pieces as they come, sorted; no node's ids are held."""
    key, state = None, None
    for b in batches:
        out = []
        for k, text in zip(zip(*(b.column(c).to_pylist() for c in _KEY)), b.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield _digests(out)
    if key is not None:
        yield _digests([(*key, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.record_batch([pa.array(x, pa.int64()) for x in columns[:3]] + [pa.array(columns[3], pa.string())], schema=pa.schema([(c, pa.int64()) for c in _KEY] + [("ends_sha256", pa.string())]))


def endings(path: DataFrame) -> DataFrame:
    """depth, hi, lo, ends_sha256 of the nodes at which conversations end.

    Ids are dealt by ranges of (node, id), so that a node where a third of all end is joined up by many tasks; one task then
    hashes its pieces in order, as they stream by.
    """
    blocks = _tables.blocks_wanted(path.sparkSession)
    order = [*_KEY, "conv_id"]
    pieces = path.where("len = depth").select(*order).repartitionByRange(blocks, *order).sortWithinPartitions(*order).mapInArrow(_joined, _CHUNK)
    return pieces.repartition(blocks, *_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_hashed, "depth long, hi long, lo long, ends_sha256 string")


def nodes(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    path = steps(conversations)
    every = rollup(path)
    ended = every.where("ends > 0").join(endings(path), _KEY).unionByName(every.where("ends = 0").withColumn("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return ended.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_prefix_trie": op11_prefix_trie}
ORACLE = {
    "op11_prefix_trie": r"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM (SELECT unnest(generate_series(0::BIGINT, 255::BIGINT)) AS i))),
own AS (SELECT conv_id, list({'k': md5(CAST(to_json([coalesce(role, ''), coalesce("text", '')]) AS VARCHAR)), 'w': len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+'))} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce("text", '')) AS ls FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, ls, conv_id - conv_id % 20 AS host, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 4 AS h FROM own, tab),
r AS (SELECT a.conv_id, list_concat(coalesce(b.ls, [])[1:a.h], a.ls[a.h + 1:]) AS ls FROM h a LEFT JOIN own b ON b.conv_id = a.host),
p AS (SELECT conv_id, ls, unnest(generate_series(0, len(ls))) AS depth FROM r),
s AS (SELECT conv_id, depth, len(ls) AS n, CASE WHEN depth = 0 THEN 0 ELSE ls[depth].w END AS w, list_transform(generate_series(0, depth), lambda d: d || ':' || md5(array_to_string(list_transform(ls[1:d], lambda x: x.k), ','))) AS keys FROM p),
n AS (SELECT keys[-1] AS key, any_value(keys) AS keys, any_value(keys[-2]) AS up, depth, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM s GROUP BY keys[-1], depth),
c AS (SELECT up AS key, count(*) AS n FROM n WHERE depth > 0 GROUP BY up),
a AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM n LEFT JOIN c USING (key)),
b AS (SELECT unnest(keys) AS key, n_children, (n_convs - 1) * w AS x FROM a),
t AS (SELECT key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(x) AS BIGINT) AS saved_tokens FROM b GROUP BY key)
SELECT a.conv_id, a.depth, u.conv_id AS parent_conv_id, a.n_convs, a.n_children, t.n_leaves, t.saved_tokens, a.ends_sha256 FROM a JOIN t USING (key) LEFT JOIN n u ON u.key = a.up AND a.depth > 0
"""
}
