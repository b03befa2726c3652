"""Substring removal by a distributed merge sort of suffixes that never compares a known prefix twice.

Sorting a suffix for every byte would move many times the input, so the sort is over sampled suffixes, and the sample is such
that nothing is lost: every window of LENGTH bytes chooses as its anchor the position with the least hash among its GRAM-byte
strings, the leftmost on ties. Equal windows choose the same relative anchor, so a window can only repeat where its anchor's
string does. One exchange of packed hashes tells each block which of its anchors repeat at all.

The suffixes at those anchors are sorted in their block and written as front-coded runs: the length of the prefix shared with
the suffix before, then the rest. A suffix's sort key begins with the hash of its GRAM-byte string, which makes equal ranges
of the key equally full without a sample. Each reducer gets one range of every run and merges the runs with a loser tree that
keeps the common-prefix length of every contestant with the last winner, so that contestants of unequal lengths are decided
without looking at the text, and others from the first unknown byte on. The merged order and its common-prefix lengths say
which windows have equal bytes from the anchor on; a sort of the bytes before the anchors says the same for the other side.
Windows equal on both sides are the same string, and all but the earliest are removed.

Hot groups: a block sends each distinct surrounding of an anchor once, so a group of copies puts one suffix per block and
distinct surrounding into the exchange, and nothing is ever done for each pair of copies. The windows of hot anchors are
divided (see _repeats); their keys begin with a hash of what a division's windows have in common instead.

Defined results: null and empty texts are empty; rows that share a doc_id are separate documents, in the order of their
texts; a null doc_id comes before all others; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from claimworks.llm import _grams, _repeats, _tables

LENGTH = 100
GRAM = 32
PIECE = 1 << 19
_LOW = np.uint64((1 << 24) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93)]
#: Distances between a window's start and its anchor that hot anchors' windows are divided by.
STEP = 12
_WEIGHTS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_AGAIN = np.uint64(0xD1B54A32D192ED03)
_HEAD = 8  # bytes of the hash before the suffix in a sort key
_NO_ID = -(1 << 63)


def _in_order(table: pa.Table) -> pa.Table:
    """The block's rows in an order that does not depend on how they arrived."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _segments(offsets: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Bounds of texts in runs of about a piece; a longer text in overlapping parts that share no window."""
    for i, j in _grams.cuts(offsets, PIECE):
        if offsets[j] - offsets[i] <= 4 * PIECE:
            yield offsets[i : j + 1]
        else:
            for s in range(int(offsets[i]), int(offsets[j]) - length + 1, PIECE):
                yield np.array([s, min(s + PIECE + length - 1, int(offsets[j]))])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of the texts: place, first and last window that chose it, hash of its gram."""
    out = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]]
    for bounds in _segments(offsets, length):
        base, n = int(bounds[0]), int(bounds[-1] - bounds[0])
        if n < length:
            continue
        part = np.zeros(n + 16, np.uint8)
        part[:n] = data[base : base + n]
        eight = np.empty(n + 8, np.uint64)
        for s in range(8):
            count = (n + 8 - s + 7) // 8
            eight[s::8] = part[s : s + 8 * count].view("<u8") if s + 8 * count <= n + 16 else np.append(part[s:], np.zeros(8, np.uint8))[: 8 * count].view("<u8")
        last = n - gram + 1
        h = eight[:last] * _ODD[0]
        for j in range(1, gram // 8):
            h ^= h >> np.uint64(29)
            h += eight[8 * j : 8 * j + last] * _ODD[j % len(_ODD)]
        h = _grams.mixed(h)
        least = _grams.least_in_windows((h & ~_LOW) | np.arange(last, dtype=np.uint64), length - gram + 1)
        ends = np.repeat(bounds[1:] - base, np.diff(bounds))[: n - length + 1]
        p = np.flatnonzero(np.arange(n - length + 1) + length <= ends)
        if not len(p):
            continue
        a = (least[p] & _LOW).astype(np.int64)
        new = np.flatnonzero(np.diff(a)) + 1
        first = np.append(0, new)
        final = np.append(new - 1, len(p) - 1)
        out.append([a[first] + base, p[first] + base, p[final] + base, _grams.mixed(h[a[first]] ^ _AGAIN)])  # the least of many are not even, which ranges need
    return tuple(np.concatenate(x) for x in zip(*out))


def _gather(data: np.ndarray, at: np.ndarray, count: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of bytes: count of them from each place on, forwards or backwards, then zeros."""
    out = np.zeros((len(at), width), np.uint8)
    reach = np.arange(width)
    for i in range(0, len(at), 1 << 14):
        j = i + (1 << 14)
        place = np.clip(at[i:j, None] + step * reach, 0, len(data) - 1)
        out[i:j] = np.where(reach < count[i:j, None], data[place], 0)
    return out


def _common(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the row before; 0 for the first."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    return np.append(0, np.where(differ.any(1), differ.argmax(1), rows.shape[1]))


def _sorted(rows: np.ndarray) -> np.ndarray:
    """Stable order of rows of bytes."""
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


def runs_of_block(table: pa.Table, back: pa.Table, buckets: int, length: int = LENGTH, gram: int = GRAM) -> pa.Table:
    """The block's front-coded sorted runs, one for each reducer, and the windows that repeat within the block alone."""
    if not table.num_rows:
        return _RUNS.empty_table()
    block = table.column("block")[0].as_py()
    table = _in_order(table)
    data, offsets = _tables.utf8(table.column("text"))
    doc = np.array([_NO_ID if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
    at, low, high, h = anchors(data, offsets, length, gram)
    chosen, _ = _grams.found_in(_repeats.gathered(back), h)
    at, low, high, h = at[chosen], low[chosen], high[chosen], h[chosen]
    if not len(at):
        return _RUNS.empty_table()

    def shared(places: np.ndarray, near: int, far: int) -> np.ndarray:
        out = np.empty(len(places), np.uint64)
        reach = np.arange(-near, length - far)
        for i in range(0, len(places), 1 << 14):
            out[i : i + (1 << 14)] = ((data[places[i : i + (1 << 14), None] + reach] + np.uint64(1)) * _WEIGHTS[: len(reach)]).sum(1, dtype=np.uint64)
        return out

    at, low, high, h = _repeats.divided(back, at, low, high, h, length - gram + 1, STEP, shared)
    row = np.searchsorted(offsets, low, "right") - 1
    least, most = at - high, at - low  # of the bytes between a window's start and its anchor
    side = length - gram
    wide = _HEAD + length
    rows = np.empty((len(at), wide + side + 2), np.uint8)
    rows[:, :_HEAD] = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    rows[:, _HEAD:wide] = _gather(data, at, length - least, length, 1)
    rows[:, wide : wide + side] = _gather(data, at - 1, most, side, -1)
    rows[:, -2], rows[:, -1] = least, most
    order = _sorted(rows)
    rows = rows[order]
    again = np.append(False, (rows[1:] == rows[:-1]).all(1)) if len(rows) > 1 else np.zeros(len(rows), bool)
    mine = order[again]
    out = [(int(block % buckets), block, 1, _repeats.packed(row[mine], low[mine] - offsets[row[mine]], high[mine] + length - offsets[row[mine]]))]
    rows, order = rows[~again], order[~again]
    to = _repeats.bucket_of(h[order], buckets)
    edges = np.flatnonzero(np.diff(to)) + 1
    reach, back_reach = np.arange(wide), np.arange(side)
    for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(order)]):
        o, part = order[a:z], rows[a:z]
        shared = _common(part[:, :wide])
        rest = part[:, :wide][(reach >= shared[:, None]) & (reach < (wide - least[o])[:, None])]
        left = part[:, wide : wide + side][back_reach < most[o][:, None]]
        out.append((int(to[a]), block, 0, _repeats.packed(shared.astype(np.uint8), rest.tobytes(), left.tobytes(), least[o].astype(np.uint8), most[o].astype(np.uint8), doc[row[o]], row[o].astype(np.int32), at[o] - offsets[row[o]])))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), _RUNS.types)], schema=_RUNS)


_RUNS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_SPANS = pa.schema([("block", pa.int32()), ("payload", pa.binary())])


def unfolded(shared: list[int], rest: bytes, sizes: list[int], wide: int) -> list[bytes]:
    """The strings of a front-coded run, zeros after their end."""
    out, before, at = [], b"", 0
    for s, size in zip(shared, sizes):
        n = max(0, size - s)
        before = (before[:s] + rest[at : at + n]).ljust(wide, b"\0")
        at += n
        out.append(before)
    return out


def merge(runs: list[tuple[list[int], list[bytes]]], wide: int) -> tuple[list[int], list[int]]:
    """Merges sorted runs (common-prefix lengths, strings of one width): places in the runs put end to end, and the
    common-prefix length of each string with the one before it in the merged order.

    A loser tree over the runs. known[r] is the common-prefix length of run r's next string with the last winner. The string
    with the longer known prefix is the smaller; of equal lengths, bytes are compared from there on, and the loser keeps the
    length that the comparison found.
    """
    k = len(runs)
    tops = [0] * k
    for r in range(1, k):
        tops[r] = tops[r - 1] + len(runs[r - 1][1])
    heads: list[bytes | None] = [strings[0] if strings else None for _, strings in runs]
    known, next_at = [0] * k, [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        i, j = known[a], known[b]
        if i != j:
            return (a, b) if i > j else (b, a)
        while i < wide:
            p, q = x[i : i + 16], y[i : i + 16]
            if p != q:
                differ = int.from_bytes(p, "big") ^ int.from_bytes(q, "big")
                i += len(p) - (differ.bit_length() + 7 >> 3)
                if p < q:
                    known[b] = i
                    return a, b
                known[a] = i
                return b, a
            i += 16
        known[b] = wide
        return a, b

    size = 1 << max(0, (k - 1).bit_length())
    losers, winners = [-1] * size, [-1] * (2 * size)
    winners[size : size + k] = range(k)
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, -1) if b < 0 else play(a, b)
    best = winners[1]
    order, common = [], []
    while heads[best] is not None:
        order.append(tops[best] + next_at[best])
        common.append(known[best])
        next_at[best] += 1
        shared, strings = runs[best]
        if next_at[best] < len(strings):
            heads[best], known[best] = strings[next_at[best]], shared[next_at[best]]
        else:
            heads[best] = None
        node = (best + size) >> 1
        while node:
            if losers[node] >= 0:
                best, losers[node] = play(best, losers[node])
            node >>= 1
    return order, common


def later_windows(common: np.ndarray, left: np.ndarray, least: np.ndarray, most: np.ndarray, age: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For suffixes in sorted order, by bytes before the anchor: whether an older suffix has the same window there."""
    n, side = len(common), length - gram
    found = np.zeros((n, side + 1), bool)
    group = np.cumsum(common < _HEAD + gram)
    many = np.bincount(group, minlength=1)[group] > 1
    by_left = _sorted(left)
    left_common = _common(left[by_left])
    oldest = np.argsort(age, kind="stable")
    oldest = oldest[many[oldest]]
    place = np.empty(n, np.int64)
    for o in range(side + 1):
        rows = oldest[(least[oldest] <= o) & (most[oldest] >= o)]
        if len(rows) < 2:
            continue
        right = np.cumsum(common < _HEAD + length - o)
        place[by_left] = np.cumsum(left_common < o)
        _, first = np.unique(right[rows] * (n + 1) + place[rows], return_index=True)
        again = np.ones(len(rows), bool)
        again[first] = False
        found[rows[again], o] = True
    return found


def merge_bucket(table: pa.Table, length: int = LENGTH, gram: int = GRAM) -> pa.Table:
    """Merges the runs of one range of keys and says, by block, which stretches are covered by a window that starts earlier too."""
    wide, side = _HEAD + length, length - gram
    out, runs, parts, blocks = [], [], [], []
    for block, kind, payload in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "payload"))):
        if kind:
            out.append((block, payload))
            continue
        shared, rest, left, least, most, doc, row, at = _repeats.unpacked(payload)
        runs.append((shared.tolist(), unfolded(shared.tolist(), rest, (wide - least.astype(int)).tolist(), wide)))
        lefts = np.zeros((len(most), side), np.uint8)
        lefts[np.arange(side) < most[:, None]] = np.frombuffer(left, np.uint8)
        parts.append((lefts, least, most, doc, row, at))
        blocks.append(np.full(len(least), block))
    if runs:
        order, common = merge(runs, wide)
        order = np.array(order)
        lefts, least, most, doc, row, at = (np.concatenate(x)[order] for x in zip(*parts))
        block = np.concatenate(blocks)[order]
        age = np.empty(len(order), np.int64)
        age[np.lexsort((at, row, doc))] = np.arange(len(order))
        found = later_windows(np.array(common), lefts, least.astype(int), most.astype(int), age, length, gram)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        who, near = np.nonzero(edge == 1)
        _, far = np.nonzero(edge == -1)
        for b in np.unique(block[who]):
            k = block[who] == b
            out.append((int(b), _repeats.packed(row[who[k]].astype(np.int64), at[who[k]] - far[k] + 1, at[who[k]] - near[k] + length)))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), _SPANS.types)], schema=_SPANS) if out else _SPANS.empty_table()


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches by row; those that touch become one."""
    if not len(row):
        return row, start, end
    big = int(end.max()) + 2
    order = np.argsort(row * big + start, kind="stable")
    s, e = (row * big + start)[order], np.maximum.accumulate((row * big + end)[order])
    new = np.append(True, s[1:] > e[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return s[new] // big, s[new] % big, e[last] % big


def cut_block(table: pa.Table, spans: pa.Table, *, keep_text: bool = False) -> pa.Table:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of a block's documents; and what is kept, if wanted."""
    table = _in_order(table)
    content = _tables.texts(table.column("text"))
    found = [_repeats.unpacked(x) for x in spans.column("payload").to_pylist()]
    row, start, end = merged(*(np.concatenate(x).astype(np.int64) for x in zip(*found))) if found else (np.zeros(0, np.int64),) * 3
    first = np.searchsorted(row, np.arange(len(content) + 1)).tolist()
    start, end = start.tolist(), end.tolist()
    removed, digests, kept = [], [], []
    for i, text in enumerate(content):
        a, z = first[i], first[i + 1]
        rest = text if a == z else b"".join([text[x:y] for x, y in zip([0, *end[a:z]], [*start[a:z], len(text)])])
        removed.append(len(text) - len(rest))
        digests.append(hashlib.sha256(rest).hexdigest())
        if keep_text:
            kept.append(rest)
    out = {"doc_id": table.column("doc_id"), "n_bytes": pa.array(list(map(len, content)), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(np.diff(first), pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if keep_text else {}))


def remove_repeats(docs: DataFrame, *, keep_text: bool = False, length: int = LENGTH, gram: int = GRAM, hot: int = _repeats.HOT) -> DataFrame:
    """What is left of every document without the bytes of strings of this length that start earlier too."""
    if gram % 8 or not 8 <= gram < length <= 255:
        raise ValueError("the gram takes a multiple of 8 bytes, fewer than the length; the length at most 255")
    blocks = 2 * _tables.blocks_wanted(docs.sparkSession)
    rows = _tables.with_block(docs.select("doc_id", "text"), "doc_id", blocks)

    def hashes(table):
        return anchors(*_tables.utf8(_in_order(table).column("text")), length, gram)[3]

    back = _repeats.repeated(rows, hashes, blocks, hot)
    runs = rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(lambda t, b: runs_of_block(t, b, blocks, length, gram), "bucket int, block int, kind int, payload binary")
    spans = runs.repartition(blocks, "bucket").groupBy("bucket").applyInArrow(lambda t: merge_bucket(t, length, gram), "block int, payload binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return rows.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(lambda t, s: cut_block(t, s, keep_text=keep_text), schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_tables.read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLE = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, j, substr(h, 2 * j + 1, 2 * 599) AS h FROM (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 100, 500)) AS j FROM d WHERE len(h) >= 200)),
starts AS (SELECT doc_id, j, h, unnest(generate_series(0, least(499, len(h) // 2 - 100))) AS k FROM pieces WHERE len(h) >= 200),
windows AS (SELECT doc_id, j + k AS i, md5_number(substr(h, 2 * k + 1, 200)) AS s FROM starts),
firsts AS (SELECT s, min(CAST(doc_id AS HUGEINT) * 4294967296 + i) AS f FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE CAST(doc_id AS HUGEINT) * 4294967296 + i <> f),
steps AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM gone),
islands AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM steps),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM islands GROUP BY doc_id, n),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
rest AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS h, sum(z - a) AS n_removed, count(*) AS n_spans FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest.h, d.h))) AS kept_sha256
FROM d LEFT JOIN rest USING (doc_id)
"""
}
