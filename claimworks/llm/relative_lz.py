"""Passage removal by relative Lempel-Ziv parsing of documents against indexed reference blocks.

A reference block is a set of passages with an index of all their word sequences, and a document is parsed against every
block that could hold a match of it. Which blocks could is known beforehand: every window of WINDOW words chooses as its
anchor the run of GRAM words with the least hash in it, the leftmost on ties. Equal windows choose the same relative anchor,
and a block owns a range of anchor hashes, so a window's copies are all in the block that owns its anchor. One exchange of
packed hashes says which anchors occur more than once; only the passages around those are sent, each being the words of the
consecutive windows with that anchor. Together they are the reference and the documents to parse.

A block's index is the order of all window starts by the words that follow, made from classes of equal runs of 1, 2, 4 ... 32
words; the longest match at a word is with a neighbour in that order. Passages are factored greedily: a factor is the longest
match at its first word, the next begins where it ends, and nothing within a factor is looked up on the way. Windows inside a
factor are duplicates. Windows that cross the end of one are looked up by themselves, and no others are.

Hot groups: a block of documents sends equal passages once and settles them itself, so a passage with many copies costs one
row per block of documents, and nothing is ever done for each pair of copies. The windows of hot anchors are divided by how
far before the anchor they start (see _repeats), and each division goes by a hash of the words that its windows share.

Defined results: words are runs of anything but ASCII white space; null and empty texts have none; rows that share a doc_id
are separate documents; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from claimworks.llm import _grams, _repeats, _tables
from claimworks.llm.suffix_dedup import _in_order, merged

WINDOW = 35
GRAM = 12
#: Distances between a window's first word and its anchor that hot anchors' windows are divided by.
STEP = 6
PIECE = 1 << 19
_AGAIN = np.uint64(0xD1B54A32D192ED03)
_LOW = np.uint64((1 << 24) - 1)
_WEIGHTS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER = np.ones(256, bool)
_LETTER[[9, 10, 11, 12, 13, 32]] = False

_PASSAGES = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_SPANS = pa.schema([("block", pa.int32()), ("payload", pa.binary())])


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts, word ends, first word of each text, word hashes."""
    data, offsets = _tables.utf8(table.column("text"))
    starts, ends, first, hashes, count = [], [], [np.zeros(1, np.int64)], [], 0
    for i, j in _grams.cuts(offsets, PIECE):
        part = data[offsets[i] : offsets[j]]
        s, e, f = _grams.words(part, offsets[i : j + 1] - offsets[i], _LETTER)
        hashes.append(_grams.word_hashes(part, s, e))
        starts.append(s + offsets[i])
        ends.append(e + offsets[i])
        first.append(f[1:] + count)
        count += len(s)
    if not hashes:
        return data, *(np.zeros(0, np.int64),) * 2, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64)
    return data, np.concatenate(starts), np.concatenate(ends), np.concatenate(first), np.concatenate(hashes)


def anchors(h: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of all windows: first word of the gram, first and last window that chose it, hash of the gram."""
    out = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]]
    valid = _grams.inside(first, len(h), window)
    for s in range(0, len(valid), PIECE):
        p = np.flatnonzero(valid[s : s + PIECE])
        if not len(p):
            continue
        g = _grams.gram_hashes(h[s : s + PIECE + window - 1], gram)
        least = _grams.least_in_windows((g & ~_LOW) | np.arange(len(g), dtype=np.uint64), window - gram + 1)
        a = (least[p] & _LOW).astype(np.int64)
        new = np.flatnonzero(np.diff(a)) + 1
        begin, final = np.append(0, new), np.append(new - 1, len(p) - 1)
        out.append([a[begin] + s, p[begin] + s, p[final] + s, _grams.mixed(g[a[begin]] ^ _AGAIN)])  # the least of many are not even, which ranges need
    return tuple(np.concatenate(x) for x in zip(*out))


def passages_of_block(table: pa.Table, back: pa.Table, buckets: int, window: int = WINDOW, gram: int = GRAM) -> pa.Table:
    """The block's distinct passages around repeated anchors, for each reference block, and what repeats within it alone."""
    if not table.num_rows:
        return _PASSAGES.empty_table()
    block = table.column("block")[0].as_py()
    data, starts, ends, first, h = _words(_in_order(table))
    at, low, high, g = anchors(h, first, window, gram)
    chosen, _ = _grams.found_in(_repeats.gathered(back), g)
    at, low, high, g = at[chosen], low[chosen], high[chosen], g[chosen]
    if not len(at):
        return _PASSAGES.empty_table()

    def shared(places: np.ndarray, near: int, far: int) -> np.ndarray:
        out = np.zeros(len(places), np.uint64)
        for k, step in enumerate(range(-near, window - far)):
            out += h[places + step] * _WEIGHTS[k % len(_WEIGHTS)] + np.uint64(k)
        return out

    at, low, high, g = _repeats.divided(back, at, low, high, g, window - gram + 1, min(STEP, window - gram), shared)
    row = np.searchsorted(first, low, "right") - 1
    begin = low - first[row]
    kept: dict[tuple[int, bytes], int] = {}
    mate = np.empty(len(at), np.int64)
    content, alone = [], np.ones(len(at), bool)
    whole = data.tobytes()
    for i, (a, lo, x, y) in enumerate(zip(at.tolist(), low.tolist(), starts[low].tolist(), ends[high + window - 1].tolist())):
        passage = b" ".join(whole[x:y].split())
        j = kept.setdefault((a - lo, passage), i)
        if j != i:
            alone[i] = alone[j] = False
        content.append(passage if j == i else None)
        mate[i] = j
    many = np.flatnonzero(~alone[mate])
    out = [(int(block % buckets), block, 1, _repeats.packed(row[many], begin[many], begin[many] + high[many] - low[many] + window))]
    mine = np.flatnonzero(mate == np.arange(len(at)))
    mine = mine[np.argsort(g[mine], kind="stable")]
    to = _repeats.bucket_of(g[mine], buckets)
    edges = np.flatnonzero(np.diff(to)) + 1
    for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(mine)]):
        k = mine[a:z]
        out.append((int(to[a]), block, 0, _repeats.packed(b"\n".join([content[i] for i in k.tolist()]), (high[k] - low[k] + 1).astype(np.int32), row[k].astype(np.int32), begin[k], alone[k])))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), _PASSAGES.types)], schema=_PASSAGES)


class Index:
    """Window starts of a reference block in the order of the words that follow them.

    words: ids from 1 of all passages end to end; sizes: words of each passage; starts: places that have at least a window of
    their passage left.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, starts: np.ndarray):
        self.starts = starts
        self.remain = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
        self.classes, step = [words], 1
        most = int(sizes.max())
        while step * 2 <= most:
            c = self.classes[-1]
            after = np.zeros_like(c)
            after[:-step] = c[step:]
            after[self.remain <= step] = 0
            self.classes.append(np.unique(c * (int(c.max()) + 1) + after, return_inverse=True)[1] + 1)
            step *= 2
        top = self.classes[-1]
        after = np.where(self.remain[starts] > step, top[np.minimum(starts + step, len(top) - 1)], 0)
        self.order = np.argsort(top[starts] * (int(top.max()) + 1) + after, kind="stable")
        self.rank = np.empty(len(starts), np.int64)
        self.rank[self.order] = np.arange(len(starts))

    def shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that the texts at two places have in common."""
        out, room = np.zeros(len(x), np.int64), np.minimum(self.remain[x], self.remain[y])
        for n in range(len(self.classes) - 1, -1, -1):
            c, step = self.classes[n], 1 << n
            for _ in range(2 if n == len(self.classes) - 1 else 1):
                fits = out + step <= room
                i = np.where(fits, out, 0)
                out += step * (fits & (c[x + i] == c[y + i]))
        return out

    def longest(self, at: np.ndarray) -> np.ndarray:
        """Of some of the starts, by number, the longest match with the words at any other start."""
        r, x, out = self.rank[at], self.starts[at], np.zeros(len(at), np.int64)
        for step in (-1, 1):
            k = np.flatnonzero((r + step >= 0) & (r + step < len(self.order)))
            out[k] = np.maximum(out[k], self.shared(x[k], self.starts[self.order[r[k] + step]]))
        return out


def parse(index: Index, begins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors of all passages: the start that each begins with, and its words, one at least. begins, counts: each passage's first start and
    number of starts. A factor that would begin after a passage's last start is left out, as no window begins there."""
    heads, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, last = begins.copy(), begins + counts
    while len(at):
        heads.append(at)
        sizes.append(np.maximum(index.longest(at), 1))
        at = at + sizes[-1]
        at, last = at[at < last], last[at < last]
    return np.concatenate(heads), np.concatenate(sizes)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of ranges end to end."""
    count = np.maximum(count, 0)
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def duplicates(passages: list[bytes], counts: np.ndarray, window: int) -> np.ndarray:
    """Of all window starts of the passages, in order, which repeat in the block."""
    ids = pd.factorize(np.array(b" ".join(passages).split(b" "), dtype=object))[0].astype(np.int64) + 1
    counts = counts.astype(np.int64)
    begins = np.cumsum(counts) - counts
    starts = np.arange(counts.sum()) + np.repeat(np.arange(len(counts)) * (window - 1), counts)
    index = Index(ids, counts + window - 1, starts)
    heads, sizes = parse(index, begins, counts)
    ends = np.minimum(heads + sizes, np.repeat(begins + counts, counts)[heads])  # of the starts in a factor
    inner = np.clip(heads + sizes - window + 1, heads, ends)  # the first start in it whose window crosses its end
    found = np.zeros(len(starts), bool)
    found[_ranges(heads, inner - heads)] = True
    crossing = _ranges(inner, ends - inner)
    found[crossing[index.longest(crossing) >= window]] = True
    return found


def parse_bucket(table: pa.Table, window: int = WINDOW) -> pa.Table:
    """Parses the passages of one reference block and says, by block of documents, which words its repeated windows cover."""
    out, texts, parts, blocks = [], [], [], []
    for block, kind, payload in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "payload"))):
        if kind:
            out.append((block, payload))
            continue
        content, counts, row, begin, alone = _repeats.unpacked(payload)
        texts += content.split(b"\n")
        parts.append((counts, row, begin, alone))
        blocks.append(np.full(len(counts), block))
    if texts:
        counts, row, begin, alone = (np.concatenate(x) for x in zip(*parts))
        block = np.concatenate(blocks)
        found = duplicates(texts, counts, window)
        who = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
        k = np.flatnonzero(found & alone[who])
        if len(k):
            new = np.append(True, (np.diff(k) != 1) | (np.diff(who[k]) != 0))
            a, z = k[new], k[np.append(np.flatnonzero(new)[1:] - 1, len(k) - 1)]
            owner = who[a]
            for b in np.unique(block[owner]):
                m = block[owner] == b
                o = owner[m]
                out.append((int(b), _repeats.packed(row[o].astype(np.int64), begin[o] + place[a[m]], begin[o] + place[z[m]] + window)))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), _SPANS.types)], schema=_SPANS) if out else _SPANS.empty_table()


def cut_block(table: pa.Table, spans: pa.Table, *, keep_text: bool = False) -> pa.Table:
    """doc_id, n_words, n_removed, kept_sha256 of a block's documents; and what is kept, if wanted."""
    table = _in_order(table)
    found = [_repeats.unpacked(x) for x in spans.column("payload").to_pylist()]
    row, start, end = merged(*(np.concatenate(x).astype(np.int64) for x in zip(*found))) if found else (np.zeros(0, np.int64),) * 3
    content = _tables.texts(table.column("text"))
    first = np.searchsorted(row, np.arange(len(content) + 1)).tolist()
    start, end = start.tolist(), end.tolist()
    total, removed, digests, kept = [], [], [], []
    for i, text in enumerate(content):
        words, a, z = text.split(), first[i], first[i + 1]
        rest = words if a == z else [w for x, y in zip([0, *end[a:z]], [*start[a:z], len(words)]) for w in words[x:y]]
        joined = b" ".join(rest)
        total.append(len(words))
        removed.append(len(words) - len(rest))
        digests.append(hashlib.sha256(joined).hexdigest())
        if keep_text:
            kept.append(joined)
    out = {"doc_id": table.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if keep_text else {}))


def remove_passages(docs: DataFrame, *, keep_text: bool = False, window: int = WINDOW, gram: int = GRAM, hot: int = _repeats.HOT) -> DataFrame:
    """What is left of every document without the words of windows that occur anywhere else."""
    if not 1 <= gram < window:
        raise ValueError("the gram takes at least a word, and fewer than the window")
    blocks = 4 * _tables.blocks_wanted(docs.sparkSession)
    rows = _tables.with_block(docs.select("doc_id", "text"), "doc_id", blocks)

    def hashes(table):
        *_, first, h = _words(_in_order(table))
        return anchors(h, first, window, gram)[3]

    # A text's hashes are a tenth of its bytes, so the hashes of four blocks' share are less than a block.
    back = _repeats.repeated(rows, hashes, max(1, blocks // 4), hot)
    sent = rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(lambda t, b: passages_of_block(t, b, blocks, window, gram), "bucket int, block int, kind int, payload binary")
    spans = sent.repartition(blocks, "bucket").groupBy("bucket").applyInArrow(lambda t: parse_bucket(t, window), "block int, payload binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * keep_text
    return rows.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(lambda t, s: cut_block(t, s, keep_text=keep_text), schema)


def op4_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(_tables.read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_relative_lz": op4_relative_lz}
ORACLE = {
    "op4_relative_lz": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM starts),
often AS (SELECT g FROM grams GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM grams JOIN often USING (g)),
lists AS (SELECT doc_id, count(*) AS n_removed, list(p) AS ps FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
rest AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
}
