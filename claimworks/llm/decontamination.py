"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of 13 words, or the whole item where it has fewer. A window is a sequence of overlapping
shingles of up to four words. The corpus is counted once for how often each benchmark shingle occurs in it; a window can
only occur where its rarest shingle does, so that shingle is the window's prefix (containment of 1 needs a prefix of one),
and windows with a shingle that never occurs are dropped. Documents are joined to the prefixes by shingle; the shingle's
place in the window fixes where the window would start and end (positional and length bounds), and the words there are
compared one by one.

The benchmark's index goes to every executor while the texts take under INDEX_BYTES; a larger benchmark is cut by item into
parts of that size, and the documents pass the parts one after another, written to the shared folder after every few.

Defined results: null and empty texts have no words; words are compared after lower-casing A-Z alone; repeated rows of
documents give repeated rows, repeated items count once by item_id; items without id or words take no part; tables may be
empty and may hold further columns of any name.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimworks.llm import _grams, _tables
from claimworks.llm._lineage import cut

WINDOW = 13
SHINGLE = 4
#: Contaminated from this share of hit words: one in twenty.
SHARE = 20
INDEX_BYTES = 1 << 20
#: Parts of a larger benchmark whose indexes a task holds at once.
TOGETHER = 4
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True


class Index:
    """Windows of some items, by content."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            found = word_list(text)
            size = min(window, len(found))
            for i in range(len(found) - size + 1 if size else 0):
                owners[tuple(found[i : i + size])].add(item)
        self.windows = sorted(owners)
        self.items = [sorted(owners[w]) for w in self.windows]
        self.sizes = sorted({min(SHINGLE, len(w)) for w in self.windows})
        held = {s: sorted({w[i : i + s] for w in self.windows if min(SHINGLE, len(w)) == s for i in range(len(w) - s + 1)}) for s in self.sizes}
        #: By shingle length, the hashes in ascending order and where each shingle stands among them.
        self.hashes: dict[int, np.ndarray] = {}
        self.place: dict[tuple[bytes, ...], int] = {}
        for s, shingles in held.items():
            h = np.array([shingle_hash(x) for x in shingles], np.uint64)
            self.hashes[s] = np.unique(h)
            self.place.update(zip(shingles, np.searchsorted(self.hashes[s], h).tolist()))

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Gives each window its rarest shingle as prefix; counts: of the corpus, by shingle length and place."""
        chosen: dict[int, dict[int, list[tuple[int, int]]]] = {s: defaultdict(list) for s in self.sizes}
        for n, w in enumerate(self.windows):
            s = min(SHINGLE, len(w))
            rare, i = min((int(counts[s][self.place[w[i : i + s]]]), i) for i in range(len(w) - s + 1))
            if rare:
                chosen[s][self.place[w[i : i + s]]].append((i, n))
        self.prefix = {s: (np.array([self.hashes[s][k] for k in sorted(of)], np.uint64), [of[k] for k in sorted(of)]) for s, of in chosen.items() if of}
        self.place = {}


def word_list(text: bytes) -> list[bytes]:
    data = _LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = _grams.words(data, np.array([0, len(data)]), _LETTER)
    low = data.tobytes()
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def shingle_hash(shingle: tuple[bytes, ...]) -> int:
    data = np.frombuffer(b" ".join(shingle), np.uint8)
    starts, ends, _ = _grams.words(data, np.array([0, len(data)]), _LETTER)
    return int(_grams.gram_hashes(_grams.word_hashes(data, starts, ends), len(shingle))[0])


def _pieces(column):
    """Lower-cased bytes and words of runs of texts: first text, bytes, word starts, word ends, each text's first word, word hashes."""
    data, offsets = _tables.utf8(column)
    for i, j in _grams.cuts(offsets, PIECE):
        part = _LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, first = _grams.words(part, offsets[i : j + 1] - offsets[i], _LETTER)
        yield i, part, starts, ends, first, _grams.word_hashes(part, starts, ends)


def _counts(docs: DataFrame, index: Index) -> dict[int, np.ndarray]:
    """How often each shingle of the index occurs in the corpus."""
    held = docs.sparkSession.sparkContext.broadcast((index.sizes, index.hashes))

    def run(batches):
        sizes, hashes = held.value
        sums = {s: np.zeros(len(hashes[s]), np.int64) for s in sizes}
        for b in batches:
            for _, part, starts, _, first, h in _pieces(b.column(0)):
                for s in sizes:
                    ok = _grams.inside(first, len(starts), s)
                    at, place = _grams.found_in(hashes[s], _grams.gram_hashes(h, s)[ok])
                    sums[s] += np.bincount(place, minlength=len(hashes[s]))
        for s in sizes:
            k = np.flatnonzero(sums[s])
            yield pa.record_batch([pa.array(np.full(len(k), s)), pa.array(k), pa.array(sums[s][k])], names=["s", "k", "n"])

    out = {s: np.zeros(len(index.hashes[s]), np.int64) for s in index.sizes}
    for r in docs.select("text").mapInArrow(run, "s long, k long, n long").groupBy("s", "k").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.s][r.k] = r.n
    return out


def _hits(docs: DataFrame, index: Index) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)
    columns = docs.columns

    def run(batches):
        ix = held.value
        for b in batches:
            n_words = np.zeros(b.num_rows, np.int64)
            spans, items = [x.as_py() for x in b.column("spans")], [set(x.as_py()) for x in b.column("items")]
            for top, part, starts, ends, first, h in _pieces(b.column("text")):
                n_words[top : top + len(first) - 1] = np.diff(first)
                low = None
                for s, (table, of) in ix.prefix.items():
                    ok = np.flatnonzero(_grams.inside(first, len(starts), s))
                    at, place = _grams.found_in(table, _grams.gram_hashes(h, s)[ok])
                    for w, k in zip(ok[at].tolist(), place.tolist()):
                        doc = int(np.searchsorted(first, w, "right")) - 1
                        for shift, n in of[k]:
                            a, z = w - shift, w - shift + len(ix.windows[n])
                            if a < first[doc] or z > first[doc + 1]:
                                continue
                            low = low or part.tobytes()
                            if all(low[starts[a + i] : ends[a + i]] == x for i, x in enumerate(ix.windows[n])):
                                spans[top + doc].append({"start": int(a - first[doc]), "end": int(z - first[doc])})
                                items[top + doc].update(ix.items[n])
            made = {"n_words": pa.array(n_words), "spans": pa.array([merged(x) for x in spans], _SPANS), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
            yield pa.record_batch([made[c] if c in made else b.column(c) for c in columns], names=columns)

    return docs.mapInArrow(run, docs.schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda x: x["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Columns keep and n_words, spans of hit words (end exclusive), ids of the items that occur, as sorted strings."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size // index_bytes) + 1
    found = docs.select(*keep, *(() if "text" in keep else ("text",)), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for p in range(parts):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == p) if parts > 1 else items
        index = Index([(r.item, bytes(r.text)) for r in part.collect()], window)  # index_bytes at most, on average
        if index.sizes:
            index.order(_counts(docs, index))
        else:
            index.prefix = {}
        found = _hits(found, index)
        if p % TOGETHER == TOGETHER - 1 and p + 1 < parts:
            found = cut(found)
    return found if "text" in keep else found.drop("text")


def n_hit():
    """Hit words of a row of overlaps()."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def contaminated():
    """Whether a row of overlaps() has so many hit words that it goes."""
    return (n_hit() > 0) & (F.lit(SHARE) * n_hit() >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = overlaps(docs, benchmark, **options)
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_tables.read(spark, sf_dir, "documents", "doc_id", "text"), _tables.read(spark, sf_dir, "benchmark", "item_id", "text"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_decontamination": op6_decontamination}
ORACLE = {
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM di) JOIN bw USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
}
