"""Which of all anchors' hashes occur more than once: one exchange of packed, sorted hashes.

Rows are dealt into blocks by a hash of their id. Each block sends its distinct hashes to the reducers, cut by hash range, and
hears back which of them another block holds too, or which it holds twice itself, and which are hot: held by more than HOT
blocks. No task holds more than a block or a range.

What stands around a hot anchor is not sent to the reducer of the anchor, as that could be a third of all rows. Its windows are
divided by how far before the anchor they start, and each division goes by a hash of the text that all its windows share,
which is most of a window. Equal windows are still sent to one place, and only those that share that much text meet there.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

_SENT = "bucket int, block int, once binary, many binary"
_BACK = "block int, hashes binary, hot binary"
#: Blocks that may hold an anchor before it is hot.
HOT = 64


def packed(*values) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(values))


def unpacked(payload: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def repeated(rows: DataFrame, hashes: Callable[[pa.Table], np.ndarray], ranges: int, hot: int = HOT) -> DataFrame:
    """block, hashes, hot: for each block of rows (column block), its repeated hashes and the hot ones of them, in pieces;
    hashes(table) lists a block's own.

    ranges: into how many the hashes are cut; a block sends a row for each that it has hashes of, so that as few as fit into
    a reducer are best. The reducers are asked for by number, as what they read says little of what they do and would be coalesced by its size.
    """

    def send(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py() if table.num_rows else 0
        h, n = np.unique(hashes(table), return_counts=True)
        to = bucket_of(h, ranges)
        edges = np.flatnonzero(np.diff(to)) + 1
        out = []
        for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(h)]) if len(h) else ():
            out.append((int(to[a]), block, h[a:z][n[a:z] == 1].tobytes(), h[a:z][n[a:z] > 1].tobytes()))
        return pa.Table.from_pylist([dict(zip(("bucket", "block", "once", "many"), x)) for x in out], schema=_schema)

    def answer(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        once = [np.frombuffer(x, np.uint64) for x in table.column("once").to_pylist()]
        many = [np.frombuffer(x, np.uint64) for x in table.column("many").to_pylist()]
        h, n = np.unique(np.concatenate([*once, *many]), return_counts=True)
        shared = np.union1d(h[n > 1], np.concatenate(many))
        back = [np.concatenate([o[np.isin(o, shared, assume_unique=True)], m]) for o, m in zip(once, many)]
        often = h[n > hot]
        return pa.table({"block": pa.array(blocks, pa.int32()), "hashes": pa.array([x.tobytes() for x in back], pa.binary()), "hot": pa.array([x[np.isin(x, often, assume_unique=True)].tobytes() for x in back], pa.binary())})

    _schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("many", pa.binary())])
    return rows.groupBy("block").applyInArrow(send, _SENT).repartition(ranges, "bucket").groupBy("bucket").applyInArrow(answer, _BACK)


def gathered(table: pa.Table, column: str = "hashes") -> np.ndarray:
    """The hashes that came back to one block, in ascending order."""
    parts = [np.frombuffer(x, np.uint64) for x in table.column(column).to_pylist()]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def divided(back: pa.Table, at: np.ndarray, low: np.ndarray, high: np.ndarray, h: np.ndarray, width: int, step: int, shared: Callable[[np.ndarray, int, int], np.ndarray]) -> tuple[np.ndarray, ...]:
    """Anchors (place, first and last window, hash) with the hot ones in parts of step distances between a window's start
    and the anchor; width: how many distances there are; shared(places, near, far): a hash of what the windows that start near
    to far before these places have in common."""
    k = np.zeros(len(at), bool)
    from claimworks.llm._grams import found_in, mixed

    k[found_in(gathered(back, "hot"), h)[0]] = True
    if not k.any():
        return at, low, high, h
    out = [[x[~k] for x in (at, low, high, h)]]
    at, low, high = at[k], low[k], high[k]
    for near in range(0, width, step):
        far = min(near + step, width) - 1
        a, z = np.maximum(low, at - far), np.minimum(high, at - near)
        some = a <= z
        out.append([at[some], a[some], z[some], mixed(shared(at[some], near, far) + np.uint64(near + 1))])
    return tuple(np.concatenate(x) for x in zip(*out))
