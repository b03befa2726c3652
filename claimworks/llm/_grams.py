"""Words and runs of words of many texts at once, as numpy arrays with 64-bit hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_SPAN = 1 << 16
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_WORD = 1 << 64


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(_SPAN, U), np.empty(_SPAN, U)
    inverse, a, b = pow(_BASE, -1, _WORD), 1, 1
    for i in range(_SPAN):
        up[i], down[i] = a, b
        a, b = a * _BASE % _WORD, b * inverse % _WORD
    return up, down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def words(data: np.ndarray, offsets: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, none of which crosses from one text into the next, and each text's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    on = letter[data]
    edge = np.empty(len(on) + 1, bool)
    edge[0], edge[-1] = on[0], on[-1]
    np.not_equal(on[1:], on[:-1], out=edge[1:-1])
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    joined = np.unique(inner[on[inner] & on[inner - 1]])  # an end and a start at once
    at = np.flatnonzero(edge)
    if len(joined):
        at = np.sort(np.concatenate([at, joined, joined]))
    starts, ends = at[::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = _powers()
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    reps = -(-len(data) // _SPAN)
    weights = np.tile(up, reps)[: len(data)] if reps > 1 else up[: len(data)]
    np.cumsum((data.astype(U) + U(1)) * weights, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts % _SPAN]
    for i in np.flatnonzero(starts // _SPAN != (ends - 1) // _SPAN):
        value, lift = 0, pow(_BASE, _SPAN, _WORD)
        for n, s in enumerate(range(starts[i], ends[i], _SPAN)):
            part = data[s : min(s + _SPAN, ends[i])].astype(U) + U(1)
            value += int((part * up[: len(part)]).sum(dtype=U)) * pow(lift, n, _WORD)
        h[i] = U(value % _WORD)
    return mixed(h ^ (ends - starts).astype(U))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive words; runs across texts are for the caller to leave out."""
    if len(h) < n:
        return np.zeros(0, U)
    out, factor = np.zeros(len(h) - n + 1, U), 1
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * U(factor)
        factor = factor * _STEP % _WORD
    return mixed(out)


def inside(first: np.ndarray, total: int, n: int) -> np.ndarray:
    """Which of the runs of n words, by first word, lie in one text; first: each text's first word, and the total last."""
    if total < n:
        return np.zeros(0, bool)
    ends = np.repeat(first[1:], np.diff(first))[: total - n + 1]
    return np.arange(total - n + 1) + n <= ends


def cuts(offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of about this many bytes, one text at least."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    """The least key of every window of so many consecutive keys."""
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    rest = width - span
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def found_in(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in the sorted table, and where. Most are not, and a bitmap of the low bits says so at once."""
    if not len(table) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = max(16, int(len(table) * 16).bit_length())
    low = U((1 << bits) - 1)
    seen = np.zeros(1 << bits, bool)
    seen[table & low] = True
    at = np.flatnonzero(seen[values & low])
    place = np.searchsorted(table, values[at])
    same = table[np.minimum(place, len(table) - 1)] == values[at]
    return at[same], place[same]
