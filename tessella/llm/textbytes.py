"""Vectorised text work on Arrow string columns: words, hashes, bags of shingles. All in numpy over bounded chunks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1 << 62, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_TURN = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _rng.integers(1 << 62, 1 << 63, 16, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


_caches: dict[str, Callable[[], None]] = {}


def trim() -> None:
    """Gives freed memory back to the system, as many workers share a machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its memory is its own affair
        pass


def claim(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Called where an operator starts in a Python worker, which serves one after another: what others cached there goes
    back to the system. forget: empties the owner's own cache."""
    others = [name for name in _caches if name != owner]
    for name in others:
        _caches.pop(name)()
    if others:
        gc.collect()
        trim()
    if forget:
        _caches[owner] = forget


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _TURN)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of about CHUNK bytes each; null counts as empty. What they leave behind is given back after the last one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    trim()


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a document's bounds."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begin[edge] |= inside[edge]
    end[edge - 1] |= inside[edge - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums for `hashed`."""
    powers, _ = _power(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=out[1:])
    return out


def hashed(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans, equal values."""
    _, turn = _power(len(sums))
    return mix((sums[ends] - sums[starts]) * turn[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document, hash) of the words: maximal runs without ASCII white space."""
    starts, ends = spans(~SPACE[data], offsets)
    docs = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, docs, hashed(prefix(data), starts, ends)


def windows(word: np.ndarray, docs: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, document, hash) of all runs of k words; a document of 1 to k - 1 words has one run of them all."""
    count = np.bincount(docs, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    n = max(0, len(word) - k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += word[j : j + n] * _PLACE[j]
    whole = docs[:n] == docs[k - 1 : k - 1 + n] if n else np.zeros(0, bool)
    at, doc, total = np.flatnonzero(whole), docs[:n][whole], mix(total[whole])
    for length in range(1, k):
        short = np.flatnonzero(count == length)
        if len(short):
            s = np.full(len(short), int(_PLACE[15]) * length & (1 << 64) - 1, np.uint64)
            for j in range(length):
                s += word[first[short] + j] * _PLACE[j]
            at, doc, total = np.concatenate((at, first[short])), np.concatenate((doc, short)), np.concatenate((total, mix(s)))
    return at, doc, total


def bags(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 44-bit element, count) of the multisets, sorted; documents are numbered below 2 ** 20."""
    keys = np.sort((doc.astype(np.uint64) << U(44)) | (value >> U(20)))
    if not len(keys):
        return keys.astype(np.int64), keys, keys.astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    count = np.diff(np.concatenate((edge, [len(keys)])))
    return (keys[edge] >> U(44)).astype(np.int64), keys[edge] & U((1 << 44) - 1), count


_points: list[np.ndarray] = []


def hashed_points(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of code points."""
    if not _points:
        _points.append(mix(np.arange(0x110000, dtype=np.uint64) + U(1)) | U(1))
    powers, turn = _power(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_points[0][points] * powers[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * turn[starts] + (ends - starts).astype(np.uint64))


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, a place of each, which one each place has)."""
    if not len(key):
        return key, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(key)
    k = key[order]
    edge = np.concatenate(([True], k[1:] != k[:-1]))
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(edge) - 1
    return k[edge], order[edge], of
