"""Vectorised text kernels over Arrow batches: words, hashes and windows of many texts at once.

A slice of texts is one byte array with offsets.  Words are found by a byte
class table; the hash of any byte range comes from running sums of
``byte * P**i`` (mod 2**64, with the inverse powers), mixed at the end.
Memory is a few 8-byte values per byte of a slice; slices hold SLICE bytes, or
one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
P, Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so that they have inverses
U = np.uint64
_POWERS = {"p": np.ones(1, U), "i": np.ones(1, U)}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.ones(256, bool)
_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
#: (fold to lower case, byte belongs to a word)
SPACED, ALNUM = (_LOWER, _SPACE), (_LOWER, _ALNUM)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        for k, base in (("p", P), ("i", pow(P, -1, 1 << 64))):
            x = np.full(n, base, U)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=U)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of pieces of the batches that hold ``limit`` bytes, or one longer text."""
    for batch in batches:
        data, off = utf8(batch.column(text))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def ranges(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where mask holds; runs end with their text."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    inner = off[(off > 0) & (off < len(mask))]
    before[inner] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    after[inner - 1] = False
    return starts, np.flatnonzero(mask & ~after) + 1


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal ranges have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, U)
    p, inv = powers(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p, out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(U) * U(Q))


def words(data: np.ndarray, off: np.ndarray, kind=SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and ends of all words, and each text's offsets into them."""
    fold, member = kind
    low = fold[data]
    starts, ends = ranges(member[low], off)
    return range_hashes(low, starts, ends), starts, ends, np.searchsorted(starts, off)


def window_hashes(h: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of n words inside one text, and the window's place among the words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    g = np.zeros(m, U)
    for j in range(n):
        g = g * U(Q) + h[j : j + m]
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.flatnonzero(text[:m] == text[n - 1 :])
    return mix(g[at]), at


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles (fewer words: all of them as one), and offsets."""
    h, _, _, woff = words(data, off)
    g, at = window_hashes(h, woff, n)
    text = np.searchsorted(woff, at, "right") - 1
    count = np.diff(woff)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), U)
        for j in range(n - 1):
            there = count[short] > j
            extra[there] = extra[there] * U(Q) + h[woff[short[there]] + j]
        g, text = np.concatenate([g, mix(extra + count[short].astype(U))]), np.concatenate([text, short])
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    if len(g):
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
        g, text = g[first], text[first]
    return g, np.searchsorted(text, np.arange(len(off)))


def list_array(values: pa.Array, off: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), values)
