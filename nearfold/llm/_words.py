"""Words, n-grams and their 64-bit hashes over blocks of texts, on whole numpy arrays.

A text is read as UTF-8 bytes. A word is a maximal run of bytes that are not separators. Its hash is a polynomial over
per-byte random values modulo 2**64, from differences of one running sum over the block, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are hashed at a time; one text may be longer and is then taken in pieces.
BLOCK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything below 0x80 but digits and lower-case letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)

_ROOT = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240611).integers(1, 2**64 - 1, 256, dtype=U64)
_up: np.ndarray = np.ones(1, U64)
_down: np.ndarray = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        up, down = np.full(n, _ROOT, U64), np.full(n, pow(_ROOT, -1, 2**64), U64)
        up[0] = down[0] = 1
        _up, _down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return _up, _down


def _hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(buf) + 1)
    run = np.zeros(len(buf) + 1, U64)
    np.cumsum(_VALUES[buf] * up[: len(buf)], out=run[1:], dtype=U64)
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(U64))


def words(buf: np.ndarray, bounds: np.ndarray, separators: np.ndarray, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts ``buf[bounds[i]:bounds[i + 1]]``: hashes, byte starts, byte ends, and the first word's number of each text (one more at the end)."""
    buf = fold[buf]
    inside = ~separators[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = np.unique(bounds)
    begin, end = edge[edge < len(buf)], edge[edge > 0] - 1
    first[begin] = inside[begin]
    last[end] = inside[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), U64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK, "right")))
        a, b = starts[lo], ends[hi - 1]
        if hi == lo + 1 and b - a > BLOCK:  # one word longer than a block
            hashes[lo] = _long(buf[a:b])
        else:
            hashes[lo:hi] = _hash(buf[a:b], starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def _long(word: np.ndarray) -> np.uint64:
    parts = [_hash(p, np.array([0]), np.array([len(p)]))[0] for p in np.array_split(word, len(word) // BLOCK + 1)]
    return mix(np.array([sum(int(p) * pow(_ROOT, k + 1, 2**64) for k, p in enumerate(parts)) % 2**64], U64))[0]


def grams(hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of each n consecutive words, over text borders too (``len - n + 1`` of them, or none)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    out = np.full(m, (seed * 0xD6E8FEB86659FD93 + n) % 2**64, U64)
    for j in range(n):
        out *= U64(_ROOT)
        out += hashes[j : j + m]
    return mix(out)


def window_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """As grams(), from a running sum: the cost does not depend on n. Not equal to grams()."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    up, down = _powers(len(hashes) + 1)
    run = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=run[1:], dtype=U64)
    return mix((run[n:] - run[:m]) * down[:m] + U64(n))


def blocks(column: pa.Array | pa.ChunkedArray, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of runs of texts of about ``most`` bytes together; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), longs(values))
