"""Vectorised text primitives over Arrow buffers: words, hashes, windows.

Everything works on a slice of rows at a time (``CHUNK_BYTES`` of text, or one longer row), so memory
is bounded by the slice and the longest single text, never by a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4_000_000

U64 = np.uint64
_C1, _C2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_rng = np.random.default_rng(20240101)
#: Words are maximal runs of bytes outside 0x20 and 0x09-0x0D.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BYTE_WORD = np.where(WORD_BYTE, _BYTE, U64(0))
_PLACE = _rng.integers(1, 2**63, 65536, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= _C1
    x ^= x >> U64(27)
    x *= _C2
    x ^= x >> U64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        held = np.full(size, base, U64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if size <= 1 << 22:
            _powers[int(base)] = held
    return held[:n]


def slices(ids: pa.Array, texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(ids, bytes, offsets, first row) of consecutive rows; a null text is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ids = np.asarray(ids.to_numpy(zero_copy_only=False)).astype(np.int64)
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + size, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield ids[at:to], buf[off[at] : off[to]], off[at : to + 1] - off[at], at
        at = to


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each row's first word index (one more than rows)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = WORD_BYTE[buf]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    start = np.flatnonzero(w & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    end = np.flatnonzero(w & (~after | first[1:])) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(start):
        return np.zeros(0, U64)
    s0, n = int(start[0]), len(buf)
    place = np.arange(n - s0) - np.repeat(start - s0, np.diff(np.append(start, n)))
    value = _BYTE_WORD[buf[s0:]]
    if int((end - start).max()) > 65536:
        value *= _PLACE[place & 65535] + (place >> 16).astype(U64) * BASE
    else:
        value *= _PLACE[place & 65535]
    return mix(np.add.reduceat(value, start - s0) + (end - start).astype(U64) * BASE)


def prefix(h: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span`` takes the hash of any run of tokens."""
    out = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(BASE, len(h)), out=out[1:])
    return out


def span(pre: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of tokens lo..hi-1, equal wherever the same tokens stand."""
    return mix((pre[hi] - pre[lo]) * powers(INVERSE, len(pre))[lo])


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for count[0] values, then from start[1], and so on."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)
