"""Vectorised byte work on Arrow string columns.

Texts are looked at as one flat UTF-8 buffer plus row offsets, cut into
pieces of about a megabyte, so a task holds a few arrays of that size
whatever the size of the Arrow batch. One row is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Space, tab, newline, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}


def release() -> None:
    """Give freed memory back to the system: Python workers are used again
    by later steps and would keep the most that any step took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):           # not the GNU C library
        pass


def tidy(fn):
    """``fn`` of an iterator of batches, releasing memory at its end."""
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()
    return run


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(1 << 21, n)
        p = np.full(size, base, U64)
        p[0] = 1
        np.cumprod(p, out=p)
        if size > 1 << 22:      # a very long text: do not keep its table
            return p[:n]
        _pow[base] = have = p
    return have[:n]


def pieces(col: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 20
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of whole rows of about
    ``max_bytes``; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return
    col = pc.fill_null(col.cast(pa.large_string()), "")
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = base**s * hash of bytes s..e."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of each byte span (equal bytes, equal hash)."""
    inv = _powers(_BASE_INV, len(p))
    return mix((p[e] - p[s]) * inv[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes outside ``gap`` (white
    space); runs never cross rows."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    sp = gap[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = sp[:-1]
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = sp[1:]
    full = off[1:] > off[:-1]
    before[off[:-1][full]] = True
    after[off[1:][full] - 1] = True
    s = np.nonzero(~sp & before)[0]
    e = np.nonzero(~sp & after)[0] + 1
    return s, e, np.searchsorted(off, s, "right") - 1
