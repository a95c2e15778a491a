"""Vectorised byte and word fingerprints over batches of texts.

Texts are handled as one UTF-8 byte array with document offsets. All hashes are
polynomials modulo 2**64 over randomised byte values, read off one cumulative sum,
so a substring's hash does not depend on where it stands. Callers that decide by
hash alone say so; the others compare the bytes afterwards.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))

#: Word bytes: digits, letters, everything outside ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = True
WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)
#: Powers that a worker keeps from one call to the next.
KEPT_POWERS = 1 << 21


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n (kept for the next call, unless there are very many)."""
    global _pow, _inv
    if len(_pow) >= n:
        return _pow[:n], _inv[:n]
    step = np.full(n if n > KEPT_POWERS else min(max(n, 2 * len(_pow)), KEPT_POWERS), BASE, np.uint64)
    with np.errstate(over="ignore"):
        step[0] = 1
        pw = np.cumprod(step)
        step[1:] = BASE_INV
        inv = np.cumprod(step)
    if n <= KEPT_POWERS:
        _pow, _inv = pw, inv
    return pw[:n], inv[:n]


def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: nothing to trim
        return None


_malloc_trim = _trim()


def release() -> None:
    """Gives memory that is no longer used back to the system; a worker process serves many tasks."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over Arrow batches that leaves no memory behind in its worker."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads a polynomial hash over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes in one array, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8).copy()
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, off - off[0]


def pieces(buf: np.ndarray, off: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, last + 1, bytes, offsets) in pieces of about `size` bytes; no document is cut."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    pw, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[buf] * pw[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(sums))
    return (sums[end] - sums[start]) * inv[start]


class Words:
    """Words of a batch: start and end byte, lower-cased bytes, word offsets of each document."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.low = LOWER[buf]
        inside = WORD[buf]
        before = np.zeros(len(buf) + 1, bool)
        before[1:] = inside
        cut = off[off < len(buf)]
        start = inside.copy()
        start &= ~before[:-1]
        start[cut] = inside[cut]
        after = np.zeros(len(buf) + 1, bool)
        after[:-1] = inside
        end = inside & ~after[1:]
        last = off[off > 0] - 1
        end[last] = inside[last]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.off = np.searchsorted(self.start, off)
        self._sums = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            self._sums = prefix_sums(self.low)
        return self._sums

    def hashes(self) -> np.ndarray:
        """One hash a word."""
        return mix(span_hash(self.sums, self.start, self.end) + (self.end - self.start).astype(np.uint64))

    def prefix_hashes(self, n: int) -> np.ndarray:
        """Hash of each word's first n bytes; of words with no more than n bytes, 0."""
        stop = np.minimum(self.start + n, self.end)
        h = mix(span_hash(self.sums, self.start, stop) + np.uint64(n * int(BASE) % 2**64))
        return np.where(self.end - self.start > n, h, np.uint64(0))

    def grams(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash) of each run of k words inside one document."""
        h = self.hashes() if hashes is None else hashes
        n = len(h) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        g, b = np.zeros(n, np.uint64), np.uint64(1)
        for j in range(k):
            g += h[j : j + n] * b
            b = np.uint64((int(b) * 0xD1342543DE82EF95) & (2**64 - 1))
        doc = np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))
        at = np.flatnonzero(doc[:n] == doc[k - 1 :])
        return at, mix(g[at])

