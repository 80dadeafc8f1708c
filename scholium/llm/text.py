"""Vectorised text primitives over Arrow buffers: words, 64-bit hashes, n-gram windows.

Everything works on the UTF-8 bytes of a block of rows at once (numpy, no Python string per word). A block is a
run of whole rows of about ``BLOCK`` bytes, so memory is bounded by that and by the longest single row.

Words are maximal runs of bytes other than space and ``\\x09``-``\\x0D``. Hashes are 64-bit polynomials over
random byte codes; two different words agree with a chance of about 2**-64.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 4 << 20
#: Bytes hashed at once.
PART = 1 << 18

WS = np.zeros(256, bool)
WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15 | 1) ^ np.uint64(8)  # 5 modulo 8, so that powers have the longest period
_MI = np.uint64(pow(int(_M), -1, 2**64))
STEP = 1 << 14
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the splitmix64 one)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` below STEP, and those of base**STEP as far as exponents below ``n`` need them."""
    low, high = _powers.get(int(base), (None, np.ones(1, np.uint64)))
    if low is None or len(high) * STEP < n:
        low = np.full(STEP, base, np.uint64)
        low[0] = 1
        np.multiply.accumulate(low, out=low)
        high = np.repeat(low[-1:] * base, n // STEP + 1)
        high[0] = 1
        np.multiply.accumulate(high, out=high)
        _powers[int(base)] = low, high
    return low, high


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of code[i] * M**i; with :func:`span` they give the hash of any span."""
    n = len(codes)
    out = np.zeros(n + 1, np.uint64)
    low, high = _power(_M, n)
    for i, at in enumerate(range(0, n, STEP)):
        part = codes[at : at + STEP]
        np.multiply(part, low[: len(part)] * high[i], out=out[1 + at : 1 + at + len(part)])
    np.cumsum(out, out=out)
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    low, high = _power(_MI, len(sums))
    return mix((sums[end] - sums[start]) * low[start & (STEP - 1)] * high[start >> STEP.bit_length() - 1])


def give_back() -> None:
    """Returns freed memory to the system, as a worker process outlives its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def flatten(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[offs[0] : offs[-1]], offs - offs[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Whole rows in blocks of about ``limit`` bytes: (rows, bytes, offsets)."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offs = flatten(batch.column(column))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
                yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                lo = hi
    finally:
        give_back()


def slices(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``limit`` bytes."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the rows' offsets into them."""
    inside = ~WS[data]
    start, last = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offs[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        start[cut] |= inside[cut]
        last[cut - 1] |= inside[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the words, some at a time, so that no sums over all bytes of a block are held."""
    out = np.empty(len(s), np.uint64)
    lo = 0
    while lo < len(s):
        first = int(s[lo])
        hi = max(lo + 1, int(np.searchsorted(e, first + PART, "right")))
        out[lo:hi] = span(prefix(CODE[data[first : int(e[hi - 1])]]), s[lo:hi] - first, e[lo:hi] - first)
        lo = hi
    return out


def row_of(offs: np.ndarray) -> np.ndarray:
    """The row of each element, from row offsets."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def windows(word_offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the k-word windows that lie within one row, and the rows' offsets into them."""
    n = np.maximum(np.diff(word_offs) - k + 1, 0)
    offs = np.concatenate([[0], np.cumsum(n)])
    return np.arange(offs[-1]) + np.repeat(word_offs[:-1] - offs[:-1], n), offs


def sums_by_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every span, one span after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
