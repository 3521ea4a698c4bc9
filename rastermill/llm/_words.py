"""Whole Arrow columns of texts as flat arrays of bytes and words (used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

#: Bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Every ASCII byte that is not a letter or digit separates; others, UTF-8 bytes above 0x7F included, belong to words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xC2B2AE3D27D4EB4F | 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        steps = np.full(size, base % 2**64, U64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (splitmix64's finaliser)."""
    x = x.astype(U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _binary(column) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def pieces(batches, text: str, most: int = 1 << 20, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Record batches cut between rows so that each has at most ``rows`` rows and about ``most`` bytes of text (a longer text stands alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part, place = np.cumsum(sizes) // most, np.arange(len(sizes)) // rows
        cuts = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(place) != 0)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def packed(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows on end (nulls as empty), and where each row starts (one more entry than rows)."""
    column = _binary(column)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each row (one more entry than rows)."""
    n = len(data)
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words have equal hashes anywhere."""
    if not len(starts):
        return np.zeros(0, U64)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((mix(data.astype(U64) + U64(1)) | U64(1)) * powers(_BASE, len(data)), out=total[1:])
    undo = powers(pow(_BASE, -1, 2**64), len(data))
    return mix((total[ends] - total[starts]) * undo[starts] + (ends - starts).astype(U64))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive word hashes (rows are not respected: mask what crosses them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * powers(_STEP, len(hashes)), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(pow(_STEP, -1, 2**64), n))


def gram_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and start word of every run of k words that lies within one row."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)
    return row, start
