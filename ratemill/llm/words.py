"""Words and 64-bit hashes of word sequences, over the bytes of whole Arrow batches.

A word is a run of bytes other than space and 09-0D. Hashes are differences of prefix sums of a polynomial
modulo 2^64, brought back to position 0 by the inverse power, and mixed; equal sequences have equal hashes
wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BLOCK = 1 << 19
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * _BLOCK), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of `values[start:end]` (already mixed 64-bit values) for each pair."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(values) + 1)[start] + (end - start).astype(np.uint64))


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each `n` consecutive values."""
    start = np.arange(max(0, len(values) - n + 1))
    return ranges(values, start, start + n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; text i is `data[offsets[i]:offsets[i + 1]]`."""
    return runs(~_BLANK[data], offsets)


def runs(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of `keep` that stays within a text."""
    filled = offsets[:-1] < offsets[1:]
    first, last = keep.copy(), keep.copy()
    first[1:] &= ~keep[:-1]
    last[:-1] &= ~keep[1:]
    begins, ends = offsets[:-1][filled], offsets[1:][filled] - 1
    first[begins], last[ends] = keep[begins], keep[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Hash of each `data[start:end]`, each value of `data` standing for its entry in `table`."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):  # blocks of bounded bytes, but for single longer words
        to = max(at + 1, int(np.searchsorted(end, start[at] + _BLOCK, "right")))
        low, high = start[at], end[to - 1]
        out[at:to] = ranges(table[data[low:high]], start[at:to] - low, end[at:to] - low)
        at = to
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, nulls as empty texts, and the bounds of each text."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes of text, or one longer row."""
    _, offsets = text_bytes(batch.column(text))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def spans_of(groups: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each of the groups 0..n-1 in the sorted array `groups`."""
    return np.searchsorted(groups, np.arange(n + 1))


def list_column(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a list column without nulls."""
    bounds = np.asarray(column.offsets)
    return np.asarray(column.values)[bounds[0] : bounds[-1]], bounds - bounds[0]
