"""Vectorised work on UTF-8 bytes: range hashes, windowed minima, ragged gathers, Arrow access."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext


def _give_back() -> None:
    """In a worker: large arrays go back to the system at once, by fixed limits for mapping and trimming. The driver's allocator stays as it is."""
    if sys.platform == "linux" and TaskContext.get() is not None and not _given:
        _given.append(True)
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)
            libc.mallopt(-1, 1 << 22)
        pa.set_memory_pool(pa.system_memory_pool())


_given: list[bool] = []

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class RangeHash:
    """64-bit hashes of any byte range of a buffer in constant time each, by prefix sums."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _TABLE):
        n = len(data)
        forward, self._back = powers(n + 1)
        self._sums = np.zeros(n + 1, U64)
        terms = table[data]
        terms *= forward[:n]
        np.cumsum(terms, out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._back[start] + (end - start).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all k-byte ranges, in order of their starts."""
        n = len(self._sums) - k
        return mix((self._sums[k:] - self._sums[:n]) * self._back[:n]) if n > 0 else np.zeros(0, U64)


def windowed_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all w consecutive values, by doubling."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    steps = np.ones(total, np.int64)
    steps[0] = starts[0]
    ends = np.cumsum(lengths)[:-1]
    steps[ends] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(steps)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def longs(column: pa.Array, null: int = np.iinfo(np.int64).max) -> np.ndarray:
    """A long column as numpy; null becomes ``null``."""
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of ``column``, or of one row."""
    _give_back()
    for batch in batches:
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


_WORD_BREAK = np.zeros(256, bool)
_WORD_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_TABLE = _TABLE[_LOWER]


def word_ranges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and for each text the number of the first word (n + 1 values)."""
    inside = ~_WORD_BREAK[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True  # words never run from one text into the next
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    start = np.flatnonzero(begins)
    stops = inside
    stops[:-1] &= ~inside[1:] | first[1:-1]
    end = np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word with A-Z lower-cased, and the first word of each text."""
    start, end, of = word_ranges(data, at)
    return RangeHash(data, _LOWER_TABLE).of(start, end), of
