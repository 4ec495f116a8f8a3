"""Words of whole texts as numpy arrays, for the operators that run in Arrow batches.

A word is a run of characters other than space and U+0009 to U+000D. All of these
separators are single bytes in UTF-8, so words are cut and hashed on the bytes of a
whole batch at once. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes of text handled at a time; a longer text is handled alone, whole.
CHUNK_BYTES = 1 << 20

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U64(pow(int(_BASE), -1, 1 << 64))
_IS_SEPARATOR = np.zeros(256, dtype=bool)
_IS_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (finalizer of splitmix64)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    steps = np.full(count, base, dtype=np.uint64)
    if count:
        steps[0] = 1
    return np.multiply.accumulate(steps)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, extended as longer texts come."""

    up = _powers(_BASE, 1)
    down = _powers(_INVERSE, 1)

    @classmethod
    def of(cls, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < count:
            cls.up, cls.down = _powers(_BASE, count), _powers(_INVERSE, count)
        return cls.up, cls.down


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the sequences ``values[start:end]``, equal for equal sequences."""
    up, down = _Powers.of(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """The words of consecutive rows: where each lies in ``data``, its row, its hash."""

    data: np.ndarray  # bytes of the rows' texts
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    first: np.ndarray  # number of the first word of each row, and of all words at the end
    hashes: np.ndarray  # uint64

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def texts(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """For each place words ``first`` to ``last - 1``, joined by one space."""
        if not len(first):
            return []
        size = self.ends - self.starts + 1
        edges = np.concatenate(([0], np.cumsum(size)))
        joined = self.data[np.minimum(np.arange(edges[-1]) + np.repeat(self.starts - edges[:-1], size), len(self.data) - 1)]
        joined[edges[1:] - 1] = 32
        joined = joined.tobytes()
        return [joined[a:b] for a, b in zip(edges[first].tolist(), (edges[last] - 1).tolist(), strict=True)]

    def grams(self, size: int) -> np.ndarray:
        """A hash for the ``size`` words from each word on; only useful inside one row."""
        count = max(0, len(self.hashes) - size + 1)
        total = np.zeros(count, dtype=np.uint64)
        for k in range(size):
            total = total * _BASE + self.hashes[k : k + count]
        return mixed(total)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most ``most`` bytes, or of one longer row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of rows that lie one after the other in ``data`` at ``offsets``."""
    inside = ~_IS_SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    hashes = span_hashes(_BYTE_VALUES[data], starts, ends)
    return Words(data, starts, ends, first, hashes)


def word_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words) over a string column."""
    data, offsets = text_buffers(column)
    for a, b in row_chunks(offsets, most):
        part = offsets[a : b + 1]
        yield a, b, words_of(data[part[0] : part[-1]], part - part[0])
