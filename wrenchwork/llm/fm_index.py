"""A compressed full-text index over sequences of words, searched backwards.

The index holds the Burrows-Wheeler transform of many short sequences as a wavelet matrix: a bit
per word and binary digit, with running counts per 64 bits. A step of backward search maps
both ends of an interval through the digits of one word; all queries of a batch take their
steps together.
"""

from __future__ import annotations

import numpy as np

_U64 = np.uint64
_BELOW = (_U64(1) << np.arange(64, dtype=np.uint64)) - _U64(1)


class WaveletMatrix:
    """Ranks in a sequence of numbers from 0 to under ``size``."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.digits = max(1, int(size - 1).bit_length())
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for digit in range(self.digits - 1, -1, -1):
            ones = (symbols >> digit) & 1 == 1
            packed = np.zeros((len(ones) // 64 + 1) * 8, dtype=np.uint8)
            packed[: (len(ones) + 7) // 8] = np.packbits(ones, bitorder="little")
            words = packed.view(np.uint64)
            before = np.zeros(len(words), dtype=np.int64)
            np.cumsum(np.bitwise_count(words)[:-1], out=before[1:])
            self.bits.append(words)
            self.before.append(before)
            self.zeros.append(int(len(ones) - ones.sum()))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))
        self.starts = self.place(np.arange(size), np.zeros(size, dtype=np.int64))

    def place(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where position ``ends`` lies after following the digits of the symbols."""
        at = ends
        for level, digit in enumerate(range(self.digits - 1, -1, -1)):
            word = at >> 6
            ones = self.before[level][word] + np.bitwise_count(
                self.bits[level][word] & _BELOW[at & 63]
            )
            at = np.where((symbols >> digit) & 1 == 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the position."""
        return self.place(symbols, ends) - self.starts[symbols]


def suffix_order(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order, by doubling prefixes; each zero ends a sequence and counts as distinct.

    ``longest`` is the length of the longest sequence with its end.
    """
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
    length = 1
    while True:
        ahead = np.zeros(len(rank), dtype=np.int64)
        ahead[:-length] = rank[length:] + 1
        key = rank * np.int64(rank.max() + 2) + ahead
        order = np.argsort(key)
        ordered = key[order]
        numbers = np.zeros(len(rank), dtype=np.int64)
        numbers[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        rank = np.empty_like(numbers)
        rank[order] = numbers
        length *= 2
        if length >= longest or numbers[-1] == len(numbers) - 1:
            return order


class FMIndex:
    """Over ``symbols``: sequences of numbers from 1 to under ``size``, each followed by a 0."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        ends = np.flatnonzero(symbols == 0)
        longest = int(np.diff(np.concatenate(([-1], ends))).max())
        self.order = suffix_order(symbols, longest)
        self.matrix = WaveletMatrix(symbols[self.order - 1], size)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size))))

    def matches(
        self, text: np.ndarray, ends: np.ndarray, threshold: int, least: int = 1
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics at the places ``ends`` of ``text``, up to ``threshold``.

        For each, the length of the longest piece that ends there and occurs ``least`` times
        in the index (at most ``threshold``), and its interval (from, to) in the suffix order.
        A place must have ``threshold`` numbers before it.
        """
        length = np.zeros(len(ends), dtype=np.int64)
        low = np.zeros(len(ends), dtype=np.int64)
        high = np.full(len(ends), len(self.order), dtype=np.int64)
        going = np.arange(len(ends))
        a, b = low.copy(), high.copy()
        for step in range(1, threshold + 1):
            symbol = text[ends[going] - step]
            if step == 1:
                a, b = self.first[symbol], self.first[symbol + 1]
            else:
                a = self.first[symbol] + self.matrix.rank(symbol, a)
                b = self.first[symbol] + self.matrix.rank(symbol, b)
            alive = b - a >= least
            going, a, b = going[alive], a[alive], b[alive]
            length[going], low[going], high[going] = step, a, b
            if not len(going):
                break
        return length, low, high
