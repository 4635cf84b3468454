"""Compressed FM-index over sequences of integers: a wavelet matrix of the transform, and a sample of the suffix order."""

from __future__ import annotations

import numpy as np


class BitRow:
    """Packed bits with counts per 64-bit word, for the number of ones before a place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FmIndex:
    """Matching statistics and first places in sequences that end in a separator each.

    Symbols are numbers from 0 to ``size - 1``, and 0 is the separator.  Of the suffix order only the places of
    every ``every``-th symbol of a sequence are kept, the first included; others are found by steps to the left.
    """

    def __init__(self, symbols: np.ndarray, size: int, every: int = 16):
        n = len(symbols)
        ends = np.flatnonzero(symbols == 0)
        # Separators differ by place, so that comparing two suffixes ends at the first one.
        rank = symbols.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        step = 1
        while step < n:
            later = np.zeros(n, np.int64)
            later[:-step] = rank[step:] + 1
            rank = np.unique(rank * (n + size + 2) + later, return_inverse=True)[1]
            if rank.max() == n - 1:
                break
            step *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        row = symbols[order - 1].astype(np.int64)
        counts = np.bincount(symbols, minlength=size)
        self.size = n
        self.levels: list[tuple[BitRow, int, int]] = []
        starts = np.zeros(size, np.int64)
        names = np.arange(size)
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            ones = (row >> bit) & 1
            level = BitRow(ones), int(n - ones.sum()), bit
            self.levels.append(level)
            row = np.concatenate([row[ones == 0], row[ones == 1]])
            starts = self._down(level, names, starts)
        # What to add to a place at the bottom to get a place in suffix order.
        self.base = np.concatenate([[0], np.cumsum(counts)])[:-1] - starts
        begins = np.concatenate([[0], ends + 1])
        offset = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
        sampled = (offset % every == 0)[order]
        self.marked, self.places = BitRow(sampled), order[sampled]

    @staticmethod
    def _down(level: tuple[BitRow, int, int], symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        bits, zeros, bit = level
        ones = bits.rank(at)
        return np.where((symbol >> bit) & 1, zeros + ones, at - ones)

    def statistics(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of ``text`` before ``ends``, and the intervals of suffix order they end in.

        The statistic is the length of the longest piece that ends there, holds no separator and occurs twice
        or more in the index; backward search stops at ``most``.  The text ends in a separator.
        """
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        going = np.arange(len(ends))
        for back in range(1, most + 1):
            symbol = text[ends[going] - back]
            a, b = low[going], high[going]
            for level in self.levels:
                a, b = self._down(level, symbol, a), self._down(level, symbol, b)
            twice = (symbol > 0) & (b - a > 1)
            going = going[twice]
            if not len(going):
                break
            base = self.base[symbol[twice]]
            low[going], high[going] = a[twice] + base, b[twice] + base
            length[going] = back
        return length, low, high

    def _left(self, at: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that are one symbol longer."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros, bit in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << bit
            at = np.where(one, zeros + ones, at - ones)
        return at + self.base[symbol]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order."""
        out = np.zeros(len(rows), np.int64)
        going, at, steps = np.arange(len(rows)), rows, 0
        while len(going):
            known = self.marked.get(at)
            out[going[known]] = self.places[self.marked.rank(at[known])] + steps
            going, at = going[~known], self._left(at[~known])
            steps += 1
        return out

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest text position in each interval; the intervals are equal or apart, and none is empty."""
        if not len(low):
            return np.zeros(0, np.int64)
        starts, which = np.unique(low, return_inverse=True)
        sizes = np.zeros(len(starts), np.int64)
        sizes[which] = high - low
        first = np.cumsum(sizes) - sizes
        rows = np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)
        return np.minimum.reduceat(self.locate(rows), first)[which]
