"""A compressed full-text index over integer symbols: wavelet matrix, counts, and the earliest occurrence of each prefix.

The index is over the reversed sequence, so that backward search takes a pattern
from its first symbol to its last. Rows are ordered by the first ``depth``
symbols of the reversed suffixes, which makes intervals exact for patterns of up
to ``depth`` symbols. For each length, the least key of the occurrences in each
interval is kept by the interval's first row; the order itself is dropped.

Defined cases: an empty sequence has no occurrences; 0 separates and is in no
pattern; symbols beyond the greatest of the sequence may not be asked for.
"""

from __future__ import annotations

import numpy as np


class BitRanks:
    """A bit vector in 64-bit words with running counts."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Index of a symbol sequence for patterns of at most ``depth`` (a power of two) symbols; ``order_key`` orders their occurrences.

    Symbols are 1..top; 0 separates, begins and ends the sequence and is in no pattern.
    """

    def __init__(self, symbols: np.ndarray, order_key: np.ndarray, depth: int):
        n = len(symbols)
        self.depth, self.top = depth, int(symbols.max(initial=0))
        symbols = symbols[::-1]
        rank = symbols.astype(np.uint64)
        step = 1
        while step < depth:
            ahead = np.zeros(n, np.uint64)
            ahead[: n - step] = rank[step:]
            _, inverse = np.unique(rank * (rank.max(initial=0) + np.uint64(1)) + ahead, return_inverse=True)
            rank = inverse.astype(np.uint64)
            step *= 2
        rows = np.argsort(rank, kind="stable")
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.top + 1))]).astype(np.int64)
        self.first, self.least = [], []
        new = np.zeros(n, bool)
        new[:1] = True
        for length in range(1, depth + 1):
            here = symbols[np.minimum(rows + length - 1, n - 1)]
            new[1:] |= here[1:] != here[:-1]
            begin = np.maximum(n - length - rows, 0)
            self.first.append(BitRanks(new))
            self.least.append(np.minimum.reduceat(order_key[begin], np.flatnonzero(new)) if n else order_key[:0])
        last = symbols[rows - 1]
        self.levels: list[tuple[int, BitRanks]] = []
        for shift in range(max(1, self.top.bit_length()) - 1, -1, -1):
            bits = ((last >> shift) & 1).astype(bool)
            self.levels.append((shift, BitRanks(bits)))
            last = np.concatenate([last[~bits], last[bits]])
        everything = np.arange(self.top + 1)
        self.origin = self._walk(everything, np.zeros(self.top + 1, np.int64))

    def _walk(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, level in self.levels:
            one = level.ones(i)
            i = np.where((symbols >> shift) & 1, level.zeros + one, i - one)
        return i

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol at their end."""
        n = len(symbol)
        both = self._walk(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.counts[symbol] - self.origin[symbol]
        return start + both[:n], start + both[n:]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals [low, high) of rows for each pattern (one a row)."""
        low, high = self.counts[patterns[:, 0]], self.counts[patterns[:, 0] + 1]
        for j in range(1, patterns.shape[1]):
            low, high = self.extend(low, high, patterns[:, j])
        return low, high

    def earliest(self, length: int, low: np.ndarray) -> np.ndarray:
        """Least key of the occurrences in the intervals of patterns of ``length`` symbols that begin at ``low``."""
        return self.least[length - 1][self.first[length - 1].ones(low + 1) - 1]

    def matching_statistics(self, patterns: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each pattern, which occurs in the sequence with the key ``own``, how many of its symbols from the first on also occur with a lesser key."""
        length = np.zeros(len(patterns), np.int64)
        live = np.arange(len(patterns))
        low, high = self.counts[patterns[:, 0]], self.counts[patterns[:, 0] + 1]
        for j in range(patterns.shape[1]):
            if j:
                low, high = self.extend(low, high, patterns[live, j])
            more = self.earliest(j + 1, low) < own[live]
            live, low, high = live[more], low[more], high[more]
            length[live] = j + 1
        return length
