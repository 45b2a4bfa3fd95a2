"""Byte-pair merges of many short rows of symbols at once.

Every row is merged by the rule of one row alone: the pair of best rank first,
the leftmost of equals, until no neighbours form a pair. A round makes one
merge in each row that still has one, so no row's result hangs on the others.

Defined cases: no rows give none; a row of one symbol stays as it is; symbols
that no pair knows are never merged.
"""

from __future__ import annotations

import numpy as np

FAR = 1 << 60
SYMBOL_BITS = 24
NONE = (1 << SYMBOL_BITS) - 1
UNKNOWN = NONE - 1
GONE = -1
LONGEST = 48
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Merger:
    """Merges by a table of pairs: (left, right) -> (rank, symbol made), symbols below UNKNOWN."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        bits = (8 * len(pairs) + 8).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, FAR, np.int64)
        keys = np.array([(a << SYMBOL_BITS) | b for a, b in pairs], np.int64)
        values = np.array([(r << (SYMBOL_BITS + 6)) | made for r, made in pairs.values()], np.int64)
        at = self._slots(keys)
        while len(keys):
            first = np.unique(at, return_index=True)[1]
            first = first[self.keys[at[first]] < 0]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> self.shift).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pairs' rank above 6 bits for a position and the symbol made; FAR where there is no pair."""
        keys = (left << SYMBOL_BITS) | right
        at = self._slots(keys)
        seen = self.keys[at]
        astray = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(astray):
            at[astray] = (at[astray] + 1) & self.mask
            seen = self.keys[at[astray]]
            astray = astray[(seen != keys[astray]) & (seen >= 0)]
        return self.values[at]

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' symbols after their merges, one row behind the other, and how many each has; ``symbols`` holds the rows likewise.

        No row is longer than LONGEST. Rows of about one length are best merged together.
        """
        n, m = int(lengths.max(initial=0)), len(lengths)
        grid = np.full((n + 2, m), NONE, np.int64)
        ends = np.cumsum(lengths)
        col = np.repeat(np.arange(m), lengths)
        grid[np.arange(len(symbols)) - (ends - lengths)[col] + 1, col] = symbols
        near = self.find(grid[:-1].ravel(), grid[1:].ravel()).reshape(n + 1, m)
        near += np.arange(n + 1)[:, None] << SYMBOL_BITS
        flat = grid.ravel()
        after = np.repeat(np.arange(1, n + 3, dtype=np.int64), m)
        before = after - 2
        cols = np.arange(m)
        while len(cols):
            best = near.min(axis=0)
            live = np.flatnonzero(best < FAR)
            if 4 * len(live) < 3 * len(cols):
                near, cols, best = near[:, live], cols[live], best[live]
                live = np.arange(len(cols))
            key, c = best[live], cols[live]
            row = (key >> SYMBOL_BITS) & 63
            i = row * m + c
            gone = after[i]
            j = gone * m + c
            above, below = before[i], after[j]
            k = below * m + c
            made = key & NONE
            flat[i], flat[j] = made, GONE
            after[i], before[k] = below, row
            near[gone, live] = FAR
            near[row, live] = self.find(made, flat[k]) + (row << SYMBOL_BITS)
            near[above, live] = self.find(flat[above * m + c], made) + (above << SYMBOL_BITS)
        rows = grid[1:-1].T
        kept = (rows != GONE) & (rows != NONE)
        return rows[kept], kept.sum(axis=1)
