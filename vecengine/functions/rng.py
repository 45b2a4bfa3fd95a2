"""Reproducible 64-bit random numbers on the driver: xoroshiro128++ seeded by SplitMix64.

Both are public algorithms by Blackman, Steele and Vigna. Each stream starts
2**64 draws after the one before it.
"""

from __future__ import annotations

from collections.abc import Iterator

_MASK = (1 << 64) - 1
#: SplitMix64's increment and multipliers, and the jump polynomial of xoroshiro128++.
_GOLDEN, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_JUMP = (0x2BD7A6A6E99C2DDC, 0x0992CCAF6A6FCA05)


def _left(x: int, k: int) -> int:
    return ((x << k) | (x >> (64 - k))) & _MASK


def splitmix(seed: int) -> Iterator[int]:
    while True:
        seed = (seed + _GOLDEN) & _MASK
        z = ((seed ^ (seed >> 30)) * _MIX1) & _MASK
        z = ((z ^ (z >> 27)) * _MIX2) & _MASK
        yield z ^ (z >> 31)


class Stream:
    """One generator."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high

    def raw(self) -> int:
        """The next unsigned 64-bit number."""
        out = (_left((self.low + self.high) & _MASK, 17) + self.low) & _MASK
        mixed = self.low ^ self.high
        self.low = _left(self.low, 49) ^ mixed ^ ((mixed << 21) & _MASK)
        self.high = _left(mixed, 28)
        return out

    def jumped(self) -> "Stream":
        """The stream 2**64 draws ahead."""
        ahead, low, high = Stream(self.low, self.high), 0, 0
        for word in _JUMP:
            for bit in range(64):
                if word >> bit & 1:
                    low, high = low ^ ahead.low, high ^ ahead.high
                ahead.raw()
        return Stream(low, high)

    def uniform(self, bits: int = 53) -> float:
        """A uniform number in [0, 1) from the high ``bits``: 53 for double, 24 for single precision."""
        return (self.raw() >> (64 - bits)) / (1 << bits)


def streams(n: int, seed: int, skip: int = 0) -> list[Stream]:
    """``n`` streams, after ``skip`` jumps from the seed."""
    draw = splitmix(seed & _MASK)
    stream = Stream(next(draw), next(draw))
    out = []
    for i in range(skip + n):
        if i >= skip:
            out.append(Stream(stream.low, stream.high))
        if i < skip + n - 1:
            stream = stream.jumped()
    return out
