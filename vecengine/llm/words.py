"""Words of many texts at once, as numpy arrays over the UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit
polynomials of the bytes, finished by a bijective mixer; grams combine word
hashes. Everything is a function of the text alone, never of its batch. Null
texts count as empty; empty ones have no words; a text is read whole, and beyond
some bytes for each of its own, memory does not grow with its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
SEGMENT = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}
_caches: list[dict] = []


def worker_cache() -> dict:
    """A dictionary that lives in a Python worker from task to task, until a task of another operator needs the room."""
    _caches.append({})
    return _caches[-1]


def make_room() -> None:
    """Empties the workers' caches: Spark gives one worker to the tasks of many stages."""
    for cache in _caches:
        cache.clear()
    pa.default_memory_pool().release_unused()


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SEGMENT + 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def text_chunks(batch: pa.RecordBatch, column: str = "text", target: int = CHUNK_BYTES):
    """(first row, bytes, offsets) for runs of rows of about ``target`` bytes; null texts are empty."""
    make_room()
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + target, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


class Words:
    """Words of consecutive texts: byte ranges, and ``ptr`` with the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        n = len(data)
        space = _SPACE[data]
        edge = np.ones(n + 1, bool)
        edge[1:n] = space[:-1]
        edge[offsets] = True
        self.starts = np.flatnonzero(~space & edge[:n])
        edge[:n] = space
        edge[n] = True
        edge[offsets] = True
        self.ends = np.flatnonzero(~space & edge[1:]) + 1
        self.ptr = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.ptr)
        self.text_of = np.repeat(np.arange(len(self.counts)), self.counts)
        self.until = self.ptr[1:][self.text_of] if len(self.starts) else np.empty(0, np.int64)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + SEGMENT, side="right")))
            begin, end = int(self.starts[i]), int(self.ends[j - 1])
            if end - begin > SEGMENT:
                out[i] = self._long_hash(begin, end)
            else:
                n = end - begin
                up, down = _power_tables(n + 1)
                total = np.zeros(n + 1, np.uint64)
                np.cumsum((self.data[begin:end].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
                a, b = self.starts[i:j] - begin, self.ends[i:j] - begin
                out[i:j] = (total[b] - total[a]) * down[a]
            i = j
        return mix(out + (self.ends - self.starts).astype(np.uint64))

    def _long_hash(self, begin: int, end: int) -> int:
        """The polynomial of one word that is longer than a segment."""
        up, _ = _power_tables(SEGMENT)
        total = 0
        for at in range(begin, end, SEGMENT):
            block = self.data[at : min(at + SEGMENT, end)].astype(np.uint64) + np.uint64(1)
            total += int((block * up[: len(block)]).sum(dtype=np.uint64)) * pow(_BASE, at - begin, 1 << 64)
        return total & ((1 << 64) - 1)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the runs of ``k`` words within one text, and the runs' hashes."""
        n = len(hashes)
        at = np.flatnonzero(np.arange(n) + k <= self.until)
        return at, gram_hash(hashes, at, k)


def gram_hash(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words that begin at ``at``."""
    total = np.full(len(at), k, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[at + j]
    return mix(total)
