"""SentencePiece encoding and decoding that keeps byte offsets into the source.

The model file is read here: its pieces and scores, its normaliser flags and
the compiled character map (a double-array trie over source byte strings).
Normalisation takes the longest prefix that the trie knows, again and again,
and records for each normalised byte the source byte at which its rule began;
each piece of the encoding then projects to a span of source bytes. Merging
follows the pieces' scores within chunks that no piece can cross, so a chunk's
ids depend on the chunk alone and are remembered. Chunks of up to 48 letters
that are met for the first time are merged together, those of many texts at once.

Defined cases: null and empty texts encode to the end id alone (where one is
asked for) and decode to an empty text; repeated rows are coded each for
itself; an empty table gives no rows; columns other than doc_id and text are
ignored; a text is coded whole, however long.
"""

from __future__ import annotations

import array
import heapq
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .merges import LONGEST, Merger, UNKNOWN as STRANGE
from .words import worker_cache

MARK = "▁"
CACHE_CHUNKS = 400_000
CACHE_LETTERS = 64
BLOCK_ROWS = 512
GROUP_LETTERS = 1 << 19
MERGED_ROWS = 1 << 13
UNKNOWN, CONTROL, USER, UNUSED, BYTE = 2, 3, 4, 5, 6
FAR = 1 << 60
_loaded: dict[str, "PieceCoder"] = worker_cache()


def _fields(data: bytes):
    """(field number, value) pairs of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """Longest-prefix rewriting by a compiled map; an empty map leaves texts as they are."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.targets = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.targets = blob[4 + size :]

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def rule(self, source: bytes, at: int) -> tuple[bytes, int]:
        """What the longest known prefix at ``at`` becomes, and its length; else the next character."""
        units = self.units
        node = self._jump(units[0])
        found, length = -1, 0
        for i in range(at, len(source)):
            b = source[i]
            node ^= b
            unit = units[node]
            if unit & 0x800000FF != b:
                break
            node ^= self._jump(unit)
            if unit & 256:
                found, length = units[node] & 0x7FFFFFFF, i + 1 - at
        if found >= 0:
            return self.targets[found : self.targets.index(0, found)], length
        lead = source[at]
        length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return source[at : at + length], length


class PieceCoder:
    """Encoder and decoder for one byte-pair model file."""

    def __init__(self, path: str):
        self.flags = {"prefix": True, "squeeze": True, "escape": True}
        charmap, model_type, self.suffix_space, scored = b"", 1, False, []
        with open(path, "rb") as f:
            model = f.read()
        for number, value in _fields(model):
            if number == 1:
                x = {1: b"", 2: b"\0\0\0\0", 3: 1} | dict(_fields(value))
                scored.append((x[1].decode(), struct.unpack("<f", x[2])[0], x[3]))
            elif number == 2:
                spec = dict(_fields(value))
                model_type, self.suffix_space = spec.get(3, 1), bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
                charmap = spec.get(2, b"")
                for flag, n in (("prefix", 3), ("squeeze", 4), ("escape", 5)):
                    self.flags[flag] = bool(spec.get(n, 1))
        if model_type != 2 or self.suffix_space:
            raise ValueError("only byte-pair models with leading space marks are supported")
        self.map = CharacterMap(charmap)
        self.pieces = [p for p, _, _ in scored]
        self.kinds = [k for _, _, k in scored]
        merged = [i for i, k in enumerate(self.kinds) if k in (1, USER, UNUSED)]
        if any(self.kinds[i] in (USER, UNUSED) for i in merged):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {self.pieces[i]: i for i in merged}
        levels = {x: r for r, x in enumerate(sorted({scored[i][1] for i in merged}, reverse=True))}
        self.rank = {self.pieces[i]: levels[scored[i][1]] for i in merged}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.end = self.pieces.index("</s>")
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds, strict=True)], np.int32)
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        inner = "".join(p for p in self.ids if len(p) > 1)
        self.whole_marks = not any(MARK in p.lstrip(MARK) for p in self.ids)
        alone = "\n" if "\n" not in inner else ""
        self.chunks = re.compile(f"{alone}|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.plain = not self.map.units and not self.flags["squeeze"] and self.flags["escape"]
        self.known: dict[str, tuple[bytes, str]] = {}
        letters = {c for p in self.ids for c in p}
        self.symbols = np.full(max(map(ord, letters), default=0) + 2, STRANGE, np.int64)
        singles = {c: self.ids.get(c, len(self.pieces) + ord(c)) for c in letters}
        self.symbols[[ord(c) for c in singles]] = list(singles.values())
        symbol = singles | self.ids
        self.merger = Merger(
            {(symbol[p[:i]], symbol[p[i:]]): (self.rank[p], self.ids[p]) for p in self.ids for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol}
        )

    @classmethod
    def load(cls, path: str) -> "PieceCoder":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def normalize(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its bytes, and its end, the source byte."""
        source = text.encode()
        if not source:
            return "", [0]
        space = MARK.encode() if self.flags["escape"] else b" "
        out, where, at = bytearray(), [], 0
        squeeze = self.flags["squeeze"]

        def step(i: int) -> tuple[bytes, int]:
            if self.map.units:
                return self.map.rule(source, i)
            lead = source[i]
            n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return source[i : i + n], n

        if squeeze:
            while at < len(source) and (first := step(at))[0] == b" ":
                at += first[1]
            if at == len(source):
                return "", [at]
        if self.flags["prefix"]:
            out += space
            where += [at] * len(space)
        after_space = squeeze
        while at < len(source):
            target, n = step(at)
            if after_space:
                target = target.lstrip(b" ")
            if target:
                written = target.replace(b" ", space)
                out += written
                where += [at] * len(written)
                after_space = squeeze and target.endswith(b" ")
            at += n
        if squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = where[len(out)]
                del where[len(out) :]
        where.append(at)
        return out.decode(), where

    def normal(self, text: str) -> str:
        """The normalised text alone."""
        if self.plain:
            return (MARK * self.flags["prefix"] + text.replace(" ", MARK)) if text else ""
        return self.normalize(text)[0]

    def split(self, chunk: str) -> list[str]:
        """The chunk's symbols after all merges, best piece first, leftmost of equals."""
        n, rank = len(chunk), self.rank
        if n <= 48:
            parts = list(chunk)
            near = [rank.get(a + b, FAR) for a, b in zip(parts, parts[1:], strict=False)]
            while near and (best := min(near)) < FAR:
                i = near.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del near[i]
                if i:
                    near[i - 1] = rank.get(parts[i - 1] + parts[i], FAR)
                if i < len(near):
                    near[i] = rank.get(parts[i] + parts[i + 1], FAR)
            return parts
        symbols: list[str] = list(chunk)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := rank.get(symbols[i] + symbols[j], FAR)) < FAR:
                heapq.heappush(queue, (r, i, len(symbols[i]), len(symbols[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if len(symbols[i]) != a or j >= n or len(symbols[j]) != b:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s]

    def units(self, chunk: str) -> list[tuple[int, int]]:
        """(id, bytes of the chunk) in order; unknown symbols fall back to their bytes."""
        out = []
        for s in self.split(chunk):
            i = self.ids.get(s)
            size = len(s.encode())
            if i is not None:
                out.append((i, size))
            elif self.bytes:
                out += [(self.bytes[b], 1) for b in s.encode()]
            elif out and out[-1][0] == self.unknown:
                out[-1] = (self.unknown, out[-1][1] + size)
            else:
                out.append((self.unknown, size))
        return out

    def cut(self, normal: str) -> list[str]:
        return self.chunks.findall(normal) if self.whole_marks and self.bytes else [normal] if normal else []

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids, and for each its span [begin, end) of source bytes."""
        normal, where = self.normalize(text)
        ids, spans, at = [], [], 0
        for chunk in self.cut(normal):
            for i, size in self.units(chunk):
                ids.append(i)
                spans.append((where[at], where[at + size]))
                at += size
        return ids, spans

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: controls vanish, runs of byte pieces are decoded together."""
        out, run, leading = [], bytearray(), self.flags["prefix"] or self.flags["squeeze"]
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if kind == CONTROL:
                continue
            piece = " ⁇ " if kind == UNKNOWN else self.pieces[i]
            if leading and not out and piece.startswith(MARK):
                piece = piece[1:]
                leading = self.flags["squeeze"]
                if not piece:
                    continue
            out.append(piece.replace(MARK, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def remember(self, chunk: str) -> tuple[bytes, str]:
        """A chunk's ids as 4-byte integers and what they decode to; short chunks are kept for the next time."""
        ids = [self.ids.get(s) for s in self.split(chunk)]
        if None in ids:
            ids = [i for i, _ in self.units(chunk)]
            text = self.decode([self.end, *ids]) if not chunk.startswith(MARK) else " " + self.decode(ids)
        else:
            text = "".join([self.shown[i] for i in ids])
        got = (array.array("i", ids).tobytes(), text)
        if len(chunk) <= CACHE_LETTERS:
            self.known[chunk] = got
        return got

    def learn(self, chunks: list[str]) -> None:
        """Remembers chunks of up to LONGEST letters, merged together; those with letters that are no pieces go one by one."""
        chunks = sorted(chunks, key=len)
        for start in range(0, len(chunks), MERGED_ROWS):
            part = chunks[start : start + MERGED_ROWS]
            codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
            symbols = self.symbols[np.minimum(codes, len(self.symbols) - 1)]
            ids, counts = self.merger.merge(symbols, np.fromiter(map(len, part), np.int64, len(part)))
            ends = np.cumsum(counts)
            strange = np.add.reduceat(ids >= len(self.pieces), ends - counts) > 0
            raw, ends = ids.astype(np.int32).tobytes(), (4 * ends).tolist()
            for chunk, a, b in zip(part, [0, *ends], ends, strict=False):
                self.known[chunk] = (raw[a:b], chunk.replace(MARK, " "))
            for i in np.flatnonzero(strange).tolist():
                self.remember(part[i])

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """The texts' chunks, the short ones of them remembered."""
        if not self.plain:
            return [[] for _ in texts]
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        cut = [self.cut(self.normal(t)) for t in texts]
        self.learn([c for c in set(chain.from_iterable(cut)).difference(self.known) if len(c) <= LONGEST])
        return cut

    def sources(self, text: str) -> np.ndarray:
        """What ``normalize`` records, for a model that only writes marks for spaces."""
        source = np.frombuffer(text.encode(), np.uint8)
        where = np.arange(len(source), dtype=np.int32)
        if not text.isascii():
            where = np.maximum.accumulate(np.where((source & 0xC0) != 0x80, where, 0))
        wide = np.ones(len(source), np.int8)
        wide[source == 0x20] = len(MARK.encode())
        prefix = len(MARK.encode()) if self.flags["prefix"] and len(source) else 0
        return np.concatenate([np.zeros(prefix, np.int32), np.repeat(where, wide), np.array([len(source)], np.int32)])

    def encode_arrays(self, text: str, chunks: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """Ids, begins and ends of their spans of source bytes, and the decoded text, from remembered chunks (``prepare`` gives them)."""
        if not self.plain:
            ids, spans = self.encode(text)
            begins, ends = np.array(spans, np.int32).reshape(-1, 2).T
            return np.array(ids, np.int32), begins, ends, self.decode(ids)
        known = self.known
        if chunks is None:
            (chunks,) = self.prepare([text])
        got = [known.get(c) or self.remember(c) for c in chunks]
        ids = np.frombuffer(b"".join([x[0] for x in got]), np.int32)
        edge = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.sizes[ids], out=edge[1:])
        edge = self.sources(text)[edge]
        decoded = "".join([x[1] for x in got])
        if self.flags["prefix"] and decoded.startswith(" "):
            decoded = decoded[1:]
        return ids, edge[:-1], edge[1:], decoded


def groups(texts: list[str]):
    """Runs of texts of about GROUP_LETTERS letters; a longer text is a group of its own."""
    group, letters = [], 0
    for text in texts:
        if group and letters + len(text) > GROUP_LETTERS:
            yield group
            group, letters = [], 0
        group.append(text)
        letters += len(text)
    if group:
        yield group


def encode_documents(docs: DataFrame, model_path: str, add_end: bool = True) -> DataFrame:
    """doc_id, ids, begins and ends (source byte spans; the end id's is empty), decoded text."""

    def run(batches):
        coder = PieceCoder.load(model_path)
        for batch in batches:
            for start in range(0, len(batch), BLOCK_ROWS) if len(batch) else [0]:
                part = batch.slice(start, BLOCK_ROWS)
                columns, decoded = ([], [], []), []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for text, chunks in (x for g in groups(texts) for x in zip(g, coder.prepare(g), strict=True)):
                    *own, back = coder.encode_arrays(text, chunks)
                    if add_end:
                        size = len(text.encode())
                        own = [np.append(x, np.int32(y)) for x, y in zip(own, (coder.end, size, size), strict=True)]
                    for column, x in zip(columns, own, strict=True):
                        column.append(x)
                    decoded.append(back)
                offsets = pa.array(np.cumsum([0, *map(len, columns[0])]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *c]), pa.int32())) for c in columns]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "begins", "ends", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string")


def digest_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text's encoding with an end id."""
    found = encode_documents(docs, model_path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
