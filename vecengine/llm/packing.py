"""Packing of tokenised documents into fixed-length training sequences.

Vector bin packing: every example is a vector (tokens, segments, loss-bearing
tokens) and every open sequence has the rest of its capacity in the same three
dimensions. The dot-product heuristic places, again and again, the example
whose scaled vector has the largest product with the rest; where none fits
whole, one is cut to fill the sequence. A sequence that a limit ends before it
is full is cut back to a power of two, and what was cut goes on. A partition
packs its own rows in file order, so a lost task gives the same sequences again,
and nothing is shuffled; each partition ends with at most 12 short sequences.

Loss-bearing tokens come from a mask (run lengths over the text's code points,
as the chat formatter writes them) or, without one, are all tokens. The first
token of a piece has nothing before it to be predicted from and never counts.

Defined cases: a null text is an empty one and still has its end id; a null
mask leaves all tokens loss-bearing; characters beyond a mask's runs bear no
loss, and the end id bears loss if any run does; a null doc_id stays null;
repeated rows are packed each for itself; an empty table gives no rows; a text
is packed whole, however long; other columns are ignored.
"""

from __future__ import annotations

import array
import json
import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .merges import LONGEST, Merger
from .pieces import MERGED_ROWS, groups
from .words import worker_cache

CACHE_WORDS = 300_000
CACHE_LETTERS = 16 << 20
POOL = 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_loaded: dict[str, "WordEncoder"] = worker_cache()


class WordEncoder:
    """Token ids of texts as little-endian uint32 bytes, one dictionary look-up a word.

    The vocabulary's pre-tokeniser drops white space and never joins across it,
    so the ids of a text are those of its words in order. Words of ASCII and
    Latin-1 letters are cut into the pre-tokeniser's runs here, the new words of
    many texts together, and their new runs of up to 48 bytes are merged
    together by the model's own vocabulary and merges. Longer runs, and those of
    a model with other rules than plain merges, are asked of the model, once a
    run; any other word goes the full way.
    """

    #: The pre-tokeniser's pattern over the letters that SIMPLE admits.
    LETTERS = "a-zªµºß-öø-ÿ"
    RUNS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9\n]+|\n")
    BREAK = b"\xff\xff\xff\xff"
    SIMPLE = re.compile("[\x21-\x7eªµºÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = Tokenizer(self.full.model)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        self.visible = {b: 256 + i for i, b in enumerate(others)}
        self.known: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.letters = 0
        self.inner = self.last = self.merger = None
        self._read_merges(json.loads(self.full.to_str())["model"])

    def _read_merges(self, model: dict) -> None:
        """Symbols of bytes inside a run and at its end, and the merger, if the model does nothing but merge and each merge makes a symbol of its own."""
        other = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(x) for x in other):
            return
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        shown = [chr(self.visible.get(b, b)) for b in range(256)]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        if len({a + b for a, b in pairs}) < len(pairs) or not {x for c in shown for x in (c, c + suffix)} <= ids.keys():
            return
        self.inner, self.last = np.array([[ids[c], ids[c + suffix]] for c in shown], np.int64).T
        self.merger = Merger({(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)})

    @classmethod
    def load(cls, path: str) -> "WordEncoder":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def ask(self, run: str) -> bytes:
        shown = run if run.isascii() else run.encode().decode("latin-1").translate(self.visible)
        return self.as_bytes(self.model.encode(shown, add_special_tokens=False))

    def learn_runs(self, runs: list[str]) -> None:
        """Remembers the ids of runs, short ones merged together."""
        coded = sorted(((r.encode(), r) for r in runs), key=lambda x: len(x[0]))
        for start in range(0, len(coded), MERGED_ROWS):
            part = [x for x in coded[start : start + MERGED_ROWS] if self.merger and len(x[0]) <= LONGEST]
            for _, run in coded[start + len(part) : start + MERGED_ROWS]:
                self.runs[run] = self.ask(run)
            if part:
                data = np.frombuffer(b"".join([x for x, _ in part]), np.uint8)
                lengths = np.fromiter((len(x) for x, _ in part), np.int64, len(part))
                symbols, ends = self.inner[data], np.cumsum(lengths) - 1
                symbols[ends] = self.last[data[ends]]
                ids, counts = self.merger.merge(symbols, lengths)
                raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                self.runs.update((run, raw[a:b]) for (_, run), a, b in zip(part, [0, *ends], ends, strict=False))

    def learn(self, words: list[bytes]) -> None:
        """Remembers the ids of words."""
        joined = b"\n".join(words).decode("utf-8", "replace")
        texts = joined.split("\n")
        self.letters += len(joined)
        simple = [self.SIMPLE.fullmatch(t) is not None and "<|" not in t for t in texts]
        found = self.RUNS.findall("\n".join([t for t, s in zip(texts, simple, strict=True) if s]).lower())
        new = set(found).difference(self.runs)
        new.discard("\n")
        self.learn_runs(list(new))
        self.runs["\n"] = self.BREAK
        own = iter(b"".join(map(self.runs.__getitem__, found)).split(self.BREAK))
        self.known.update((w, next(own) if s else self.as_bytes(self.full.encode(t, add_special_tokens=False))) for w, t, s in zip(words, texts, simple, strict=True))

    @staticmethod
    def as_bytes(coded) -> bytes:
        return array.array("I", coded.ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out = []
        for group in groups(texts):
            if max(len(self.known), len(self.runs)) > CACHE_WORDS or self.letters > CACHE_LETTERS:
                self.known.clear()
                self.runs.clear()
                self.letters = 0
            words = [t.split() for t in group]
            new = set(chain.from_iterable(words)).difference(self.known)
            if new:
                self.learn(list(new))
            out += [b"".join(map(self.known.__getitem__, w)) for w in words]
        return out

    def encode_masked(self, text: bytes, mask: list[dict] | None) -> tuple[bytes, np.ndarray | None]:
        """Ids, and for each of them and the end id whether the mask's run that holds its first character bears loss."""
        if mask is None:
            return self.encode([text])[0], None
        coded = self.full.encode(text.decode("utf-8", "replace"), add_special_tokens=False)
        until = np.cumsum([r["chars"] for r in mask])
        bears = np.array([*(bool(r["loss"]) for r in mask), False])
        at = np.searchsorted(until, np.array([a for a, _ in coded.offsets], np.int64), side="right")
        return self.as_bytes(coded), np.append(bears[at], bears.any())


class Example:
    """A document's ids, how many of them are placed, and, where it has a mask, its loss-bearing ids before each position."""

    __slots__ = ("key", "ids", "start", "total", "before")

    def __init__(self, key, ids: bytes, loss: np.ndarray | None):
        self.key, self.ids, self.start, self.total = key, ids, 0, len(ids) // 4
        self.before = None if loss is None else np.concatenate([[0], np.cumsum(loss)])

    def loss(self, length: int) -> int:
        """Loss-bearing tokens of the next piece of ``length`` tokens, its first one never among them."""
        if self.before is None:
            return length - 1
        return int(self.before[self.start + length] - self.before[self.start + 1])

    def longest(self, tokens: int, loss: int) -> int:
        """The longest next piece within both limits; one token always is."""
        tokens = min(tokens, self.total - self.start)
        if self.before is None:
            return min(tokens, loss + 1)
        over = np.searchsorted(self.before, self.before[self.start + 1] + loss, side="right") - 1
        return max(1, min(tokens, int(over) - self.start))


class Packer:
    """Packs a stream of (key, ids) into sequences; ``pieces`` fills with rows."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, first_sequence: int):
        self.most = (max_tokens, max_segments, max_loss)
        self.next = first_sequence
        self.pool: list[Example] = []
        self.pieces: list[tuple] = []

    def add(self, key, ids: bytes, loss: np.ndarray | None = None) -> None:
        x = Example(key, ids, loss)
        room = self.most[0]
        while x.total - x.start >= room and x.loss(room) <= self.most[2]:
            self._place(x, room, 0)
            self.next += 1
        if x.start < x.total:
            self.pool.append(x)
        if len(self.pool) >= 2 * POOL:
            self.drain(POOL)

    def _place(self, x: Example, length: int, offset: int) -> None:
        crc = zlib.crc32(memoryview(x.ids)[4 * x.start : 4 * (x.start + length)])
        self.pieces.append((x.key, x.start, length, crc, x.total, self.next, offset, x.loss(length)))
        x.start += length

    def drain(self, down_to: int = 0) -> None:
        """Fills sequences until at most ``down_to`` examples wait."""
        size = np.array([x.total - x.start for x in self.pool], float)
        loss = np.array([x.loss(x.total - x.start) for x in self.pool], float)
        waiting = len(self.pool)
        while waiting > down_to:
            waiting -= self._fill(size, loss)
        self.pool = [x for x, left in zip(self.pool, size, strict=True) if left < np.inf]

    def _fill(self, size: np.ndarray, loss: np.ndarray) -> int:
        """Fills one sequence from the pool; placed examples get an infinite size. How many of them there are."""
        most = self.most
        tokens, segments, bearing = most
        chosen: list[tuple[int, int]] = []
        while tokens > 0 and segments > 0 and len(chosen) < len(size):
            product = size * (tokens / most[0] ** 2) + segments / most[1] ** 2 + loss * (bearing / most[2] ** 2)
            product[(size > tokens) | (loss > bearing)] = -1.0
            i = int(product.argmax())
            if product[i] >= 0:
                take, given = int(size[i]), int(loss[i])
                size[i] = np.inf
            elif bearing > 0 and (i := int(size.argmin())) not in (c for c, _ in chosen) and size[i] < np.inf:
                take = self.pool[i].longest(tokens, bearing)
                given = self.pool[i].loss(take)
                if take < tokens:
                    bearing = given
            else:
                break
            chosen.append((i, take))
            tokens, segments, bearing = tokens - take, segments - 1, bearing - given
        used = most[0] - tokens
        over = used - (1 << (used.bit_length() - 1)) if tokens else 0
        while over > 0:
            i, take = chosen.pop()
            cut = min(take, over)
            over -= cut
            if take > cut:
                chosen.append((i, take - cut))
            x = self.pool[i]
            size[i] = x.total - x.start
        offset = ended = 0
        for i, take in chosen:
            x = self.pool[i]
            self._place(x, take, offset)
            offset += take
            if x.start < x.total:
                size[i], loss[i] = x.total - x.start, x.loss(x.total - x.start)
            else:
                size[i] = np.inf
                x.ids = b""
                ended += 1
        self.next += 1
        return ended


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    max_tokens: int = 4096,
    max_segments: int = 512,
    max_loss: int = 4096,
    mask_column: str | None = None,
) -> DataFrame:
    """Pieces of the documents with the sequence and offset at which they lie.

    A sequence holds at most ``max_tokens`` tokens, ``max_segments`` pieces and
    ``max_loss`` loss-bearing tokens; ``mask_column`` names an array of (chars,
    loss) structs, the run lengths of each text's mask. ``start`` counts the document's ids before
    the piece, ``ids_crc32`` is over its ids as unsigned 32-bit little-endian.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = WordEncoder.load(tokenizer_path)
        packer = Packer(max_tokens, max_segments, max_loss, TaskContext.get().partitionId() << 36)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.large_binary())
            masks = batch.column(2) if mask_column else None
            for i in range(0, len(keys), 256):
                part = [t or b"" for t in texts.slice(i, 256).to_pylist()]
                if masks is None:
                    for key, ids in zip(keys[i : i + 256], encoder.encode(part), strict=True):
                        packer.add(key, ids + end)
                else:
                    for j, text in enumerate(part):
                        ids, loss = encoder.encode_masked(text, masks[i + j].as_py())
                        packer.add(keys[i + j], ids + end, loss)
            if packer.pieces:
                yield as_batch(packer)
        packer.drain()
        if packer.pieces:
            yield as_batch(packer)

    return docs.select("doc_id", "text", *([mask_column] if mask_column else [])).mapInArrow(run, SCHEMA)


def as_batch(packer: Packer) -> pa.RecordBatch:
    columns = list(zip(*packer.pieces, strict=True))
    packer.pieces = []
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
