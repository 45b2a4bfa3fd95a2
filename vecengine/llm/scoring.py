"""Language-model scores by a weighted backoff automaton.

Counts come from the training texts (crc32 of the id not divisible by 10). The
automaton has a root, a start state and a state for every training word. A
state holds an arc for every word pair seen in training and one failure arc to
the root; the root has an arc for every training word and one for unknown ones.
Pairs are smoothed with a Dirichlet prior of weight ``strength`` on the root's
probabilities p, which gives for a state h and a word w

    arc      log10((c(h, w) + strength * p(w)) / (c(h) + strength))   if seen
    failure  log10(strength / (c(h) + strength)), then the root's log10(p(w))

so that each state's weights add up to one. A text is read once from left to
right, the state being the word before, and the weights add up.

The automaton grows with the corpus and is never broadcast. Every step of every
text goes once through one shuffle, in sorted and delta-coded blocks: to a
bucket that holds all steps of its pairs (and, for a word beyond the head, all
steps into that word). There the training steps give the counts, the arcs are
weighed, and each text gets back the sum of its steps. What travels to all
tasks is of fixed size: counts of the HEAD most frequent words, and of the pairs
that make up more than one in HOT_SHARE training steps, which are weighed where
the text is read, so that no bucket holds a frequent pair. A word beyond the
head has at most one in HEAD of the training steps.

Defined cases: null and empty texts are their end alone; a null doc_id counts
as the id "" and is held out; repeated rows are scored each for itself; an
empty table gives no rows; without training texts every token is unknown with
probability one; texts are read whole; other columns are ignored. Rows of one
scan have to come in the same order when a lost task is run again, as those of
files do.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import materialize, release
from .words import Words, mix, text_chunks

HEAD = 1 << 16
HOT_SHARE = 1 << 16
HOT_LEAST = 64
START = HEAD
BLOCK_TOKENS = 3 << 18
BLOCK_ROWS = 50_000
BUCKET_STEPS = 1 << 20
STRENGTH = 200.0
END = np.uint64(0x5851F42D4C957F2D)
BEGIN = np.uint64(0x2545F4914F6CDD1D)
OUTSIDE = np.uint64(1 << 63)
PRIOR = 0.1


def is_training(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0 for i in ids], bool)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, each text followed by its end, and where texts begin."""
    words = Words(data, offsets, lower=True)
    n = len(offsets) - 1
    out = np.empty(len(words.starts) + n, np.uint64)
    out[np.arange(len(words.starts)) + words.text_of] = words.hashes()
    begin = words.ptr + np.arange(n + 1)
    out[begin[1:] - 1] = END
    return out, begin


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all training tokens."""

    def merged(parts):
        words, inverse = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "c"])

    def run(batches):
        parts: list[tuple] = []
        for batch in batches:
            batch = batch.filter(pa.array(is_training(batch.column(0).to_pylist())))
            for _, data, offsets in text_chunks(batch):
                parts.append(np.unique(tokens(data, offsets)[0], return_counts=True))
                if sum(len(w) for w, _ in parts) > 2 * BLOCK_TOKENS:
                    yield merged(parts)
        if parts:
            yield merged(parts)

    partial = docs.select("doc_id", "text").mapInArrow(run, "word long, c long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"))


class Head:
    """The most frequent words by hash, with their counts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.sorted, self.place, self.counts = words[order], order, counts

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word by frequency, or HEAD + 1 where it is not among them."""
        if not len(self.sorted):
            return np.full(len(hashes), HEAD + 1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.place[at], HEAD + 1)


def most_frequent(counts: DataFrame) -> Head:
    """The words of the highest counts, at most HEAD of them; a histogram of counts sets the bound, so no more rows ever travel."""
    step = F.floor(F.log("c") * 256)
    found = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    cut, total = None, 0
    for value, n in found:
        total += n
        if total > HEAD:
            break
        cut = value
    rows = counts.where(step >= cut if cut is not None else F.lit(False)).toPandas().sort_values(["c", "word"], ascending=[False, True])
    return Head(rows["word"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64))


class Block(NamedTuple):
    """Consecutive texts, training ones first: ids, how many train, tokens of each text, and all tokens in order."""

    ids: list
    train: int
    lengths: np.ndarray
    hashes: np.ndarray

    def states(self) -> np.ndarray:
        """The word before each token, BEGIN at a text's first."""
        before = np.empty(len(self.hashes), np.uint64)
        before[1:] = self.hashes[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = BEGIN
        return before

    def ranks(self, head: Head) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the word before each token (START at a text's first) and of the token."""
        rank = head.rank(self.hashes)
        before = np.empty(len(rank), np.int64)
        before[1:] = rank[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = START
        return before, rank


def token_blocks(batches, training: bool = False):
    """Blocks of about BLOCK_TOKENS tokens; of training texts only where asked for."""
    parts: list[tuple] = []

    def joined() -> Block:
        ids = [i for p in parts for i in p[0]]
        train, lengths, hashes = (np.concatenate([p[j] for p in parts]) for j in (1, 2, 3))
        order = np.argsort(~train, kind="stable")
        begin, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
        moved = np.arange(len(hashes)) + np.repeat(begin - (np.cumsum(size) - size), size)
        parts.clear()
        return Block([ids[i] for i in order], int(train.sum()), size, hashes[moved])

    for whole in batches:
        for start in range(0, whole.num_rows, 8192):
            batch = whole.slice(start, 8192)
            train = is_training(batch.column(0).to_pylist())
            if training:
                batch, train = batch.filter(pa.array(train)), train[train]
            ids = batch.column(0).to_pylist()
            for row, data, offsets in text_chunks(batch):
                hashes, begin = tokens(data, offsets)
                n = len(begin) - 1
                parts.append((ids[row : row + n], train[row : row + n], np.diff(begin), hashes))
                if sum(len(p[3]) for p in parts) >= BLOCK_TOKENS or sum(len(p[0]) for p in parts) >= BLOCK_ROWS:
                    yield joined()
    if parts:
        yield joined()


def hot_pairs(docs: DataFrame, head: Head, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (state's rank, word's rank), rising, and counts of the pairs of at least ``least`` training steps."""
    spark = docs.sparkSession
    often = int((head.counts >= least).sum())
    shared = spark.sparkContext.broadcast(head)

    def run(batches):
        for block in token_blocks(batches, training=True):
            before, rank = block.ranks(shared.value)
            both = (rank < often) & ((before < often) | (before == START))
            keys, counts = np.unique(before[both] << 16 | rank[both], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], ["key", "c"])

    if not often:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = docs.select("doc_id", "text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    rows = found.where(F.col("c") >= least).toPandas().sort_values("key")
    return rows["key"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)


def planes(values: np.ndarray) -> bytes:
    """Integers as bytes, the lowest bytes of all first: equal high bytes lie together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplaned(data: bytes, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(wide, -1).T).reshape(-1).view(kind)


class Automaton:
    """Weights (log10) of the root and the states; counts are given, or are those of the head."""

    def __init__(self, head: Head, total: int, distinct: int, texts: int, hot: tuple[np.ndarray, np.ndarray], strength: float):
        self.head, self.hot, self.strength = head, hot, strength
        self.norm = total + PRIOR * (distinct + 1)
        self.root = np.log10(self.chance(head.counts))
        self.entry = np.append(self.enter(head.counts), np.zeros(START + 1 - len(head.counts)))
        self.entry[START] = self.enter(np.array([texts]))[0]
        near, far = int(head.counts.sum()), total - int(head.counts.sum())
        self.buckets = (max(1, -(-near // BUCKET_STEPS)), max(1, -(-near // (4 * BUCKET_STEPS))), max(1, -(-far * 2 // BUCKET_STEPS)))

    def chance(self, c: np.ndarray) -> np.ndarray:
        return (c + PRIOR) / self.norm

    def enter(self, c: np.ndarray) -> np.ndarray:
        """What every weight that leaves a state of count c has in common."""
        return -np.log10(c + self.strength)

    def leave(self, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The rest of a step's weight: its arc's where the pair was seen, else the failure arc's and the root's."""
        return np.where(pair > 0, np.log10(pair + self.strength * self.chance(word)), np.log10(self.strength) + np.log10(self.chance(word)))


def sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)


def steps(block: Block, a: Automaton):
    """What a block's texts gather here (n_known, base, score), and their other steps as (bucket, major, minor, row)."""
    n = len(block.ids)
    row = np.repeat(np.arange(n), block.lengths)
    before, rank = block.ranks(a.head)
    near = rank < HEAD
    known = sums(row, near, n)
    base = sums(row[near], a.root[rank[near]], n)
    enters = before <= START
    score = sums(row[enters], a.entry[before[enters]], n)
    keys, counts = a.hot
    here = np.zeros(len(rank), bool)
    if len(keys):
        asked = before << 16 | rank
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        here = near & enters & (keys[at] == asked)
        score += sums(row[here], a.leave(counts[at[here]], a.head.counts[rank[here]]), n)
    kind = np.where(near, np.where(enters, 0, 1), 2)
    state = block.states()
    code = np.where(enters, before.astype(np.uint64), state | OUTSIDE)
    major = np.where(kind == 0, (before << 16 | rank).astype(np.uint64), np.where(kind == 1, state, block.hashes))
    minor = np.where(kind == 0, np.uint64(0), np.where(kind == 1, rank.astype(np.uint64), code))
    count = np.array(a.buckets, np.uint64)
    bucket = (mix(major) % count[kind]).astype(np.int64) + np.concatenate([[0], np.cumsum(a.buckets)])[kind]
    rest = np.flatnonzero(~here)
    order = rest[np.argsort(major[rest])]
    order = order[np.argsort(bucket[order] * 2 + (minor[order] >= OUTSIDE), kind="stable")]
    return (known, base, score), (bucket[order], major[order], minor[order], row[order])


STEPS = "bucket long, block long, train int, major binary, minor binary, row binary, summary binary"
SUMS = "block long, row binary, known binary, base binary, score binary, summary binary"


def summary_bytes(block: Block, found: tuple) -> bytes:
    null = np.array([i is None for i in block.ids])
    held = np.arange(len(block.ids)) >= block.train
    ids = np.array([0 if i is None else i for i in block.ids], np.int64)
    return np.stack([ids, null, held, block.lengths, found[0].astype(np.int64), found[1].view(np.int64), found[2].view(np.int64)]).astype(np.int64).tobytes()


def send(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """The steps of all texts, one row for each block and bucket; a block's own sums go along with one of them."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        a = shared.value
        name = TaskContext.get().partitionId() << 24
        for block in token_blocks(batches):
            found, (bucket, major, minor, row) = steps(block, a)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            narrow = row.astype(np.uint16)
            own = [name % sum(a.buckets)]
            columns = [
                pa.array(np.concatenate([bucket[cut[:-1]], own]).astype(np.int64)),
                pa.array(np.full(len(spans) + 1, name)),
                pa.array(np.full(len(spans) + 1, block.train, np.int32)),
                pa.array([*(planes(np.diff(major[i:j], prepend=np.uint64(0))) for i, j in spans), None], pa.binary()),
                pa.array([*(planes(minor[i:j]) for i, j in spans), None], pa.binary()),
                pa.array([*(planes(narrow[i:j]) for i, j in spans), None], pa.binary()),
                pa.array([*(None for _ in spans), summary_bytes(block, found)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in STEPS.split(", ")])
            name += 1

    return docs.select("doc_id", "text").mapInArrow(run, STEPS)


def counted(keys: np.ndarray, train: np.ndarray) -> np.ndarray:
    """For each key, how many training steps have it."""
    _, inverse = np.unique(keys, return_inverse=True)
    return np.bincount(inverse[train], minlength=int(inverse.max(initial=-1)) + 1)[inverse]


def weigh_bucket(table: pa.Table, a: Automaton) -> pa.Table:
    """The sums of each block's texts over the steps in this bucket."""
    passed = table.filter(pa.compute.is_valid(table.column("summary")))
    table = table.filter(pa.compute.is_null(table.column("summary")))
    columns: list[list] = [[] for _ in range(6)]
    if table.num_rows:
        bucket = table.column("bucket")[0].as_py()
        kind = int(np.searchsorted(np.cumsum(a.buckets), bucket, side="right"))
        major, minor, row = ([unplaned(x.as_py(), t) for x in table.column(c)] for c, t in (("major", np.uint64), ("minor", np.uint64), ("row", np.uint16)))
        size = np.array([len(x) for x in row])
        major, minor, row = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in major]), np.concatenate(minor), np.concatenate(row).astype(np.int64)
        block = np.repeat(np.arange(len(size)), size)
        train = row < table.column("train").to_numpy()[block]
        pair = counted(major if kind == 0 else mix(major) ^ mix(minor + np.uint64(1)), train)
        if kind == 2:
            word = counted(major, train)
            score = a.leave(pair, word) + a.enter(word)
        else:
            word = a.head.counts[(major & np.uint64(HEAD - 1) if kind == 0 else minor).astype(np.int64)]
            score = a.leave(pair, word)
        owner, inverse = np.unique(block << 16 | row, return_inverse=True)
        n = len(owner)
        score = sums(inverse, score, n)
        known, base = (sums(inverse, word > 0, n), sums(inverse, np.log10(a.chance(word)), n)) if kind == 2 else (np.zeros(0), np.zeros(0))
        cut = np.searchsorted(owner, np.arange(len(size) + 1) << 16)
        narrow = (owner & 0xFFFF).astype(np.uint16)
        for name, i, j in zip(table.column("block").to_pylist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own = (name, narrow[i:j].tobytes(), known[i:j].astype(np.int32).tobytes(), base[i:j].tobytes(), score[i:j].tobytes(), None)
            for column, x in zip(columns, own, strict=True):
                column.append(x)
    for name, data in zip(passed.column("block").to_pylist(), passed.column("summary").to_pylist(), strict=True):
        for column, x in zip(columns, (name, None, None, None, None, data), strict=True):
            column.append(x)
    kinds = [pa.int64(), *[pa.binary()] * 5]
    return pa.table({x.split()[0]: pa.array(c, k) for x, c, k in zip(SUMS.split(", "), columns, kinds, strict=True)})


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def add_up(table: pa.Table, total: int) -> pa.Table:
    """The rows of one block."""
    whole = next(x.as_py() for x in table.column("summary") if x.is_valid)
    ids, null, held, lengths, known, base, score = np.frombuffer(whole, np.int64).reshape(7, -1).copy()
    base, score = base.view(np.float64), score.view(np.float64)
    for r, k, b, s, other in zip(*(table.column(c) for c in ("row", "known", "base", "score", "summary")), strict=True):
        if not other.is_valid:
            row = np.frombuffer(r.as_py(), np.uint16)
            score[row] += np.frombuffer(s.as_py())
            if len(b.as_py()):
                base[row] += np.frombuffer(b.as_py())
                known[row] += np.frombuffer(k.as_py(), np.int32)
    columns = [pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(lengths), pa.array(known), pa.array(np.full(len(ids), total)), pa.array(base), pa.array(score)]
    return pa.table(dict(zip([x.split()[0] for x in SCORES.split(", ")], columns, strict=True)))


def score_documents(docs: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    counts = materialize(token_counts(docs), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    texts = counts.where(F.col("word") == int(END.astype(np.int64))).agg(F.sum("c")).first()[0] or 0
    head = most_frequent(counts)
    hot = hot_pairs(docs, head, max(HOT_LEAST, -(-total // HOT_SHARE)))
    release(spark, counts)
    automaton = Automaton(head, int(total), int(distinct), int(texts), hot, strength)
    shared = spark.sparkContext.broadcast(automaton)
    found = send(docs, automaton).groupBy("bucket").applyInArrow(lambda t: weigh_bucket(t, shared.value), SUMS)
    return found.groupBy("block").applyInArrow(lambda t: add_up(t, int(total)), SCORES)
