"""Removal of passages that occur earlier, by compressed full-text indexes per shard.

A window is 20 consecutive words. Equal windows have equal minimisers (the
least hash among their five-word grams), so windows are routed to shards by
minimiser, and only minimisers that occur twice anywhere are routed at all. In
a shard, the routed stretches become an FM-index over grams at a stride of one
gram; a window is four symbols. Each stretch is streamed through backward
search, which gives the matching statistic of each start: how many grams from
there on also occur earlier, up to the four that the threshold asks for. Starts
that reach the threshold are reported.
Minimisers of a hot passage are salted over several shards by document; what is
first in its salted shard is settled by a minimum over window prints. Copies of
a whole text start earlier in every window, so only the first of them is routed.

The order is (doc_id, start). Windows are judged on the input, and each word
covered by a reported window goes. Words are compared by hashes: 48 bits each on
the way to a shard, where two windows that differ in one word alone are taken for
equal with a chance of 2**-48, and prints of 127 bits between salted shards.

Defined cases: null and empty texts have no words, lose nothing, and keep an
empty text; texts shorter than a window lose nothing; of rows that repeat a
doc_id the text of the least sha-256 digest is the document's, rows with that
text lose the same words, and rows with another one lend and lose nothing; rows
with a null doc_id take no part and lose nothing; an empty table gives no rows;
other columns, whatever their names, are ignored (or, by ``remove_passages``,
kept as they are).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .fmindex import FMIndex
from .shared import bit_map, heavy_join, in_bit_map, materialize, one_text_each, release, unused
from .words import Words, gram_hash, mix, text_chunks

HASH_BYTES = 6
WHOLE = -1
GRAM = 5
WINDOW = 20
DEPTH = WINDOW // GRAM
SPAN = WINDOW - GRAM + 1
HOT = 2000
SHARD_WORDS = 250_000
ROWS = 512


def minimizer_runs(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser hash of each run of windows with one minimiser."""
    n = len(hashes)
    starts = np.flatnonzero(np.arange(n) + WINDOW <= words.until)
    none = np.empty(0, np.int64)
    if not len(starts):
        return none, none, np.empty(0, np.uint64)
    at, grams = words.grams(hashes, GRAM)
    value = np.full(n + SPAN, np.iinfo(np.uint64).max, np.uint64)
    value[at] = grams
    best = np.arange(n + SPAN)
    step = 1
    while step < SPAN:
        later = np.minimum(np.arange(n + SPAN) + step, n + SPAN - 1)
        best = np.where(value[best] <= value[best[later]], best, best[later])
        step *= 2
    chosen = best[starts]
    change = np.ones(len(starts), bool)
    change[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(change)
    return starts[first], np.diff(np.append(first, len(starts))), value[chosen[first]]


def routed_runs(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(anchor, doc, run) of documents in the bit map of ``ids``: run packs the first window's place and the number of windows."""
    wanted = docs.sparkSession.sparkContext.broadcast(bit_map(ids))

    def run(batches):
        for batch in batches:
            batch = in_bit_map(batch, wanted.value)
            for row, data, offsets in text_chunks(batch):
                words = Words(data, offsets)
                at, count, anchor = minimizer_runs(words, words.hashes())
                text = words.text_of[at]
                place = at - words.ptr[text]
                ids = batch.column(0).slice(row, len(offsets) - 1).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), ids, pa.array(place * 32 + count)], ["anchor", "doc", "run"])

    return docs.select("doc_id", "text").mapInArrow(run, "anchor long, doc long, run long")


def shortened(hashes: np.ndarray) -> bytes:
    """Word hashes cut to HASH_BYTES each for the way to the shards."""
    return hashes.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def restored(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // HASH_BYTES, 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, HASH_BYTES)
    return mix(wide.reshape(-1).view(np.uint64))


def whole_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc) of texts that a smaller doc_id has as well, and (doc) of the first of each text."""
    prints = materialize(docs.where("text IS NOT NULL").select(F.col("doc_id").alias("doc"), F.sha2("text", 256).alias("print")), "prints")
    firsts = materialize(prints.groupBy("print").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    copies = heavy_join(prints, firsts.where("n > 1"), "print", prints.count()).where("doc <> first").select("doc").distinct()
    return copies, firsts.select(F.col("first").alias("doc")).distinct()


def held_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of documents whose slot is in the bit map of ``ids``: a superset of those asked for."""
    wanted = docs.sparkSession.sparkContext.broadcast(bit_map(ids))

    def run(batches):
        for batch in batches:
            yield in_bit_map(batch, wanted.value)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


def stretches(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(shard, salted, doc, place, windows, hashes) of each run: its words' hashes as bytes."""

    def cut(batches):
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            doc, shard, salted, place, windows, out = [], [], [], [], [], []
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)
                words = shortened(Words(data, np.array([0, len(data)])).hashes())
                listed = batch.column(2)[i].values
                runs_, shards, salts = (listed.field(j).to_numpy() for j in range(3))
                at, n = runs_ // 32, runs_ % 32
                out += [words[HASH_BYTES * a : HASH_BYTES * (a + k + WINDOW - 1)] for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                doc.append(np.full(len(at), batch.column(0)[i].as_py()))
                for x, y in ((shard, shards), (salted, salts), (place, at), (windows, n)):
                    x.append(y)
            if doc:
                columns = [np.concatenate(x) for x in (shard, salted, doc, place, windows)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(out, pa.binary())], ["shard", "salted", "doc", "place", "windows", "hashes"])

    texts = held_in(docs, runs.select("doc").distinct()).select(F.col("doc_id").alias("doc"), "text")
    lists = runs.groupBy("doc").agg(F.collect_list(F.struct("run", "shard", "salted")).alias("runs"))
    return texts.join(lists, "doc").mapInArrow(cut, "shard long, salted long, doc long, place long, windows long, hashes binary")


def search_shard(doc: np.ndarray, place: np.ndarray, windows: np.ndarray, salted: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, start, mask, print, check) of a shard: masks of windows that occur earlier here; prints of salted ones that do not."""
    sizes = windows + WINDOW - 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    stretch = np.repeat(np.arange(len(doc)), sizes)
    inside = np.arange(begin[-1]) - begin[stretch]
    at = np.flatnonzero(inside <= sizes[stretch] - GRAM)
    grams = gram_hash(words, at, GRAM)
    s, i = stretch[at], inside[at]
    order = np.lexsort((i // GRAM, i % GRAM, s))
    lane = s[order] * GRAM + i[order] % GRAM
    breaks = np.ones(len(lane), np.int64)
    breaks[1:] = lane[1:] != lane[:-1]
    target = np.arange(len(lane)) + np.cumsum(breaks)
    alphabet, symbol = np.unique(grams, return_inverse=True)
    total = int(target[-1]) + 2
    text = np.zeros(total, np.int64)
    text[target] = symbol[order] + 1
    by_doc = np.unique(doc, return_inverse=True)[1]
    where = np.zeros(begin[-1], np.int64)
    where[at[order]] = target
    key = np.zeros(total, np.int64)
    starts = place[s] + i
    widest = int(starts.max(initial=0)) + 1
    key[target] = (by_doc[s] * widest + starts)[order]
    index = FMIndex(text, key, DEPTH)
    first = np.flatnonzero(inside < windows[stretch])
    patterns = np.stack([text[where[first] + j] for j in range(DEPTH)], axis=1)
    owner = stretch[first]
    earlier = index.matching_statistics(patterns, key[where[first]]) >= DEPTH
    mask = np.zeros(len(doc), np.int64)
    np.bitwise_or.at(mask, owner[earlier], np.int64(1) << inside[first][earlier])
    hit = mask != 0
    open_ = ~earlier & (salted[owner] != 0)
    prints = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        value = np.zeros(int(open_.sum()), np.uint64)
        for j in range(DEPTH):
            value = mix(value * np.uint64(seed) + alphabet[patterns[open_, j] - 1])
        prints.append(value)
    prints[0] |= np.uint64(1)
    starts_open = place[owner[open_]] + inside[first[open_]]
    zero = np.zeros(int(hit.sum()), np.int64)
    return (
        np.concatenate([doc[hit], doc[owner[open_]]]),
        np.concatenate([place[hit], starts_open]),
        np.concatenate([mask[hit], np.zeros(len(starts_open), np.int64)]),
        *(np.concatenate([zero, p.view(np.int64)]) for p in prints),
    )


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc, start, mask): bit i of mask says that the window at start + i also starts earlier; start WHOLE says so of all. One row a doc_id in ``docs``."""
    copies, firsts = whole_copies(docs)
    runs = materialize(routed_runs(docs, firsts), "runs")
    often = materialize(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
    found = often.agg(F.sum("n").alias("runs"), F.sum(F.col("n") * (WINDOW + 8)).alias("words")).first()
    joined = heavy_join(runs, often.withColumn("often", F.col("n")), "anchor", found["runs"] or 0)
    shards = max(1, -(-(found["words"] or 0) // SHARD_WORDS))
    salts = F.greatest(F.lit(1), F.ceil(F.col("often") / HOT))
    salt = F.pmod(F.xxhash64("doc"), salts)
    routed = joined.select("doc", "run", F.pmod(F.xxhash64("anchor", salt), F.lit(shards)).alias("shard"), (salts > 1).cast("long").alias("salted"))
    routed = materialize(routed, "routed")
    release(docs.sparkSession, runs, often)
    columns = ("doc", "start", "mask", "print", "check")

    def run(table: pa.Table) -> pa.Table:
        doc, place, windows, salted = (table.column(x).to_numpy() for x in ("doc", "place", "windows", "salted"))
        words = restored(b"".join(table.column("hashes").to_pylist()))
        return pa.table(dict(zip(columns, map(pa.array, search_shard(doc, place, windows, salted, words)), strict=True)))

    found = materialize(stretches(docs, routed).groupBy("shard").applyInArrow(run, ", ".join(f"{c} long" for c in columns)), "found")
    release(docs.sparkSession, routed)
    unsettled = found.where("mask = 0").select("doc", "start", "print", "check")
    firsts = materialize(unsettled.groupBy("print", F.col("check").alias("own")).agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first-windows")
    later = heavy_join(unsettled, firsts, "print", unsettled.count()).where((F.col("check") == F.col("own")) & (F.struct("doc", "start") > F.col("first")))
    one = F.lit(1).cast("long").alias("mask")
    rows = found.where("mask <> 0").select("doc", "start", "mask").unionByName(later.select("doc", "start", one))
    return rows.unionByName(copies.select("doc", F.lit(WHOLE).cast("long").alias("start"), one))


def with_windows(docs: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` with one more column: the (start, mask) pairs of their repeated windows."""
    texts, chosen = one_text_each(docs)
    lists = repeated_windows(texts).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "mask")).alias(name))
    if chosen is not None:
        lists = lists.join(chosen.withColumnRenamed("chosen", name + "_"), "doc_id", "left")
    marked = docs.join(lists, "doc_id", "left")
    if chosen is not None:
        own = F.col(name + "_").isNull() | (F.col(name + "_") == F.sha2(F.coalesce("text", F.lit("")), 256))
        marked = marked.withColumn(name, F.when(own, F.col(name))).drop(name + "_")
    return marked


def covered_words(windows, n_words: int) -> np.ndarray:
    """True for each word under a repeated window; ``windows`` is an Arrow list value or null."""
    edge = np.zeros(n_words + 1, np.int64)
    if windows is not None:
        start, mask = windows.field(0).to_numpy(), windows.field(1).to_numpy()
        if (start == WHOLE).any():
            return np.full(n_words, n_words >= WINDOW)
        for i in range(SPAN):
            at = start[(mask >> i) & 1 == 1] + i
            at = at[at + WINDOW <= n_words]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def digest_kept(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""

    def run(batches):
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            texts = batch.column(1).cast(pa.binary())
            n_words, n_removed, digests = [], [], []
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or b"").split()
                gone = 0
                n_words.append(len(words))
                if batch.column(2)[i].is_valid:
                    covered = covered_words(batch.column(2)[i].values, len(words))
                    gone = int(covered.sum())
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                n_removed.append(gone)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    marked = with_windows(docs.select("doc_id", "text"), "windows")
    return marked.select("doc_id", "text", "windows").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_passages(docs: DataFrame) -> DataFrame:
    """The same rows and columns; in ``text`` repeated passages are cut out, each with the white space after it, and ``n_chars`` counted anew where it exists."""
    schema = docs.schema

    def run(batches):
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            found = batch.column(batch.num_columns - 1)
            i = batch.schema.get_field_index("text")
            texts = batch.column(i).cast(pa.binary()).to_pylist()
            for j in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)):
                data = np.frombuffer(texts[j], np.uint8)
                words = Words(data, np.array([0, len(data)]))
                covered = covered_words(found[j].values, len(words.starts))
                edge = np.zeros(len(data) + 1, np.int8)
                until = np.append(words.starts[1:], len(data))
                edge[words.starts[covered]] += 1
                edge[until[covered]] -= 1
                texts[j] = data[np.cumsum(edge[:-1]) == 0].tobytes()
            out = batch.set_column(i, batch.schema.field(i), pa.array(texts, pa.binary()).cast(batch.column(i).type))
            yield out.select(schema.names)

    name = unused("windows", [c + end for c in schema.names for end in ("", "_")])
    marked = with_windows(docs, name).select(*schema.names, name)
    out = marked.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out
