"""Quality classifier by importance resampling.

Generative models are hashed n-gram counts. The target model counts words and
word pairs of labelled good texts (quality 1, toxic 0), the raw model those of
every text; a text's mean log ratio is how much likelier its n-grams are under
the target than in the raw stream. A second pair of models, of labelled good
and labelled toxic texts, counts the texts that hold a word or a word's first
bytes; each is hashed twice and the weaker ratio counts, less Z standard errors,
so that only what marks toxic texts for sure is evidence, and the strongest
evidence in a text counts. A text's log-weight is how far its mean log ratio lies above the
threshold, in units of 1 / SHARP, or how far its evidence lies beyond the other
threshold, taken below zero, where that is less.
Gumbel noise is added to the tempered log-weights, and the k largest sums are
kept, k being the number of texts with a log-weight above zero. Noise decides
among texts near the k-th weight; texts far above it stay.

Labels are read from a sample of at most ``label_rows`` rows; three quarters
fit the models and one quarter sets the two thresholds. Raw counts cover all
texts. Models have a fixed size (SLOTS), so they can be broadcast.

Defined cases: null and empty texts have no n-grams and are rejected; noise is a
hash of doc_id and text, so repeated rows go or stay together, and so do texts
that tie with the k-th; a null doc_id may be kept; without labelled good texts
every text with words is kept, without labelled toxic ones there is no evidence;
an empty table gives no rows; texts are read whole; other columns, whatever
their names, stay where rows are filtered and are ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import materialize, unused
from .words import Words, mix, text_chunks

BITS = 18
SLOTS = 1 << BITS
PIECE = 1 << 14
PREFIXES = (4, 5, 6)
VECTORS = ("raw", "target", "good0", "good1", "toxic0", "toxic1")
SMOOTH = 5.0
Z = 3.0
SHORT = 20
SHARP = 40.0
TEMPERATURE = 0.25
SALTED_ABOVE = 256
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def ratio_slots(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text of each word and word pair."""
    at, pairs = words.grams(hashes, 2)
    both = np.concatenate([hashes, pairs])
    return (both & np.uint64(SLOTS - 1)).astype(np.int64), np.concatenate([words.text_of, words.text_of[at]])


def evidence_slots(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two slots and the text of each word without closing punctuation, and of its first bytes."""
    ends = words.ends
    for _ in range(2):
        ends = ends - ((ends - words.starts > 1) & _PUNCTUATION[words.data[ends - 1]])
    kept, parts = words.ends, []
    for size in (0, *PREFIXES):
        words.ends = np.minimum(ends, words.starts + size) if size else ends
        parts.append(mix(words.hashes() + np.uint64(size)))
    words.ends = kept
    h = np.concatenate(parts)
    mask = np.uint64(SLOTS - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(BITS)) & mask).astype(np.int64), np.tile(words.text_of, len(parts))


def labelled_sample(labels: DataFrame, label_rows: int, seed: int) -> dict[str, np.ndarray]:
    """ids, kind (1 good, 2 toxic, 3 poor) and fit (0 for the quarter that sets thresholds), at most ``label_rows`` of them, sorted by id."""
    kind = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when(F.col("toxic") == 1, 2).otherwise(3)
    usable = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    share = min(1.0, 2 * label_rows / max(1, usable.count()))
    order = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    chosen = usable.where(order <= int(share * (1 << 30)))
    rows = chosen.select("doc_id", kind.alias("kind")).orderBy(order, "doc_id", "kind").limit(label_rows).toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    ids = rows["doc_id"].to_numpy(np.int64)
    return {"ids": ids, "kind": rows["kind"].to_numpy(np.int64), "fit": mix(ids.view(np.uint64) + np.uint64(seed)) % np.uint64(4) != 0}


def sum_pieces(pieces: DataFrame) -> DataFrame:
    """(piece, counts) summed over rows of little-endian int64 blocks, streaming and in two levels where there are many."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(block.as_py(), np.int64)
                sums[key] = sums[key] + values if key in sums else values
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["piece", "counts"])

    schema = "piece long, counts binary"
    if pieces.rdd.getNumPartitions() > SALTED_ABOVE:
        pieces = pieces.repartition("piece", F.pmod(F.spark_partition_id(), F.lit(SALTED_ABOVE))).mapInArrow(add, schema)
    return pieces.repartition("piece").mapInArrow(add, schema)


def corpus_counts(docs: DataFrame, sample: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The six count vectors over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(sample)

    def run(batches):
        sample = shared.value
        ids, kinds = sample["ids"][sample["fit"]], sample["kind"][sample["fit"]]
        counts = {v: np.zeros(SLOTS, np.int64) for v in VECTORS}
        for batch in batches:
            own = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
            kind = np.where(ids[place] == own, kinds[place], 0) if len(ids) else np.zeros(len(own), np.int64)
            for row, data, offsets in text_chunks(batch):
                words = Words(data, offsets, lower=True)
                slots, text = ratio_slots(words, words.hashes())
                of = kind[row : row + len(offsets) - 1]
                counts["raw"] += np.bincount(slots, minlength=SLOTS)
                if (of == 1).any():
                    counts["target"] += np.bincount(slots[of[text] == 1], minlength=SLOTS)
                if ((of == 1) | (of == 2)).any():
                    first, second, text = evidence_slots(words)
                    for name, k in (("good", 1), ("toxic", 2)):
                        hit = of[text] == k
                        for j, s in enumerate((first[hit], second[hit])):
                            once = np.unique(text[hit] * SLOTS + s) % SLOTS
                            counts[f"{name}{j}"] += np.bincount(once, minlength=SLOTS)
        keys, blocks = [], []
        for v, name in enumerate(VECTORS):
            for p in range(SLOTS // PIECE):
                block = counts[name][p * PIECE : (p + 1) * PIECE]
                if block.any():
                    keys.append(v * (SLOTS // PIECE) + p)
                    blocks.append(block.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.binary())], ["piece", "counts"])

    pieces = docs.select("doc_id", "text").mapInArrow(run, "piece long, counts binary")
    out = {v: np.zeros(SLOTS, np.int64) for v in VECTORS}
    for row in sum_pieces(pieces).toLocalIterator():
        v, p = divmod(row["piece"], SLOTS // PIECE)
        out[VECTORS[v]][p * PIECE : (p + 1) * PIECE] = np.frombuffer(row["counts"], np.int64)
    return out


def models(counts: dict[str, np.ndarray], n_good: int, n_toxic: int) -> dict[str, np.ndarray]:
    """Log ratios of target to raw, and the sure part of the log ratios of toxic to good under both hashes."""
    raw, target = counts["raw"].astype(float), counts["target"].astype(float)
    expected = raw * (target.sum() / max(raw.sum(), 1))
    out = {"ratio": np.log((target + SMOOTH) / (expected + SMOOTH)).astype(np.float32) if target.sum() else np.zeros(SLOTS, np.float32)}
    for j in "01":
        good, toxic = counts[f"good{j}"] + 0.5, counts[f"toxic{j}"] + 0.5
        sure = np.log(toxic / (n_toxic + 1)) - np.log(good / (n_good + 1)) - Z * np.sqrt(1 / toxic + 1 / good)
        out[f"evidence{j}"] = np.maximum(sure, 0).astype(np.float32) if n_toxic and n_good else np.zeros(SLOTS, np.float32)
    return out


def scored(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str], names: dict[str, str], seed: int) -> DataFrame:
    """Columns ``keep`` of every row with its noise (uniform 64-bit hashes), number of words, ratio and evidence under their ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [names[n] for n in ("noise", "words", "ratio", "evidence")]
    schema = docs.select(*keep).schema
    for name, kind in zip(added, ("long", "long", "double", "double"), strict=True):
        schema = schema.add(name, kind)
    columns = keep if "text" in keep else [*keep, "text"]

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [np.zeros(batch.num_rows, kind) for kind in (np.int64, float, float)]
            for row, data, offsets in text_chunks(batch):
                words = Words(data, offsets, lower=True)
                n = len(offsets) - 1
                slots, text = ratio_slots(words, words.hashes())
                total = np.bincount(text, weights=model["ratio"][slots], minlength=n)
                found[0][row : row + n] = words.counts
                found[1][row : row + n] = total / (np.bincount(text, minlength=n) + SHORT)
                first, second, text = evidence_slots(words)
                weak = np.minimum(model["evidence0"][first], model["evidence1"][second]).astype(float)
                strong = np.zeros(n)
                np.maximum.at(strong, text[weak > 0], weak[weak > 0])
                found[2][row : row + n] = strong
            own = [batch.column(batch.schema.get_field_index(c)) for c in [*keep, added[0]]]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, found)], [*keep, *added])

    noise = F.xxhash64("doc_id", "text", F.lit(seed).cast("long")).alias(added[0])
    return docs.select(*columns, noise).mapInArrow(run, schema)


def best_cut(accepted: np.ndarray, rejected: np.ndarray, cost: float = 10.0) -> float | None:
    """The threshold above which values count as accepted, at the least sum of error rates, false rejections at ``cost``."""
    if not len(accepted) or not len(rejected):
        return None
    values = np.unique(np.concatenate([accepted, rejected]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2])
    lost = np.searchsorted(np.sort(accepted), cuts) / len(accepted)
    let_in = 1 - np.searchsorted(np.sort(rejected), cuts) / len(rejected)
    return float(cuts[np.argmin(cost * lost + let_in)])


def kth_largest(keys: DataFrame, k: int, bins: int = 2048, few: int = 2000) -> float:
    """The k-th largest key, by narrowing histograms; at most ``few`` different keys reach the driver."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / bins
        if width <= 0 or low + width <= low:
            break
        at = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1)).cast("int")
        counts = {r["at"]: (r["n"], r["low"], r["high"]) for r in inside.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        for b in sorted(counts, reverse=True):
            n, bin_low, bin_high = counts[b]
            if above + n >= k:
                break
            above += n
        low, high = bin_low, bin_high
        if n <= few:
            break
    for row in keys.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy("key").count().orderBy(F.desc("key")).collect():
        above += row["count"]
        if above >= k:
            return row["key"]
    return low


class Classifier:
    """Fitted models, thresholds and the cut of the Gumbel top-k over one table of documents."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label_rows: int = 20_000, seed: int = 7):
        self.seed = seed
        self.names = {n: unused(f"__{n}", docs.columns) for n in ("noise", "words", "ratio", "evidence", "log_weight", "key")}
        sample = labelled_sample(labels, label_rows, seed)
        counts = corpus_counts(docs, sample)
        fit = sample["fit"]
        self.model = models(counts, int((sample["kind"][fit] == 1).sum()), int((sample["kind"][fit] == 2).sum()))
        self.small = materialize(self.scored(docs, ["doc_id"]), "scores")
        held = [(int(i), int(k)) for i, k in zip(sample["ids"][~fit], sample["kind"][~fit], strict=True)]
        self.ratio_cut = self.evidence_cut = None
        if held:
            held_rows = docs.sparkSession.createDataFrame(held, "doc_id long, kind long")
            ratio, evidence = self.names["ratio"], self.names["evidence"]
            seen = self.small.join(F.broadcast(held_rows), "doc_id").select("kind", ratio, evidence).toPandas()
            by = {k: seen[seen["kind"] == k] for k in (1, 2, 3)}
            self.ratio_cut = best_cut(by[1][ratio].to_numpy(), by[3][ratio].to_numpy())
            cut = best_cut(-by[1][evidence].to_numpy(), -by[2][evidence].to_numpy())
            self.evidence_cut = None if cut is None else -cut
        weighed = self.weigh(self.small)
        k = weighed.where(F.col(self.names["log_weight"]) > 0).count()
        self.cut = kth_largest(weighed.select(F.col(self.names["key"]).alias("key")), k) if k else None

    def scored(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        return scored(docs, self.model, keep, self.names, self.seed)

    def weigh(self, rows: DataFrame) -> DataFrame:
        """Adds the log-weight and the key, which is the tempered log-weight with Gumbel noise."""
        c = {n: F.col(x) for n, x in self.names.items()}
        ratio = F.lit(1.0) if self.ratio_cut is None else (c["ratio"] - self.ratio_cut) * SHARP
        evidence = F.lit(1.0) if self.evidence_cut is None else (F.lit(self.evidence_cut) - c["evidence"]) * SHARP
        weight = F.when(c["words"] > 0, F.when(evidence > 0, ratio).otherwise(F.least(ratio, evidence))).otherwise(F.lit(-1e6))
        uniform = (F.pmod(c["noise"], F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        return rows.withColumn(self.names["log_weight"], weight).withColumn(self.names["key"], c["log_weight"] / TEMPERATURE - F.log(-F.log(uniform)))

    def kept(self) -> "F.Column":
        """Whether a weighed row is among the k largest."""
        if self.cut is None:
            return F.lit(False)
        return (F.col(self.names["words"]) > 0) & (F.col(self.names["key"]) >= self.cut)


def judge(docs: DataFrame, labels: DataFrame, label_rows: int = 20_000) -> DataFrame:
    """doc_id, n_words, ratio, evidence, log_weight, gumbel_key and kept of every row."""
    c = Classifier(docs, labels, label_rows)
    shown = {"words": "n_words", "ratio": "ratio", "evidence": "evidence", "log_weight": "log_weight", "key": "gumbel_key"}
    return c.weigh(c.small).select("doc_id", *(F.col(c.names[n]).alias(x) for n, x in shown.items()), c.kept().alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, label_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that the resampling keeps."""
    c = Classifier(docs, labels, label_rows)
    return c.weigh(c.scored(docs, docs.columns)).where(c.kept()).select(*docs.columns)
