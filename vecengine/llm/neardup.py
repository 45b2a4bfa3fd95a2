"""Near-duplicate documents from bottom-k sketches of one hash function.

1. A document's set of word shingles is hashed once; the k least values are its
   sketch. Documents with one and the same set are collapsed to the least id.
2. Retained values are inverted. A pair that reaches the threshold shares many
   of the first m values of its sketches (``least_overlap``), so it shares one
   of a document's rarest retained values, of which so many are listed that no
   such pair is missed; common values stay out of the lists.
3. The most typical member of each list leads it, and lists of one leader form
   a group. In bounded blocks all members are compared with the leader; in large
   groups, then with some of the members that stay open. What the links so far do
   not join with its leader is compared with all other members. Of two members, the sketch of their union
   (the k least values of both sketches) estimates the similarity, and what
   passes is decided on full sets.
4. Links are joined to components by star contractions on the cluster.

Defined cases: null and empty texts have empty sets, are linked with nothing
and are kept; a text of fewer words than a shingle is one shingle as a whole;
equal texts are one class; rows that repeat a doc_id are one document that has
the links of all of them, each row with its own number of shingles; a row with
a null doc_id takes no part and is kept with a null component; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import connected_components
from .shared import bit_map, heavy_join, in_bit_map, materialize, release
from .words import Words, gram_hash, text_chunks

SKETCH = 128
LISTED = 32
MISS = 1e-7
BLOCK_DOCS = 1024
BLOCK_VALUES = 1 << 20
MANY = 64
EXTRA = 24
ESTIMATED = 1 << 13
FILL = np.uint64((1 << 64) - 1)


def shingle_sets(words: Words, size: int):
    """The sorted distinct shingle hashes of each text."""
    hashes = words.hashes()
    at, grams = words.grams(hashes, size)
    cut = np.searchsorted(at, words.ptr)
    for i, n in enumerate(words.counts):
        if n >= size:
            yield np.unique(grams[cut[i] : cut[i + 1]])
        elif n:
            yield gram_hash(hashes, words.ptr[i : i + 1], int(n))
        else:
            yield np.empty(0, np.uint64)


def least_overlap(size: int, listed: int, percent: int, miss: float = MISS) -> int:
    """How many of its first ``listed`` values a set of ``size`` shares with those of any partner at the threshold.

    Exact for sets that are listed whole; for larger ones a pair fails to share
    so many with a probability below ``miss`` (binomial, which the draw without
    replacement stays under).
    """
    if size <= listed:
        partner = size * 100 // percent
        return max(1, -(-size * percent // 100) - max(0, partner - listed))
    p, total = percent / 100, 0.0
    for c in range(listed + 1):
        total += math.comb(listed, c) * p**c * (1 - p) ** (listed - c)
        if total >= miss:
            return max(1, c)
    return listed


def print_of(values: np.ndarray) -> bytes | None:
    """128-bit print of a set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def tag_of(mark: bytes) -> int:
    """A number that tells the texts of one doc_id apart."""
    return int.from_bytes(mark[:8], "little", signed=True)


def signatures(docs: DataFrame, shingle: int, sketch: int = SKETCH) -> DataFrame:
    """(doc_id, tag, n, print, sketch): set size, 128-bit print of the set, and its least values as 8-byte integers."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in text_chunks(batch):
                sets = list(shingle_sets(Words(data, offsets, lower=True), shingle))
                prints = [print_of(s) for s in sets]
                tags = [tag_of(p) if p else None for p in prints]
                columns = [pa.array(tags, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([s[:sketch].tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), *columns], ["doc_id", "tag", "n", "print", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tag long, n long, print binary, sketch binary")


def listed_values(signed: DataFrame, listed: int) -> DataFrame:
    """(value, doc, tag, size): the first ``listed`` retained values."""

    def run(batches):
        for batch in batches:
            own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            heads = [np.frombuffer(x.as_py(), np.int64)[:listed] for x in batch.column(3)]
            counts = [len(h) for h in heads]
            columns = [np.concatenate([np.empty(0, np.int64), *heads]), *(np.repeat(x, counts) for x in own)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["value", "doc", "tag", "size"])

    return signed.select("doc_id", "tag", "n", "sketch").mapInArrow(run, "value long, doc long, tag long, size long")


def inverted_lists(values: DataFrame, percent: int, listed: int, total: int) -> DataFrame:
    """(value, doc, tag, size, weight): each document under its rarest values, as many as ``least_overlap`` asks for."""
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("df", F.col("n"))
    shared = heavy_join(values, counts, "value", total)
    own = shared.groupBy("doc", "tag").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"))
    small = F.element_at(F.array(*(F.lit(least_overlap(i, listed, percent)) for i in range(1, listed + 1))), F.least("size", F.lit(listed)).cast("int"))
    need = F.when(F.col("size") <= listed, small).otherwise(least_overlap(listed + 1, listed, percent))
    length = F.least("size", F.lit(listed)).cast("int")
    take = length - need + 1 - (length - F.size("found"))
    weight = F.expr("aggregate(found, 0D, (a, x) -> a + ln(x.df))").alias("weight")
    picked = own.withColumn("take", take).where("take > 0").select("doc", "tag", "size", weight, F.explode(F.slice("found", 1, F.col("take"))).alias("x"))
    return picked.select(F.col("x.value").alias("value"), "doc", "tag", "size", "weight")


def leader_groups(lists: DataFrame, total: int) -> DataFrame:
    """(leader, doc, tag, size): members of the lists that each leader (doc, tag) leads, itself among them."""
    best = F.max_by(F.struct("doc", "tag"), F.struct("weight", -F.col("doc"), "tag"))
    leaders = lists.groupBy("value").agg(best.alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return heavy_join(lists, leaders, "value", total).select("leader", "doc", "tag", "size").distinct()


def full_sets(docs: DataFrame, wanted: np.ndarray, shingle: int) -> DataFrame:
    """(doc, tag, values): full sorted sets of the documents whose slot is in the bit map (a superset of those asked for)."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        bits = shared.value
        for batch in batches:
            batch = in_bit_map(batch, bits)
            for row, data, offsets in text_chunks(batch):
                sets = list(shingle_sets(Words(data, offsets, lower=True), shingle))
                tags = [tag_of(print_of(s)) if len(s) else None for s in sets]
                columns = [batch.column(0).slice(row, len(sets)), pa.array(tags, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "tag", "values"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc long, tag long, values binary").dropDuplicates(["doc", "tag"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, through 0/1 matrices over the values that both sides hold."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)

    def places(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(common, flat)
        hit = (at < len(common)) & (common[np.minimum(at, max(len(common) - 1, 0))] == flat) if len(common) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        return rows[hit][order], at[hit][order]

    (ra, ca), (rb, cb) = places(left, a), places(right, b)
    for start in range(0, len(common), width):
        x = np.zeros((len(left), width), np.float32)
        y = np.zeros((len(right), width), np.float32)
        for m, r, c in ((x, ra, ca), (y, rb, cb)):
            i, j = np.searchsorted(c, (start, start + width))
            m[r[i:j], c[i:j] - start] = 1
        out += x @ y.T
    return out.astype(np.int64)


def estimates(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of sketches (rows, filled up with the greatest integer): values shared within the union's sketch, its size, and whether it holds the union whole."""
    k = left.shape[1]
    both = np.sort(np.concatenate([left, right], axis=1), axis=1)
    real = both != FILL
    new = real.copy()
    new[:, 1:] &= both[:, 1:] != both[:, :-1]
    place = np.cumsum(new, axis=1)
    whole = (place[:, -1] <= k) & (left[:, -1] == FILL) & (right[:, -1] == FILL)
    return (real & ~new & (place <= k)).sum(axis=1), np.minimum(place[:, -1], k), whole


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int, sketch: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs across two lists of sets that reach the threshold: size, union-sketch estimate, then full sets."""
    a, b = (np.array([len(s) for s in sets]) for sets in (left, right))
    comparable = (100 * a[:, None] >= percent * b) & (100 * b >= percent * a[:, None])
    if not comparable.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    comparable &= overlaps([s[:sketch] for s in left], [s[:sketch] for s in right]) > 0
    i, j = np.nonzero(comparable)
    heads = []
    for sets in (left, right):
        filled = np.full((len(sets), sketch), FILL)
        for r, s in enumerate(sets):
            filled[r, : min(len(s), sketch)] = s[:sketch]
        heads.append(filled)
    least = least_overlap(sketch + 1, sketch, percent)
    passed = np.zeros(len(i), bool)
    for start in range(0, len(i), ESTIMATED):
        part = slice(start, start + ESTIMATED)
        shared, size, whole = estimates(heads[0][i[part]], heads[1][j[part]])
        passed[part] = np.where(whole, 100 * shared >= percent * size, shared >= least)
    i, j = i[passed], j[passed]
    if not len(i):
        return i, j
    rows, cols = np.unique(i), np.unique(j)
    shared = overlaps([left[r] for r in rows], [right[c] for c in cols])[np.searchsorted(rows, i), np.searchsorted(cols, j)]
    linked = 100 * shared >= percent * (a[i] + b[j] - shared)
    return i[linked], j[linked]


def blocks_of(docs: str, total: str):
    """How many blocks hold ``docs`` sets of ``total`` values."""
    return F.greatest(F.lit(1), F.ceil(F.col(docs) / BLOCK_DOCS), F.ceil(F.col(total) / BLOCK_VALUES)).cast("int")


def block_of(blocks: str):
    return F.pmod(F.xxhash64("doc", "tag"), F.col(blocks)).cast("int")


def numbers(blocks: str):
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def sets_of(table: pa.Table, rows: np.ndarray) -> list[np.ndarray]:
    values = table.column("values").take(pa.array(rows))
    return [np.frombuffer(x.as_py(), np.uint64) for x in values]


def leader_links(groups: DataFrame, sets: DataFrame, percent: int, sketch: int, total: int) -> DataFrame:
    """(leader, doc, tag, size, docs, total, linked) of every other member, compared with its leader; blocks of a group share the leader alone."""
    sizes = groups.groupBy("leader").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("total")).withColumn("n", F.col("docs"))
    placed = heavy_join(groups, sizes, "leader", total).withColumn("blocks", blocks_of("docs", "total"))
    is_leader = F.col("leader") == F.struct("doc", "tag")
    columns = ["leader", "doc", "tag", "size", "docs", "total"]
    members = placed.where(~is_leader).select(*columns, block_of("blocks").alias("block"), F.lit(False).alias("leads"))
    leaders = placed.where(is_leader).select(*columns, numbers("blocks").alias("block"), F.lit(True).alias("leads"))
    full = members.unionByName(leaders).join(sets, ["doc", "tag"])

    def run(table: pa.Table) -> pa.Table:
        leads = table.column("leads").to_numpy()
        rows = np.flatnonzero(~leads)
        found = np.zeros(len(rows), bool)
        if leads.any() and len(rows):
            found[linked_pairs(sets_of(table, np.flatnonzero(leads)[:1]), sets_of(table, rows), percent, sketch)[1]] = True
        return table.take(pa.array(rows)).select(columns).append_column("linked", pa.array(found))

    kind = "leader struct<doc:long,tag:long>, doc long, tag long, size long, docs long, total long, linked boolean"
    return full.groupBy("leader", "block").applyInArrow(run, kind)


def extra_links(seen: DataFrame, sets: DataFrame, percent: int, sketch: int, total: int) -> DataFrame:
    """(a, b) links between EXTRA of the open members of each large group and all its members but the leader."""
    rest = seen.where("NOT linked").where(F.col("docs") > MANY)
    place = F.row_number().over(Window.partitionBy("leader").orderBy(F.xxhash64("doc", "tag"), "doc", "tag"))
    chosen = materialize(rest.withColumn("place", place).where(F.col("place") <= EXTRA).select("leader", "doc", "tag", "docs", "total"), "chosen")
    large = chosen.groupBy("leader").agg(F.first("docs").alias("n"))
    members = heavy_join(seen, large, "leader", total).select("leader", "doc", "tag", block_of_all().alias("block"), F.lit(False).alias("leads"))
    leaders = chosen.withColumn("blocks", blocks_of("docs", "total")).select("leader", "doc", "tag", numbers("blocks").alias("block"), F.lit(True).alias("leads"))
    full = members.unionByName(leaders).join(sets, ["doc", "tag"])
    return full.groupBy("leader", "block").applyInArrow(lambda table: links_across(table, "leads", percent, sketch), "a long, b long")


def block_of_all():
    return F.pmod(F.xxhash64("doc", "tag"), blocks_of("docs", "total")).cast("int")


def links_across(table: pa.Table, side: str, percent: int, sketch: int) -> pa.Table:
    """Links between the documents of the two sides, as few as join the same ones."""
    first = table.column(side).to_numpy()
    ids = table.column("doc").to_numpy()
    left, right = np.flatnonzero(first), np.flatnonzero(~first)
    pairs = []
    if len(left) and len(right):
        i, j = linked_pairs(sets_of(table, left), sets_of(table, right), percent, sketch)
        pairs = spanning_forest(ids[left[i]], ids[right[j]])
    return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})


def joined_with_leader(seen: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """``seen`` with linked true also for members that ``found`` (node, component) joins with their leader."""
    leaders = seen.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    named = leaders.join(found.select(F.col("node").alias("node"), F.col("component").alias("whole")), F.col("leader.doc") == F.col("node"), "left").select("leader", "whole", "n")
    own = seen.join(found.select(F.col("node").alias("doc"), F.col("component").alias("part")), "doc", "left")
    both = heavy_join(own, named, "leader", total)
    return both.withColumn("linked", F.col("linked") | F.coalesce(F.col("part") == F.col("whole"), F.lit(False))).select(*seen.columns)


def open_links(seen: DataFrame, sets: DataFrame, percent: int, sketch: int, total: int) -> DataFrame:
    """(a, b) links of the members that are not joined with their leader, to all other members; a block gives a forest, never its pairs."""
    rest = seen.where("NOT linked AND docs > 2")
    sizes = rest.groupBy("leader").agg(F.count(F.lit(1)).alias("open"), F.sum("size").alias("open_total"), F.first("docs").alias("n"))
    placed = heavy_join(seen, sizes, "leader", total)
    placed = placed.withColumn("rows", blocks_of("open", "open_total")).withColumn("columns", blocks_of("docs", "total"))
    asking = placed.where("NOT linked").select("leader", "doc", "tag", block_of("rows").alias("r"), numbers("columns").alias("c"), F.lit(True).alias("asks"))
    asked = placed.select("leader", "doc", "tag", numbers("rows").alias("r"), block_of("columns").alias("c"), F.lit(False).alias("asks"))
    full = asking.unionByName(asked).join(sets, ["doc", "tag"])

    return full.groupBy("leader", "r", "c").applyInArrow(lambda table: links_across(table, "asks", percent, sketch), "a long, b long")


def spanning_forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """As few of the links as join the same documents."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        root.setdefault(i, i)
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, sketch: int = SKETCH, listed: int = LISTED) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    signed = materialize(signatures(docs, shingle, sketch), "signatures")
    total = signed.count()
    usable = signed.where("doc_id IS NOT NULL AND n > 0")
    same = [F.first(c).alias(c) for c in ("tag", "size", "sketch")]
    sized = usable.withColumnRenamed("n", "size")
    classes = materialize(sized.groupBy("print").agg(F.min("doc_id").alias("rep"), *same, F.count(F.lit(1)).alias("n")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "tag", F.col("size").alias("n"), "sketch")
    lists = materialize(inverted_lists(listed_values(reps, listed), percent, listed, listed * total), "lists")
    groups = materialize(leader_groups(lists, listed * total), "groups")
    release(docs.sparkSession, lists)
    sets = materialize(full_sets(docs, bit_map(groups.select("doc").distinct()), shingle), "sets")
    seen = materialize(leader_links(groups, sets, percent, sketch, listed * total), "seen")
    links = seen.where("linked").select(F.col("doc").alias("a"), F.col("leader.doc").alias("b"))
    if not seen.where("NOT linked").where(F.col("docs") > MANY).isEmpty():
        found = materialize(connected_components(links.union(extra_links(seen, sets, percent, sketch, listed * total))), "joined")
        links = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        seen = materialize(joined_with_leader(seen, found, listed * total), "seen")
    links = links.union(open_links(seen, sets, percent, sketch, listed * total))
    several = usable.groupBy("doc_id").agg(F.min("print").alias("one"), F.max("print").alias("two"), F.count(F.lit(1)).alias("n")).where("one <> two").select("doc_id", "n")
    prints = classes.select("print", "rep", "n")
    several = materialize(several, "several")
    if not several.isEmpty():
        twice = materialize(heavy_join(usable.select("doc_id", "print"), several, "doc_id", total), "twice")
        links = links.union(heavy_join(twice, materialize(prints, "prints"), "print", total).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = connected_components(links)
    named = materialize(prints.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component_id"), "n"), "named")
    release(docs.sparkSession, groups, sets, classes)
    rest = signed.where("doc_id IS NULL OR n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    every = heavy_join(sized.select("doc_id", "size", "print"), named, "print", total).select("doc_id", F.col("size").alias("n"), "component_id").unionByName(rest)
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class (of a repeated doc_id the row whose text has the least digest), and all rows without a doc_id."""
    kept = near_duplicates(docs, percent).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    known = docs.where("doc_id IS NOT NULL")
    rows = known.join(kept, "doc_id", "left_semi").select(*docs.columns)
    several = materialize(known.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    if not several.isEmpty():
        least = F.struct(F.coalesce(F.sha2("text", 256), F.lit("")), F.xxhash64(*docs.columns))
        ones = rows.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), least).alias("row")).select("row.*")
        rows = rows.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(ones)
    return rows.unionByName(docs.where("doc_id IS NULL"))
