"""Near duplicates, scoring, classifier, passages, search and the pipeline against brute force."""

import collections
import hashlib
import importlib.util
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import awkward, by_id, documents, empty, prose
from vecengine.llm import classifier, components, neardup, scoring, secrets, shared, substring, topk_search
from vecengine.llm.fmindex import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def edited(text, changes, seed):
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), changes):
        words[i] = f"edit{seed}x{i}"
    return " ".join(words)


def plain_classes(texts, percent=85):
    """Smallest reachable id and set size by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates(spark):
    base, other = prose(400, 11), prose(150, 12)
    texts = [base, base.upper(), *(edited(base, n % 7, n) for n in range(60)), *(edited(other, 1 + n % 4, n) for n in range(30)), "short text", "Short TEXT", *(prose(8, n) for n in range(20))]
    docs = awkward(spark).unionByName(documents(spark, texts, 100))
    known = {i: t for i, (t,) in by_id(docs, "text").items() if i is not None}
    found = by_id(neardup.near_duplicates(docs, percent=85), "n_shingles", "component_id", "kept")
    assert found.pop(None)[1:] == (None, True)
    assert found == plain_classes(known)
    assert neardup.near_duplicates(empty(spark)).count() == 0
    kept = neardup.drop_near_duplicates(docs, percent=85)
    assert kept.columns == docs.columns and kept.count() == sum(v[2] for v in found.values()) + 1


def test_stage_drops_copies_from_eighty_percent(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = [f"w{i}" for i in range(204)]
    docs = [base, base[:100] + [f"x{i}" for i in range(16)] + base[116:]]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in docs]
    share = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert 0.80 <= share < 0.85
    frame = documents(spark, [" ".join(w) for w in docs])
    assert corpus_pipeline.keep_one_of_each(spark, frame, "").count() == neardup.drop_near_duplicates(frame, percent=80).count() == 1
    assert neardup.near_duplicates(frame, percent=85).where("kept").count() == 2


def test_blocks_of_a_group_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 8)
    monkeypatch.setattr(neardup, "MANY", 10)
    monkeypatch.setattr(neardup, "EXTRA", 3)
    monkeypatch.setattr(shared, "HEAVY_LEAST", 5)
    base = prose(200, 21)
    texts = [edited(base, n % 5, n) for n in range(50)]
    found = by_id(neardup.near_duplicates(documents(spark, texts), percent=85), "n_shingles", "component_id", "kept")
    assert found == plain_classes(dict(enumerate(texts)))


@pytest.mark.parametrize("many", [5, 1000])
def test_members_that_their_leader_leaves_open_are_compared(spark, monkeypatch, many):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 6)
    monkeypatch.setattr(neardup, "MANY", many)
    monkeypatch.setattr(neardup, "EXTRA", 2)
    words = prose(300, 22).split()
    texts = [" ".join(words[4 * n : 4 * n + 150]) for n in range(30)]
    found = by_id(neardup.near_duplicates(documents(spark, texts), percent=85), "n_shingles", "component_id", "kept")
    assert found == plain_classes(dict(enumerate(texts))) and len({c for _, c, _ in found.values()}) < 3


@pytest.mark.parametrize("partitions", [1, 4])
def test_repeated_ids_keep_the_links_of_all_their_rows(spark, partitions):
    w, v = prose(200, 51), prose(220, 52)
    rows = [(5, w), (5, v), (7, w + " more"), (8, v + " more"), (9, prose(100, 53)), (5, w)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    found = neardup.near_duplicates(frame, percent=85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(5, 5), (5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]
    kept = neardup.drop_near_duplicates(frame).collect()
    first = min((w, v), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert sorted(map(tuple, kept)) == [(5, first), (9, prose(100, 53))]


def test_union_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.sort(values[:2000]), np.sort(values[200:2200])
    shared, size, whole = neardup.estimates(a[None, :128], b[None, :128])
    union = np.union1d(a, b)[:128]
    assert (shared[0], size[0], whole[0]) == (np.isin(union, np.intersect1d(a, b)).sum(), 128, False)
    few = np.full((2, 1, 128), neardup.FILL)
    few[0, 0, :5], few[1, 0, :4] = np.sort(values[:5]), np.sort(values[1:5])
    assert [int(x[0]) for x in neardup.estimates(*few)] == [4, 5, 1]


def test_least_overlap_is_a_bound():
    for size in range(1, 33):
        for partner in range(math.ceil(0.85 * size), int(size / 0.85) + 1):
            shared = math.ceil(85 * (size + partner) / 185)
            assert neardup.least_overlap(size, 32, 85) <= max(1, shared - max(0, partner - 32))


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 199)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 130)) and found[200] == 199
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scores(spark):
    docs = awkward(spark).unionByName(documents(spark, [prose(80, n) for n in range(60)], 100))
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, (t,) in by_id(docs, "text").items()}
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in tokens}
    count = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    rows = {r["doc_id"]: r for r in scoring.score_documents(docs).collect()}
    assert set(rows) == set(tokens)
    for i, ws in tokens.items():
        r = rows[i]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base)
    own = [rows[i] for i in tokens if held[i] and rows[i]["n_tokens"] > 20]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)
    assert scoring.score_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [3, 10_000])
def test_scores_equal_a_dictionary(spark, monkeypatch, hot):
    most_frequent = scoring.most_frequent

    def few(counts):
        with monkeypatch.context() as m:
            m.setattr(scoring, "HEAD", 600)
            return most_frequent(counts)

    monkeypatch.setattr(scoring, "most_frequent", few)
    monkeypatch.setattr(scoring, "HOT_LEAST", hot)
    monkeypatch.setattr(scoring, "BUCKET_STEPS", 2000)
    texts = {i: [*prose(150, i % 45).split(), None] for i in range(60)}
    texts[60] = [*prose(40, 1).split(), "unseen", *prose(20, 99).split(), None]
    train = [ws for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for ws in train for w in ws)
    pairs = collections.Counter(p for ws in train for p in zip(["<", *ws], ws))
    shown, norm = collections.Counter({"<": len(train)}), sum(count.values()) + 0.1 * (len(count) + 1)
    shown.update({w: c for w, c in count.items() if w is not None})
    assert len(count) > 650 and len(train) < len(texts)
    frame = documents(spark, [" ".join(ws[:-1]) for ws in texts.values()])
    found = by_id(scoring.score_documents(frame, strength=5.0), "score", "base_score", "n_known")
    for i, ws in texts.items():
        root = [(count[w] + 0.1) / norm for w in ws]
        score = sum(math.log10((pairs[h, w] + 5 * p) / (shown[h] + 5)) for h, w, p in zip(["<", *ws], ws, root))
        assert found[i] == (pytest.approx(score, abs=1e-9), pytest.approx(sum(map(math.log10, root)), abs=1e-9), sum(count[w] > 0 for w in ws))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_scores_of_the_test_table_equal_a_dictionary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, (t,) in by_id(docs, "text").items()}
    train = [ws for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for ws in train for w in ws)
    pairs = collections.Counter(p for ws in train for p in zip([0, *ws], ws))
    norm, k = sum(count.values()) + 0.1 * (len(count) + 1), scoring.STRENGTH
    found = by_id(scoring.score_documents(docs), "score", "n_tokens", "train_tokens")
    assert set(found) == set(texts)
    for i, ws in texts.items():
        score = sum(math.log10((pairs[h, w] + k * (count[w] + 0.1) / norm) / ((count[h] if h != 0 else len(train)) + k)) for h, w in zip([0, *ws], ws))
        assert found[i] == (pytest.approx(score, abs=1e-9 * len(ws)), len(ws), sum(count.values()))


def test_states_are_distributions():
    rng = np.random.default_rng(3)
    counts = np.sort(rng.integers(5, 50, 40))[::-1].astype(np.int64)
    pairs = rng.multinomial(counts, np.full(60, 1 / 60))[:, :40] * (rng.random((40, 40)) < 0.9)
    rest = counts - pairs.sum(axis=1)
    none = np.empty(0, np.int64)
    a = scoring.Automaton(scoring.Head(rng.integers(1, 1 << 60, 40).astype(np.uint64), counts), int(counts.sum()) + 20, 60, 0, (none, none), 4.0)
    for s in range(40):
        seen = 10 ** (a.leave(pairs[s], counts) + a.enter(counts[s]))
        unknown = 10 ** (a.leave(np.zeros(1), np.zeros(1)) + a.enter(counts[s]))
        others = 10 ** (a.leave(np.zeros(20), np.ones(20)) + a.enter(counts[s]))
        assert seen.sum() + unknown.sum() + others.sum() == pytest.approx(1 - rest[s] / (counts[s] + 4))


def test_blocks_of_tokens_start_with_training_texts():
    import pyarrow as pa

    ids = [3, None, *range(10, 40)]
    texts = [prose(5 + n % 7, n) for n in range(32)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts)], ["doc_id", "text"])
    (block,) = scoring.token_blocks([batch])
    train = scoring.is_training(block.ids)
    assert sorted(map(str, block.ids)) == sorted(map(str, ids)) and train.tolist() == [True] * block.train + [False] * (32 - block.train)
    assert dict(zip(block.ids, block.lengths.tolist())) == {i: len(t.split()) + 1 for i, t in zip(ids, texts)}
    ends = np.cumsum(block.lengths)
    assert (block.hashes[ends - 1] == scoring.END).all() and (block.states()[ends - block.lengths] == scoring.BEGIN).all()
    (only,) = scoring.token_blocks([batch], training=True)
    assert only.ids == block.ids[: block.train] and (only.hashes == block.hashes[: len(only.hashes)]).all()


def labelled(spark, n=400):
    rng, texts, labels = random.Random(5), [], []
    for i in range(n):
        kind = i % 4
        text = prose(60, i) if kind < 2 else " | ".join(f"cell{rng.randrange(9)}" for _ in range(60)) if kind == 2 else prose(50, i) + " awful scumbag " + prose(10, i + 1)
        texts.append(text)
        labels.append((i, int(kind != 2), int(kind == 3)))
    return documents(spark, texts), spark.createDataFrame(labels[: n // 2], "doc_id long, quality int, toxic int")


def test_classifier_keeps_good_texts_only(spark):
    docs, labels = labelled(spark)
    found = by_id(classifier.judge(docs, labels), "kept")
    rates = [sum(found[i][0] for i in range(400) if i % 4 == kind) / 100 for kind in range(4)]
    assert rates[0] > 0.98 and rates[1] > 0.98 and rates[2] < 0.02 and rates[3] < 0.02
    kept = classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (k,) in found.items() if k}


def test_classifier_takes_awkward_rows(spark):
    _, labels = labelled(spark, 40)
    found = classifier.judge(awkward(spark), labels.unionByName(spark.createDataFrame([(None, None, None), (1, None, None)], labels.schema)))
    assert found.count() == awkward(spark).count() and not by_id(found, "kept")[0][0]
    none = spark.createDataFrame([], labels.schema)
    assert classifier.judge(documents(spark, ["a b", ""]), none).where("kept").count() == 1
    assert classifier.judge(empty(spark), labels).count() == 0


def test_resampling_equals_a_plain_gumbel_top_k(spark):
    import xxhash

    docs, labels = labelled(spark)
    rows = {r["doc_id"]: r for r in classifier.judge(docs, labels).collect()}
    texts = {i: t for i, (t,) in by_id(docs, "text").items()}
    keys = {}
    for i, t in texts.items():
        h = 42
        for part in (i.to_bytes(8, "little"), t.encode(), (7).to_bytes(8, "little")):
            h = xxhash.xxh64_intdigest(part, h)
        uniform = (h % (1 << 52) + 0.5) / (1 << 52)
        keys[i] = rows[i]["log_weight"] / classifier.TEMPERATURE - math.log(-math.log(uniform))
        assert rows[i]["gumbel_key"] == pytest.approx(keys[i])
    k = sum(r["log_weight"] > 0 for r in rows.values())
    best = set(sorted(keys, key=lambda i: -keys[i])[:k])
    assert {i for i, r in rows.items() if r["kept"]} == best and len({r["log_weight"] for r in rows.values() if r["kept"]}) > k / 3


def test_noise_decides_near_the_cut_and_ties_stay_together(spark, monkeypatch):
    monkeypatch.setattr(classifier, "best_cut", lambda good, poor, cost=10.0: float(np.median([*good, *poor])))
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["| cell", *prose(3, i).split()] if rng.random() < i / 600 else prose(4, i).split()) for _ in range(60)) for i in range(600)]
    docs = documents(spark, texts).withColumn("__key", F.lit(1)).withColumn("__RATIO", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i < 200 or 200 <= i < 400 and i % 2), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    found = classifier.judge(docs, labels).collect()
    cut = sorted((r["log_weight"] for r in found), reverse=True)[sum(r["kept"] for r in found) - 1]
    assert {r["doc_id"] for r in found if r["kept"]} != {r["doc_id"] for r in found if r["log_weight"] >= cut}
    kept = classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found)
    one = documents(spark, ["same words here"] * 5).withColumn("doc_id", F.lit(3).cast("long"))
    assert classifier.judge(one, labels).where("kept").count() in (0, 5)


def test_kth_largest_is_exact(spark):
    rng = random.Random(6)
    keys = [rng.choice([rng.gauss(0, 1), 0.5]) for _ in range(3000)]
    frame = spark.createDataFrame([(k,) for k in keys], "key double")
    ordered = sorted(keys, reverse=True)
    for k in (1, 7, 1500, 3000):
        assert classifier.kth_largest(frame, k, bins=16, few=20) == ordered[k - 1]


def plain_passages(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        w = (texts[i] or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            if key in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_passages(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 10)
    monkeypatch.setattr(substring, "SHARD_WORDS", 3000)
    common = prose(45, 31)
    texts = [f"{prose(20 + n, n)} {common if n % 2 else ' '.join(common.split()[n % 9 :])} {prose(25, n + 500)}" for n in range(60)] + [prose(100, 40)] * 3 + ["a b " * 100]
    docs = awkward(spark).unionByName(documents(spark, texts, 100))
    known = {i: t for i, (t,) in by_id(docs, "text").items() if i is not None}
    found = by_id(substring.digest_kept(docs), "n_words", "n_removed", "kept_sha256")
    assert found.pop(None)[1] == 0
    assert found == plain_passages(known)
    cut = substring.remove_passages(docs)
    assert cut.columns == docs.columns
    for i, (text, n) in by_id(cut, "text", "n_chars").items():
        if i is not None:
            assert hashlib.sha256(b" ".join((text or "").encode().split())).hexdigest() == found[i][2]
            assert text is None or n == len(text)
    assert substring.digest_kept(empty(spark)).count() == 0


@pytest.mark.parametrize("partitions", [1, 4])
def test_passages_of_repeated_ids(spark, partitions):
    long, short = prose(100, 61), prose(50, 62)
    first, other = sorted((long, short), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    rows = [(5, short), (5, long), (6, "start " + first + " end"), (7, other), (5, first)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, windows string, windows_ long").repartition(partitions)
    found = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.digest_kept(frame).collect())
    n, m = len(first.split()), len(other.split())
    assert found == {(5, n, 0): 2, (5, m, 0): 1, (6, n + 2, n): 1, (7, m, 0): 1}
    cut = substring.remove_passages(frame)
    assert cut.columns == frame.columns and {r["text"] for r in cut.where("doc_id = 6").collect()} == {"start end"}


def test_full_text_index():
    rng = np.random.default_rng(7)
    text = np.concatenate([[0], rng.integers(1, 6, 250), [0], rng.integers(1, 6, 250), [0]])
    keys = rng.permutation(len(text))
    index = FMIndex(text, keys, 4)

    def places(p):
        return [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]

    for size in (1, 2, 3, 4):
        patterns = rng.integers(1, 6, (100, size))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            assert b - a == len(places(p))
            assert a == b or index.earliest(size, np.array([a]))[0] == min(keys[i] for i in places(p))
    starts = np.array([i for i in range(len(text) - 4) if (text[i : i + 4] > 0).all()])
    patterns = np.stack([text[starts + j] for j in range(4)], axis=1)
    found = index.matching_statistics(patterns, keys[starts])
    for i, p, length in zip(starts, patterns, found, strict=True):
        assert length == max([0, *(d for d in range(1, 5) if any(keys[j] < keys[i] for j in places(p[:d])))])


def test_top_k(spark):
    rng = np.random.default_rng(8)
    x = [rng.normal(size=8).tolist() for _ in range(300)]
    x[10] = x[20]
    x[11], x[12], x[13], x[14] = None, [1.0, None], [float("nan")] * 8, [0.5, 0.25]
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, score int")
    rows = topk_search.quantize(frame)
    whole = {i: [math.floor(256 * c) for c in v] for i, v in enumerate(x) if v is not None and None not in v and not any(map(math.isnan, v))}
    found = collections.defaultdict(list)
    for r in topk_search.top_k(rows, rows.where("vec_id % 50 = 0"), 5, rows_per_group=70).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in (i for i in whole if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)
        assert found[q] == [(i, -s) for s, i in scores[:5]]
    few = rows.where("vec_id < 3")
    assert topk_search.top_k(few, few.where("vec_id = 0"), 5).count() == 2
    none = rows.where("vec_id < 0")
    assert topk_search.top_k(none, none).count() == 0


def test_top_k_takes_great_components(spark):
    x = [[300000.0, 0.0], [1.0, 2.0], [1.0, 3.0], [-1e12, 5.0], [2.5e5, 1e7], [3.0, 1.0]]
    frame = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    rows = topk_search.quantize(frame)
    whole = [[math.floor(256 * c) for c in v] for v in x]
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk_search.top_k(rows, rows.where("vec_id IN (1, 2, 5)"), 3).collect()}
    for q in (1, 2, 5):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in enumerate(whole) if i != q)[:3]
        assert [found[q, r] for r in (1, 2, 3)] == [(i, -s) for s, i in best]
    assert topk_search.products(np.array([[2.0**40]]), np.array([[2.0**20 + 1]])).tolist() == [[(1 << 60) + (1 << 40)]]
    wide = topk_search.BlockIndex(np.arange(3), np.array([[2.0**60], [2.0**20], [1.0]]))
    with pytest.raises(OverflowError):
        wide.search(np.array([9]), np.array([[2.0**20]]), 2)


def test_blocks_are_pruned():
    rng = np.random.default_rng(9)
    vectors = np.zeros((4096, 8), np.int64)
    vectors[np.arange(4096), rng.integers(0, 8, 4096)] = rng.integers(1, 100, 4096)
    index = topk_search.BlockIndex(np.arange(4096), vectors, block=64)
    seen = []
    index.blocks = [b.view(type("Seen", (np.ndarray,), {"T": property(lambda s: seen.append(1) or np.asarray(s).T)})) for b in index.blocks]
    query = np.zeros((1, 8), np.int64)
    query[0, 3] = 5
    _, ids, scores = index.search(np.array([-1]), query, 5)
    order = np.lexsort((np.arange(4096), -(vectors @ query[0])))[:5]
    assert ids.tolist() == order.tolist() and scores.tolist() == (vectors @ query[0])[order].tolist()


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None or not os.path.isdir("/root/testdata/sf0.001"), reason="needs the pipeline and the driver's tables")
def test_pipeline_stages(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    sizes = list(map(len, seen))
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4] == docs.count()
    texts = seen[4]
    assert set(seen[2]) == {i for i, (_, c, _) in plain_classes(seen[1], 80).items() if c == i}
    for i, (_, _, digest) in plain_passages(seen[2]).items():
        assert hashlib.sha256(b" ".join((seen[3][i] or "").encode().split())).hexdigest() == digest
    assert texts == {i: secrets.redact(t) for i, t in seen[3].items()} and texts != seen[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(texts)
    assert corpus_pipeline.run(spark, sf_dir).agg({"length": "sum"}).first()[0] == packed.agg({"length": "sum"}).first()[0]


def test_pipeline_takes_awkward_and_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = labelled(spark, 60)
    twice = documents(spark, [prose(80, 71), prose(90, 72)], 500).withColumn("doc_id", F.lit(700).cast("long"))
    for name, table in (("awkward", awkward(spark).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(twice)), ("empty", empty(spark))):
        own = table.withColumn("__windows", F.lit(1)).withColumn("windows", F.lit("x")).withColumn("__ratio", F.lit(2.0))
        own.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.withColumn("doc_id", F.col("doc_id") + 1000).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert found.where("length <= 0").count() == 0 and (found.count() > 0) == (name == "awkward")
        rows = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, f"{tmp_path}/{name}").columns == own.columns


def test_very_long_texts(spark):
    text = prose(300_000, 81)
    docs = documents(spark, [text, text[:500], "x" * 3_000_000])
    assert [r["n_removed"] for r in substring.digest_kept(docs).orderBy("doc_id").collect()][0] == plain_passages({0: text})[0][1]
    assert [r["n_tokens"] for r in scoring.score_documents(docs).orderBy("doc_id").collect()] == [300_001, len(text[:500].split()) + 1, 2]
    assert neardup.near_duplicates(docs).where("kept").count() == 3
