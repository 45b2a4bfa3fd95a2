import numpy as np
import pytest

from vecengine.operators import assign, compare, linalg, reduce, topk, update
from vecengine.plans import lloyd
from vecengine.sources import datasets
from vecengine.sources.frames import accepts, as_samples, centers_frame, check_centers, check_samples


def matrix(spark, x, weight=None):
    rows = [(i, [float(v) for v in r], 1.0 if weight is None else float(weight[i])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, features array<double>, weight double")


def vector(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx long, value double")


@pytest.mark.parametrize("shape", [(1, 1), (1, 3), (3, 1), (3, 5), (5, 3), (3, 9)])
def test_sums(spark, shape):
    x = np.arange(shape[0] * shape[1]).reshape(shape)
    rows = matrix(spark, x)
    assert [r["total"] for r in reduce.sum_axis0(rows).orderBy("pos").collect()] == x.sum(axis=0).tolist()
    assert [r["total"] for r in reduce.sum_axis1(rows).orderBy("id").collect()] == x.sum(axis=1).tolist()
    assert reduce.sum_all(rows).first()["total"] == x.sum()
    assert reduce.sum_all(rows, lambda v: v * v).first()["total"] == (x * x).sum()
    assert reduce.sum_all(rows.where("id < 0")).first()["total"] == 0


# Vectors and the places of their least values.
@pytest.mark.parametrize(("values", "place"), [((3, 1, 0, 2), 2), ((0, 1, 3, 2), 0), ((3, 1, 2, -1, -2), 4), ((5,), 0), ((1, 0, 0), 1)])
def test_argmin(spark, values, place):
    assert reduce.argmin(vector(spark, values), "value", "idx").first()["argmin"] == place


def test_column_operations(spark):
    x = np.array([[1.0, 10.0], [3.0, 20.0], [5.0, 60.0]])
    rows = matrix(spark, x)
    assert np.allclose([r["features"] for r in reduce.centered(rows).orderBy("id").collect()], x - x.mean(axis=0))
    assert np.allclose(reduce.scaled_tolerance(rows, 0.5).first()[0], 0.5 * x.var(axis=0).mean())
    scaled = np.array([r["features"] for r in datasets.min_max_scaled(rows).orderBy("id").collect()])
    assert np.allclose(scaled, (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0)))
    assert reduce.uniform_weights(rows).first()[0]
    assert not reduce.uniform_weights(matrix(spark, x, [1, 2, 1])).first()[0]


def test_resampling_keeps_every_row(spark):
    rows = matrix(spark, np.eye(4))
    more = datasets.resample(rows, 10, seed=1)
    assert more.count() == 10 and more.select("id").distinct().count() == 10 and more.select("features").distinct().count() == 4
    assert datasets.resample(rows, 3, seed=1).count() == 3
    assert datasets.keep_features(rows, [2, 0]).first()["features"] == [0.0, 1.0]
    assert datasets.random_weights(rows).agg({"weight": "max"}).first()[0] < 1


PATTERNS = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10],
    [5, 5, 5, 1, 0, 2, 3, 4, 1, 2, 3],
    [9, 9, 9, 9, 1, 2, 3, 4, 5, 6, 7],
    [9, 8, 8, 8, 8, 1, 2, 3, 4, 5, 6],
    [2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2],
    [-1, -5, -2, -2, 0, 0, -7, 3, 3, -9, 1],
]


@pytest.mark.parametrize("k", [1, 3])
def test_topk(spark, k):
    for values in PATTERNS:
        rows = vector(spark, values)
        best = sorted(values, reverse=True)[:k]
        assert [r["value"] for r in topk.topk(rows, "value", k).collect()] == best
        assert [values[r["index"]] for r in topk.topk_idx(rows, "value", "idx", k).collect()] == best
        kth = topk.kth_value(rows, "value", k).first()
        assert (kth["kth"], kth["n_data"], kth["n_topk"]) == (best[-1], values.count(best[-1]), best.count(best[-1]))
    x = matrix(spark, PATTERNS)
    found = topk.topk_rows(x, k).orderBy("id").collect()
    places = topk.topk_idx_rows(x, k).orderBy("id").collect()
    for values, f, p in zip(PATTERNS, found, places, strict=True):
        assert f["values"] == sorted(values, reverse=True)[:k] == [values[i] for i in p["indexes"]]


def test_topk_beyond_size(spark):
    with pytest.raises(ValueError, match="beyond"):
        topk.topk(vector(spark, [1, 2]), "value", 3)
    with pytest.raises(Exception, match="has 2 values"):
        topk.topk_rows(matrix(spark, [[1, 2], [3, 4]]), 3).collect()


@pytest.mark.parametrize(("n", "k", "m"), [(1, 1, 1), (2, 3, 4), (5, 10, 4)])
def test_matmul(spark, n, k, m):
    rng = np.random.default_rng(123)
    x, y = rng.random((n, k)), rng.random((k, m))

    def entries(a):
        return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(a)], "row int, col int, value double")

    out = np.zeros((n, m))
    for r in linalg.matmul_long(entries(x), entries(y.T)).collect():
        out[r["i"], r["j"]] = r["value"]
    assert np.allclose(out, x @ y)
    rows = linalg.matmul_rows(matrix(spark, x), y.T, finish=np.exp).orderBy("id").collect()
    assert np.allclose([r["values"] for r in rows], np.exp(x @ y))
    rows = linalg.matmul_rows(matrix(spark, x), y.T, multiply="squared_diff").orderBy("id").collect()
    assert np.allclose([r["values"] for r in rows], ((x[:, None, :] - y.T[None]) ** 2).sum(axis=2))
    with pytest.raises(ValueError, match="multiply"):
        linalg.matmul_rows(matrix(spark, x), y.T, multiply="max")


def test_matmul_prime_sizes(spark):
    rng = np.random.default_rng(123)
    x, y = rng.random((499, 661)), rng.random((661, 263))
    rows = linalg.matmul_rows(matrix(spark, x), y.T).orderBy("id").collect()
    assert np.allclose([r["values"] for r in rows], x @ y)


def test_distances_and_labels(spark):
    rng = np.random.default_rng(42)
    x, c, w = rng.random((100, 10)), rng.normal(size=(5, 10)), rng.normal(size=100)
    rows, own = matrix(spark, x, w), centers_frame(spark.range(1), c)
    d2 = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    found = np.zeros((100, 5))
    for r in assign.pairwise(rows, own).collect():
        found[r["id"], r["cluster_id"]] = r["distance"]
    assert np.allclose(found, np.sqrt(d2), rtol=1e-7)
    assert np.allclose([r["distances"] for r in assign.distances(rows, c).orderBy("id").collect()], np.sqrt(d2), rtol=1e-7)
    labelled = assign.nearest(rows, own)
    for backend in ("expr", "arrow", "auto"):
        assert [r["label"] for r in assign.labels(rows, c, backend).orderBy("id").collect()] == d2.argmin(axis=1).tolist()
    assert assign.inertia(labelled).first()[0] == pytest.approx((w * d2.min(axis=1)).sum(), rel=1e-9)
    assert sum(r["weighted_d2"] for r in assign.looked_up(labelled, own).collect()) == pytest.approx((w * d2.min(axis=1)).sum(), rel=1e-9)


def test_gather(spark):
    x = np.arange(20.0).reshape(10, 2)
    found = linalg.gather(matrix(spark, x), [7, 2, 7]).orderBy("place").collect()
    assert [(r["id"], r["features"]) for r in found] == [(i, x[i].tolist()) for i in (7, 2, 7)]


def test_ties_go_to_the_lower_id(spark):
    rows, c = matrix(spark, [[0.0, 0.0]]), np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    assert {assign.labels(rows, c, b).first()["label"] for b in ("expr", "arrow")} == {0}


def test_update(spark):
    rows = matrix(spark, [[0, 0], [2, 0], [10, 10]], [1, 3, 2])
    own = centers_frame(rows, np.array([[0.0, 0.0], [10.0, 9.0], [99.0, 99.0]]))
    labelled = assign.nearest(rows, own)
    assert {r["cluster_id"]: r["size"] for r in update.sizes(labelled, own).collect()} == {0: 4.0, 1: 2.0, 2: 0.0}
    assert [r[0] for r in update.empty_clusters(labelled, own).collect()] == [2]
    new = update.updated(labelled, own)
    assert {r["cluster_id"]: r["center"] for r in new.collect()} == {0: [1.5, 0.0], 1: [10.0, 10.0], 2: [99.0, 99.0]}
    assert update.shift(own, new).first()[0] == 2.25 + 1
    centers = np.array([[0.0, 0.0], [10.0, 9.0], [99.0, 99.0]])
    assert [(r["id"], r["label"], -r["order"]) for r in lloyd.farthest_samples(rows.repartition(2), centers, centers, 2, np.zeros(2))] == [(1, 0, 4.0), (2, 1, 1.0)]


def test_block_sums_meet_over_partitions(spark):
    x, w = np.random.default_rng(6).normal(size=(97, 5)), np.random.default_rng(7).random(97)
    rows = matrix(spark, x, w).repartition(5)
    found = {r["pos"]: r for r in reduce.column_partials(rows).groupBy("pos").agg({"total": "sum", "low": "min", "high": "max", "n": "sum"}).collect()}
    assert np.allclose([[found[j][c] for j in range(5)] for c in ("sum(total)", "min(low)", "max(high)", "sum(n)")], [x.sum(axis=0), x.min(axis=0), x.max(axis=0), np.full(5, 97)])
    assert reduce.sum_axis0(rows.where("id < 0")).count() == 0
    c = np.random.default_rng(8).normal(size=(3, 5))
    labels = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    blocks = assign.nearest_blocks(rows, c)
    assert [r["label"] for r in blocks.orderBy("id").collect()] == labels.tolist()
    means = {(r["cluster_id"], r["pos"]): r["value"] for r in update.weighted_means(blocks).collect()}
    for j in set(labels.tolist()):
        assert np.allclose([means[j, p] for p in range(5)], np.average(x[labels == j], axis=0, weights=w[labels == j]))


def test_label_sets(spark):
    labels = [0, 1, 0, 2, 2, 7, 6, 5, 3, 3]
    first = spark.createDataFrame(list(enumerate(labels)), "id long, label int")
    assert compare.distinct_labels(first).first()[0] == 7
    coarse = spark.createDataFrame([(i, 0) for i in range(10)], "id long, label int")
    assert compare.same_clustering(first, coarse).first()["same"]
    assert not compare.same_clustering(first, coarse, bijective=True).first()["same"]
    assert not compare.same_clustering(coarse, first).first()["same"]


def test_samples_are_checked(spark):
    with pytest.raises(ValueError, match="no samples"):
        check_samples(matrix(spark, np.eye(2)).where("id < 0"))
    with pytest.raises(ValueError, match="finite"):
        check_samples(matrix(spark, [[1, float("nan")]]))
    with pytest.raises(ValueError, match="components"):
        check_samples(spark.createDataFrame([(1, [1.0], 1.0), (2, [1.0, 2.0], 1.0)], "id long, features array<double>, weight double"))
    shape = check_samples(matrix(spark, np.eye(3)))
    assert (shape.n, shape.d) == (3, 3)
    with pytest.raises(ValueError, match="shape"):
        check_centers([[1.0, 2.0]], shape, 1)
    with pytest.raises(ValueError, match="algorithm"):
        accepts("elkan")
    rows = spark.createDataFrame([(1, 2, 3.0)], "key int, a int, b double")
    assert as_samples(rows, "key", ["a", "b"], 2).first() == (1, [2.0, 3.0], 2.0)
    with pytest.raises(ValueError, match="dense array"):
        as_samples(rows, "key", "b")
