import numpy as np
import pytest

from vecengine.functions.rng import streams
from vecengine.operators.compare import same_clustering
from vecengine.plans import seeding
from vecengine.plans.kmeans import KMeans
from vecengine.streaming.predict import predict_stream
from test_operators import matrix


def blobs(n=100, seed=42):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 1.0, (n // 4, 2)) for c in ((0, 0), (8, 8), (-8, 8), (8, -8))])


def host_lloyd(x, w, centers, max_iter, tol):
    """Plain numpy iterations without empty clusters."""
    centers, tol, last = centers.copy(), tol * x.var(axis=0).mean(), None
    for t in range(1, max_iter + 1):
        labels = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([np.average(x[labels == j], axis=0, weights=w[labels == j]) for j in range(len(centers))])
        moved, centers = ((new - centers) ** 2).sum(), new
        if last is not None and (labels == last).all() or moved <= tol:
            break
        last = labels
    d2 = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    return centers, d2.argmin(axis=1), (w * d2.min(axis=1)).sum(), t


@pytest.mark.parametrize("weighted", [False, True])
def test_fit_equals_plain_lloyd(spark, weighted):
    x = blobs()
    w = np.random.default_rng(1).random(100) + 0.1 if weighted else np.ones(100)
    rows = matrix(spark, x, w).repartition(3)
    model = KMeans(4, init=x[[0, 30, 60, 90]], max_iter=50).fit(rows, "weight")
    centers, labels, inertia, n_iter = host_lloyd(x, w, x[[0, 30, 60, 90]], 50, 1e-4)
    assert np.allclose(model.cluster_centers_, centers) and model.n_iter_ == n_iter
    assert model.inertia_ == pytest.approx(inertia)
    assert [r["label"] for r in model.labels_.orderBy("id").collect()] == labels.tolist()
    assert model.score(rows, "weight") == pytest.approx(-inertia)
    assert model.n_distinct_labels() == 4
    far = np.sqrt(((x[:, None] - centers[None]) ** 2).sum(axis=2))
    assert np.allclose([r["distances"] for r in model.transform(rows).orderBy("id").collect()], far)


def test_fit_predict_and_fit_transform(spark):
    x, start = blobs(), blobs()[[0, 30, 60, 90]]
    rows = matrix(spark, x)
    first = KMeans(4, init=start, max_iter=2).fit(rows)
    again = KMeans(4, init=start, max_iter=2).fit_predict(rows)
    assert same_clustering(first.labels_, again, bijective=True).first()["same"]
    assert KMeans(4, init=start, max_iter=2).fit_transform(rows).orderBy("id").collect() == first.transform(rows).orderBy("id").collect()


def test_partitioning_makes_no_difference(spark):
    x = blobs()
    results = [KMeans(4, random_state=3, max_iter=10).fit(matrix(spark, x).repartition(n)).cluster_centers_ for n in (1, 5)]
    assert np.allclose(*results)


def test_predict_of_own_centers(spark, tmp_path):
    # Ten centres.
    centers = np.arange(100.0).reshape(10, 10)
    model = KMeans(10, init=centers, max_iter=1).fit(matrix(spark, centers))
    assert [r["label"] for r in model.predict(matrix(spark, centers)).orderBy("id").collect()] == list(range(10))
    model.save(spark, str(tmp_path / "model"))
    loaded = KMeans.load(spark, str(tmp_path / "model"))
    assert (loaded.cluster_centers_ == model.cluster_centers_).all()
    assert (loaded.inertia_, loaded.n_iter_) == (model.inertia_, model.n_iter_)
    assert loaded.labels_.orderBy("id").collect() == model.labels_.orderBy("id").collect()


def test_prediction_checks_its_rows(spark):
    model = KMeans(2, init=np.eye(2), max_iter=1).fit(matrix(spark, np.eye(2)))
    for bad in ([[1.0, float("nan")]], [[1.0, 2.0, 3.0]], [[float("inf"), 0.0]]):
        rows = matrix(spark, bad)
        for run in (lambda: model.predict(rows).collect(), lambda: model.transform(rows).collect(), lambda: model.score(rows)):
            with pytest.raises(Exception, match="2 finite components"):
                run()
    with pytest.raises(Exception, match="weight"):
        model.score(matrix(spark, np.eye(2), [1.0, float("nan")]), "weight")


@pytest.mark.parametrize("better", [0, 1])
def test_the_best_of_the_runs_is_kept(spark, better):
    x = blobs()
    good, poor = x[[0, 30, 60, 90]], np.array([[8.0, 8.0], [8.0, 9.0], [9.0, 8.0], [-4.0, 0.0]])
    seen = []

    def init(rows, k, random_state):
        seen.append(random_state)
        return (good if len(seen) - 1 == better else poor) - x.mean(axis=0)

    model = KMeans(4, init=init, n_init=2, max_iter=1, tol=0, random_state=5).fit(matrix(spark, x))
    alone = [KMeans(4, init=c, n_init=1, max_iter=1, tol=0).fit(matrix(spark, x)).inertia_ for c in (good, poor)]
    assert alone[0] < alone[1] and model.inertia_ == pytest.approx(alone[0]) and seen == [5, 6]


def test_few_distinct_clusters_are_warned_of(spark):
    rows = matrix(spark, np.repeat(np.eye(2), 4, axis=0))
    with pytest.warns(RuntimeWarning, match="2 distinct clusters are fewer than n_clusters"):
        model = KMeans(3, init=np.array([[1.0, 0], [0, 1], [1, 0]]), max_iter=2).fit(rows)
    assert model.n_distinct_labels() == 2


def test_verbose_logs_every_iteration(spark, caplog):
    x = blobs()
    with caplog.at_level("INFO", "vecengine.plans.lloyd"):
        model = KMeans(4, init=x[[0, 30, 60, 90]], max_iter=50, verbose=1).fit(matrix(spark, x))
    lines = [r.getMessage() for r in caplog.records]
    steps = [m for m in lines if m.startswith("iteration ")]
    assert len(steps) == model.n_iter_ == len(model.history_)
    values = [h["inertia"] for h in model.history_]
    assert [float(m.split()[-1]) for m in steps] == values and values == sorted(values, reverse=True)
    assert lines[-1] == f"stopped after iteration {model.n_iter_}: {model.reason_}"


def test_relocation_of_one_cluster(spark):
    # Samples, start and outcome of a relocation.
    x = np.array([[0, 0], [0.5, 0], [0.5, 1], [1, 1]])
    model = KMeans(2, init=np.array([[0.5, 0.5], [3.0, 3.0]])).fit(matrix(spark, x))
    labels = [r["label"] for r in model.labels_.orderBy("id").collect()]
    assert model.inertia_ == pytest.approx(0.25) and model.n_iter_ == 3
    order = [0, 1] if labels == [0, 0, 1, 1] else [1, 0]
    assert labels in ([0, 0, 1, 1], [1, 1, 0, 0])
    assert np.allclose(model.cluster_centers_[order], [[0.25, 0], [0.75, 1]])


def test_relocation_of_two_clusters(spark):
    # Samples, start and outcome of two relocations.
    x = np.array([[-10.0], [-9.5], [-9], [-8.5], [-8], [-1], [1], [9], [9.5], [10]])
    model = KMeans(3, init=np.full((3, 1), -10.0), max_iter=1).fit(matrix(spark, x))
    labels = [r["label"] for r in model.labels_.orderBy("id").collect()]
    expected = [0, 0, 0, 0, 0, 0, 0, 2, 2, 1]
    assert model.n_iter_ == 1 and len(set(zip(labels, expected, strict=True))) == 3


@pytest.mark.parametrize("init", ["k-means++", "random"])
def test_seeding_gives_rows(spark, init):
    x = np.random.default_rng(5).random((60, 3))
    rows = matrix(spark, x, np.random.default_rng(6).random(60)).repartition(4)
    if init == "k-means++":
        centers, ids = seeding.kmeans_plusplus(rows, 20, seed=42)
    else:
        centers, ids = seeding.as_centers(seeding.random_rows(rows, 20, seed=42), 20)
    assert len(set(ids)) == 20 and np.allclose(centers, x[ids])


def test_plusplus_follows_the_running_potential(spark):
    x = np.random.default_rng(8).random((50, 2))
    w = np.random.default_rng(9).random(50)
    _, ids = seeding.kmeans_plusplus(matrix(spark, x, w).repartition(3), 6, seed=11)
    draw = streams(3, 11)
    own = [draw[0].raw() % 50]
    pot = w * ((x - x[own[0]]) ** 2).sum(axis=1)
    for _ in range(5):
        picked = [min(int(np.searchsorted(np.cumsum(pot), s.uniform() * pot.sum())), 49) for s in draw]
        tried = [np.minimum(pot, w * ((x - x[i]) ** 2).sum(axis=1)) for i in picked]
        best = int(np.argmin([t.sum() for t in tried]))
        own.append(picked[best])
        pot = tried[best]
    assert ids == own


def test_plusplus_beats_random_rows(spark):
    x = blobs(80)
    rows = matrix(spark, x).cache()

    def mean_score(init):
        return np.mean([KMeans(4, init=init, n_init=1, max_iter=1, random_state=s).fit(rows).inertia_ for s in range(10)])

    assert mean_score("k-means++") < mean_score("random")


def test_equal_points(spark):
    centers, _ = seeding.kmeans_plusplus(matrix(spark, np.ones((5, 2))), 2, seed=0)
    assert (centers == 1).all()


def test_callable_init_sees_centered_samples(spark):
    x = blobs() + 100

    def first_rows(rows, k, random_state):
        got = np.array([r["features"] for r in rows.orderBy("id").collect()])
        assert np.allclose(got.mean(axis=0), 0)
        return got[[0, 30, 60, 90]]

    model = KMeans(4, init=first_rows, n_init=1).fit(matrix(spark, x))
    assert np.allclose(model.cluster_centers_, KMeans(4, init=x[[0, 30, 60, 90]]).fit(matrix(spark, x)).cluster_centers_)


def test_errors(spark):
    rows = matrix(spark, np.eye(3))
    for parameters, message in (({"algorithm": "elkan"}, "algorithm"), ({"init": "best"}, "init"), ({"n_clusters": 4}, "4 clusters"), ({"init": np.ones((2, 3))}, "shape")):
        with pytest.raises(ValueError, match=message):
            KMeans(**({"n_clusters": 3} | parameters)).fit(rows)


def test_stream_gets_the_same_labels(spark, tmp_path):
    x, centers = blobs(), np.array([[0.0, 0.0], [8.0, 8.0]])
    rows = matrix(spark, x)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = predict_stream(spark, stream, centers, "id", "features").writeStream.format("memory").queryName("labels").start()
    query.processAllAvailable()
    query.stop()
    found = [r["label"] for r in spark.table("labels").orderBy("id").collect()]
    assert found == ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()
