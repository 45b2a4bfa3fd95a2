"""KMeans as an estimator over sample tables."""

from __future__ import annotations

import logging
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import assign
from ..operators.compare import distinct_labels, same_clustering
from ..sources.frames import accepts, as_samples, check_centers, check_samples, checked
from . import seeding
from .lloyd import Fitted, column_sums, lloyd, squares_sum, total_inertia

log = logging.getLogger(__name__)


class KMeans:
    """Weighted k-means with Lloyd's algorithm.

    Samples are tables with an id, a vector column (or scalar columns) and
    optionally a weight. After ``fit``: cluster_centers_ (K x d), labels_ (a lazy
    table of id and label), inertia_, n_iter_, history_. Samples are never
    changed, so ``copy_x`` has no effect.
    """

    def __init__(
        self,
        n_clusters: int = 8,
        *,
        init: str | np.ndarray | list | Callable = "k-means++",
        n_init: int | str = "auto",
        max_iter: int = 300,
        tol: float = 1e-4,
        verbose: int = 0,
        random_state: int | None = None,
        copy_x: bool = True,
        algorithm: str = "lloyd",
        id_col: str = "id",
        features_col: str | list[str] = "features",
        backend: str = "auto",
    ):
        self.n_clusters, self.init, self.n_init, self.max_iter, self.tol = n_clusters, init, n_init, max_iter, tol
        self.verbose, self.random_state, self.copy_x, self.algorithm = verbose, random_state, copy_x, algorithm
        self.id_col, self.features_col, self.backend = id_col, features_col, backend

    def _samples(self, rows: DataFrame, weight: str | float | Column | None = None) -> DataFrame:
        return as_samples(rows, self.id_col, self.features_col, weight)

    def _runs(self) -> int:
        if self.n_init != "auto":
            return int(self.n_init)
        return 10 if isinstance(self.init, str) and self.init == "random" or callable(self.init) else 1

    def _start(self, samples: DataFrame, shape, shift: np.ndarray, seed: int) -> np.ndarray:
        """Initial centres in shifted coordinates."""
        if callable(self.init):
            moved = F.array(*(F.lit(float(v)) for v in shift))
            given = samples.withColumn("features", F.zip_with("features", moved, lambda v, m: v - m))
            return check_centers(self.init(given, self.n_clusters, random_state=seed), shape, self.n_clusters)
        if not isinstance(self.init, str):
            return check_centers(self.init, shape, self.n_clusters) - shift
        if self.init == "k-means++":
            return seeding.kmeans_plusplus(samples, self.n_clusters, seed)[0] - shift
        if self.init == "random":
            return seeding.as_centers(seeding.random_rows(samples, self.n_clusters, seed), self.n_clusters)[0] - shift
        raise ValueError(f"init {self.init!r} is not 'k-means++', 'random', an array or a callable")

    def fit(self, rows: DataFrame, sample_weight: str | float | Column | None = None) -> "KMeans":
        accepts(self.algorithm)
        samples = self._samples(rows, sample_weight).persist()
        try:
            shape = check_samples(samples)
            if shape.n < self.n_clusters:
                raise ValueError(f"{self.n_clusters} clusters are asked for, but there are {shape.n} samples")
            shift = column_sums(samples, shape.d) / shape.n
            if not (shift**2).sum():
                shift = np.zeros(shape.d)
            tol = self.tol * squares_sum(samples, shift) / (shape.n * shape.d) if self.tol else 0.0
            seed = int(np.random.SeedSequence().entropy % (1 << 32)) if self.random_state is None else int(self.random_state)
            best: Fitted | None = None
            for i in range(self._runs()):
                found = lloyd(samples, self._start(samples, shape, shift, seed + i), self.max_iter, tol, shift, bool(self.verbose))
                if best is None or (found.inertia < best.inertia and not self._same(samples, best.centers + shift, found.centers + shift)):
                    best = found
        finally:
            samples.unpersist()
        self.cluster_centers_ = best.centers + shift
        self.inertia_, self.n_iter_, self.history_, self.reason_ = best.inertia, best.n_iter, best.history, best.reason
        self.labels_ = self.predict(rows)
        if best.used < self.n_clusters:
            warnings.warn(f"{best.used} distinct clusters are fewer than n_clusters ({self.n_clusters}): samples may be repeated", RuntimeWarning, stacklevel=2)
        return self

    def _checked(self, rows: DataFrame, weight: str | float | Column | None = None) -> DataFrame:
        return checked(self._samples(rows, weight), self.cluster_centers_.shape[1])

    def _same(self, samples: DataFrame, first: np.ndarray, second: np.ndarray) -> bool:
        return bool(same_clustering(assign.labels(samples, first, "arrow"), assign.labels(samples, second, "arrow")).first()["same"])

    def n_distinct_labels(self) -> int:
        """Clusters in use; a warning if they are fewer than asked for."""
        n = distinct_labels(self.labels_).first()["n_labels"]
        if n < self.n_clusters:
            log.warning("%d distinct clusters are fewer than n_clusters (%d): samples may be repeated", n, self.n_clusters)
        return n

    def predict(self, rows: DataFrame, sample_weight=None) -> DataFrame:
        """(id, label), lazily; weights make no difference."""
        return assign.labels(self._checked(rows), self.cluster_centers_, self.backend)

    def transform(self, rows: DataFrame) -> DataFrame:
        """(id, distances) to all centres, lazily."""
        return assign.distances(self._checked(rows), self.cluster_centers_)

    def score(self, rows: DataFrame, sample_weight: str | float | Column | None = None) -> float:
        """Minus the inertia of the rows; weights may be negative."""
        return -total_inertia(self._checked(rows, sample_weight), self.cluster_centers_, np.zeros(self.cluster_centers_.shape[1]))[0]

    def fit_predict(self, rows: DataFrame, sample_weight=None) -> DataFrame:
        return self.fit(rows, sample_weight).labels_

    def fit_transform(self, rows: DataFrame, sample_weight=None) -> DataFrame:
        return self.fit(rows, sample_weight).transform(rows)

    def save(self, spark, path: str) -> None:
        """Writes what was fitted as Parquet: centres with inertia and number of iterations, and labels where there are any."""
        fitted = (getattr(self, "inertia_", None), getattr(self, "n_iter_", None))
        rows = [(i, c.tolist(), *fitted) for i, c in enumerate(self.cluster_centers_)]
        spark.createDataFrame(rows, "cluster_id int, center array<double>, inertia double, n_iter int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
        if getattr(self, "labels_", None) is not None:
            self.labels_.write.mode("overwrite").parquet(f"{path}/labels")

    @classmethod
    def load(cls, spark, path: str, **parameters) -> "KMeans":
        """An estimator with what ``save`` wrote, ready to predict."""
        rows = spark.read.parquet(f"{path}/centers").orderBy("cluster_id").collect()
        model = cls(len(rows), **parameters)
        model.cluster_centers_ = np.array([r["center"] for r in rows])
        model.inertia_, model.n_iter_ = rows[0]["inertia"], rows[0]["n_iter"]
        try:
            model.labels_ = spark.read.parquet(f"{path}/labels")
        except AnalysisException:  # none were saved
            model.labels_ = None
        return model
