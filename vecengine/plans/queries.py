"""Registered queries of the vector engine and their DuckDB twins.

Samples are the embeddings, weighted by 1 + vec_id % 3; explicit centres are the
rows with vec_id < 8. Floating-point results are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import vector as V
from ..functions.rng import streams
from ..operators import assign, compare, linalg, reduce, topk, update
from ..sources import datasets
from ..sources.frames import as_samples, centers_frame, check_samples
from . import lloyd, seeding
from .kmeans import KMeans

K = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WITH = """
    WITH s AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f, CAST(1 + vec_id % 3 AS DOUBLE) AS w FROM embeddings),
    c AS (SELECT CAST(vec_id AS INTEGER) AS cluster_id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings WHERE vec_id < 8),
    l AS (SELECT id, w, unnest(f) AS v, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS pos FROM s),
    p AS (
        SELECT s.id, s.w, s.f, c.cluster_id, list_sum(list_transform(list_zip(s.f, c.f), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d2
        FROM s CROSS JOIN c
    ),
    a AS (SELECT id, w, f, cluster_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, cluster_id) AS r FROM p) WHERE r = 1)
"""


def register(sql: str | None = None, prelude: str = WITH):
    """Adds a query under its function's name, with its SQL where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        name = f.__name__
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = prelude + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_samples(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.lit(1) + F.col("vec_id") % 3)


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < K)
    return rows.select(F.col("vec_id").cast("int").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("center"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.nearest(samples(spark, sf_dir), centers(spark, sf_dir))


def center_array(spark: SparkSession, sf_dir: str) -> np.ndarray:
    return np.array([r["center"] for r in centers(spark, sf_dir).orderBy("cluster_id").collect()])


def explicit_model(spark: SparkSession, sf_dir: str, **parameters) -> KMeans:
    """An estimator whose centres are the explicit ones."""
    model = KMeans(K, id_col="vec_id", features_col="embedding", **parameters)
    model.cluster_centers_ = center_array(spark, sf_dir)
    return model


def r6(column: str | Column) -> Column:
    """Rounded to six places, zero without a sign."""
    return F.round(column, 6) + F.lit(0.0)


def long_values(rows: DataFrame, name: str = "value") -> DataFrame:
    """(id, pos, rounded value) of a table of vectors."""
    return rows.select("id", F.posexplode("features").alias("pos", "v")).select("id", "pos", r6("v").alias(name))


def entries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("row"), F.posexplode("features").alias("col", "value"))


# Reductions


@register("SELECT round(sum(v), 6) + 0.0 AS total FROM l")
def vec_sum_all(spark, sf_dir):
    return reduce.sum_all(samples(spark, sf_dir)).select(r6("total").alias("total"))


@register("SELECT pos, round(sum(v), 6) + 0.0 AS total FROM l GROUP BY pos")
def vec_sum_axis0(spark, sf_dir):
    return reduce.sum_axis0(samples(spark, sf_dir)).select("pos", r6("total").alias("total"))


@register("SELECT id, round(list_sum(f), 6) + 0.0 AS total FROM s")
def vec_sum_axis1(spark, sf_dir):
    return reduce.sum_axis1(samples(spark, sf_dir)).select("id", r6("total").alias("total"))


@register("SELECT pos, round(sum(v * v), 6) + 0.0 AS total FROM l GROUP BY pos")
def vec_fused_sumsq(spark, sf_dir):
    return reduce.sum_axis0(samples(spark, sf_dir), V.square).select("pos", r6("total").alias("total"))


@register("SELECT round(sum(abs(v)), 6) + 0.0 AS total FROM l")
def vec_fused_sum_all(spark, sf_dir):
    return reduce.sum_all(samples(spark, sf_dir), F.abs).select(r6("total").alias("total"))


@register("SELECT id, round(list_sum(list_transform(f, lambda x: x * x)), 6) + 0.0 AS total FROM s")
def vec_fused_axis1(spark, sf_dir):
    return reduce.sum_axis1(samples(spark, sf_dir), V.square).select("id", r6("total").alias("total"))


@register("SELECT 0.0::DOUBLE + coalesce(sum(v), 0) AS total FROM l WHERE id < 0")
def vec_sum_empty(spark, sf_dir):
    return reduce.sum_all(samples(spark, sf_dir).where("id < 0"))


@register("SELECT pos, round(sum(v * v) / 2, 6) + 0.0 AS half_norm FROM l GROUP BY pos")
def vec_half_norm(spark, sf_dir):
    return reduce.half_norms_axis0(samples(spark, sf_dir)).select("pos", r6("half_norm").alias("half_norm"))


@register("SELECT id, round(list_sum(list_transform(f, lambda x: x * x)) / 2, 6) + 0.0 AS half_norm FROM s")
def vec_half_norm_rows(spark, sf_dir):
    return samples(spark, sf_dir).select("id", r6(V.half_norm(F.col("features"))).alias("half_norm"))


@register("SELECT pos, round(avg(v), 6) + 0.0 AS mean FROM l GROUP BY pos")
def feature_mean(spark, sf_dir):
    return reduce.column_means(samples(spark, sf_dir)).select("pos", r6("mean").alias("mean"))


@register("SELECT arg_min(id, (d2, id)) AS argmin FROM (SELECT id, list_sum(list_transform(list_zip(s.f, c.f), lambda t: (t[1] - t[2] - 50) * (t[1] - t[2] - 50))) AS d2 FROM s JOIN c ON cluster_id = 1)")
def argmin_potential(spark, sf_dir):
    first = far_centers(spark, sf_dir).where("cluster_id = 1")
    rows = assign.nearest(samples(spark, sf_dir), first)
    return reduce.argmin(rows, "d2", "id")


@register("SELECT id, CAST(floor((v + 1) / 0.125) AS BIGINT) AS bucket, count(*) AS n FROM l GROUP BY ALL")
def digit_histogram(spark, sf_dir):
    return reduce.digit_histogram(samples(spark, sf_dir), 16, -1.0, 1.0)


# Element-wise


@register("SELECT id, pos, round(v * v + 1, 6) + 0.0 AS value FROM l")
def vec_elementwise(spark, sf_dir):
    return long_values(samples(spark, sf_dir).withColumn("features", V.elementwise(F.col("features"), lambda v: v * v + 1)))


@register("SELECT id, pos, 0.0::DOUBLE AS value FROM l")
def vec_zeros(spark, sf_dir):
    return long_values(samples(spark, sf_dir).withColumn("features", V.zeros(64)))


@register("SELECT id, pos, round(v / total, 6) + 0.0 AS value FROM l JOIN (SELECT pos, sum(abs(v)) AS total FROM l GROUP BY pos) USING (pos)")
def vec_scale_div(spark, sf_dir):
    rows = samples(spark, sf_dir)
    return long_values(reduce.divided_by_columns(rows, reduce.as_vector(reduce.sum_axis0(rows, F.abs), "total")))


@register("SELECT id, pos, round(v - list_avg(f), 6) + 0.0 AS value FROM l JOIN s USING (id)")
def vec_row_minus(spark, sf_dir):
    mean = V.total(F.col("features")) / F.size("features")
    rows = samples(spark, sf_dir).withColumn("m", mean)
    return long_values(rows.withColumn("features", V.with_scalar(F.col("features"), F.col("m"), V.minus)))


@register("SELECT id, pos, round(v + w, 6) + 0.0 AS value FROM l")
def vec_row_plus(spark, sf_dir):
    return long_values(samples(spark, sf_dir).withColumn("features", V.with_scalar(F.col("features"), F.col("weight"), V.plus)))


@register("SELECT id, pos, round(v / 4.0, 6) + 0.0 AS value FROM l")
def vec_divide_by(spark, sf_dir):
    return long_values(samples(spark, sf_dir).withColumn("features", V.elementwise(F.col("features"), V.divide_by(4))))


@register("SELECT id, pos, round(v - mean, 6) + 0.0 AS value FROM l JOIN (SELECT pos, avg(v) AS mean FROM l GROUP BY pos) USING (pos)")
def vec_center(spark, sf_dir):
    return long_values(reduce.centered(samples(spark, sf_dir)))


@register("SELECT id, pos, round((v - low) / (high - low), 6) + 0.0 AS value FROM l JOIN (SELECT pos, min(v) AS low, max(v) AS high FROM l GROUP BY pos) USING (pos)")
def vec_minmax(spark, sf_dir):
    return long_values(datasets.min_max_scaled(samples(spark, sf_dir)))


@register("SELECT id, round(sqrt(list_sum(list_transform(f, lambda x: x * x))), 6) + 0.0 AS norm FROM s")
def vec_sqrt_norm(spark, sf_dir):
    return samples(spark, sf_dir).select("id", r6(F.sqrt(V.total(F.col("features"), V.square))).alias("norm"))


@register("SELECT id, pos, round(v, 6) + 0.0 AS value FROM l WHERE id IN (3, 7, 11)")
def vec_gather(spark, sf_dir):
    return long_values(linalg.gather(samples(spark, sf_dir), [11, 3, 7]))


# Top-k


@register("SELECT l_extendedprice AS value FROM lineitem ORDER BY value DESC LIMIT 10", prelude="")
def topk_global(spark, sf_dir):
    return topk.topk(table(spark, sf_dir, "lineitem"), "l_extendedprice", 10)


@register("SELECT event_id AS index, value FROM events ORDER BY value DESC, event_id LIMIT 10", prelude="")
def topk_idx_global(spark, sf_dir):
    return topk.topk_idx(table(spark, sf_dir, "events"), "value", "event_id", 10)


@register("SELECT id, r, round(v, 6) + 0.0 AS value FROM (SELECT id, v, CAST(row_number() OVER (PARTITION BY id ORDER BY v DESC) - 1 AS INTEGER) AS r FROM l) WHERE r < 5")
def topk_row(spark, sf_dir):
    return topk.topk_rows(samples(spark, sf_dir), 5).select("id", F.posexplode("values").alias("r", "v")).select("id", "r", r6("v").alias("value"))


@register("SELECT id, r, pos FROM (SELECT id, pos, CAST(row_number() OVER (PARTITION BY id ORDER BY v DESC, pos) - 1 AS INTEGER) AS r FROM l) WHERE r < 5")
def topk_idx_row(spark, sf_dir):
    return topk.topk_idx_rows(samples(spark, sf_dir), 5).select("id", F.posexplode("indexes").alias("r", "pos"))


@register(
    """
    WITH t AS (SELECT l_quantity AS v FROM lineitem ORDER BY v DESC LIMIT 100), k AS (SELECT min(v) AS kth FROM t)
    SELECT kth, (SELECT count(*) FROM lineitem WHERE l_quantity = kth) AS n_data, (SELECT count(*) FROM t WHERE v = kth) AS n_topk FROM k
    """,
    prelude="",
)
def kth_value_count(spark, sf_dir):
    return topk.kth_value(table(spark, sf_dir, "lineitem"), "l_quantity", 100)


# Distances and assignment


@register("SELECT id, cluster_id, round(sqrt(d2), 6) + 0.0 AS distance FROM p")
def pairwise_distance(spark, sf_dir):
    return assign.pairwise(samples(spark, sf_dir), centers(spark, sf_dir)).select("id", "cluster_id", r6("distance").alias("distance"))


@register("SELECT cluster_id, count(*) AS n, round(sum(d2), 6) + 0.0 AS inertia FROM a GROUP BY cluster_id")
def nearest_centroid(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy(F.col("label").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("d2")).alias("inertia"))


@register("SELECT id, cluster_id AS label, round(w * d2, 6) + 0.0 AS weighted_d2 FROM a")
def label_lookup(spark, sf_dir):
    return assign.looked_up(labelled(spark, sf_dir), centers(spark, sf_dir)).select("id", "label", r6("weighted_d2").alias("weighted_d2"))


@register("SELECT round(sum(w * d2), 6) + 0.0 AS inertia FROM a")
def inertia(spark, sf_dir):
    return assign.inertia(labelled(spark, sf_dir)).select(r6("inertia").alias("inertia"))


@register("SELECT round(-sum(d2), 6) + 0.0 AS score FROM a")
def score(spark, sf_dir):
    found = explicit_model(spark, sf_dir).score(table(spark, sf_dir, "embeddings"))
    return spark.createDataFrame([(found,)], "score double").select(r6("score").alias("score"))


@register("SELECT id, cluster_id AS label FROM a WHERE id < 8")
def predict_centers(spark, sf_dir):
    """The labels of the centres themselves."""
    own = centers(spark, sf_dir)
    rows = own.select(F.col("cluster_id").cast("long").alias("id"), F.col("center").alias("features"), F.lit(1.0).alias("weight"))
    return assign.nearest(rows, own).select("id", "label")


@register("SELECT id, cluster_id AS label FROM a")
def predict_blocks(spark, sf_dir):
    return explicit_model(spark, sf_dir, backend="arrow").predict(table(spark, sf_dir, "embeddings"))


@register("SELECT id, cluster_id, round(sqrt(d2), 6) + 0.0 AS distance FROM p")
def transform_blocks(spark, sf_dir):
    found = explicit_model(spark, sf_dir).transform(table(spark, sf_dir, "embeddings"))
    return found.select("id", F.posexplode("distances").alias("cluster_id", "d")).select("id", "cluster_id", r6("d").alias("distance"))


#: Scalar columns of lineitem as one vector; the centres are fixed points in their units.
TABULAR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
TABULAR_CENTERS = ((10.0, 10000.0, 0.05, 0.04), (25.0, 30000.0, 0.05, 0.04), (40.0, 60000.0, 0.05, 0.04))


@register(
    """
    WITH c AS (SELECT * FROM (VALUES (0, [10.0, 10000.0, 0.05, 0.04]), (1, [25.0, 30000.0, 0.05, 0.04]), (2, [40.0, 60000.0, 0.05, 0.04])) AS t(cluster_id, c)),
    i AS (SELECT row_number() OVER () AS rid, * FROM lineitem),
    p AS (
        SELECT rid, l_quantity, cluster_id,
               list_sum(list_transform(list_zip([l_quantity, l_extendedprice, l_discount, l_tax], CAST(c AS DOUBLE[])), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d2
        FROM i CROSS JOIN c
    ), a AS (SELECT rid, any_value(l_quantity) AS q, arg_min(cluster_id, (d2, cluster_id)) AS label FROM p GROUP BY rid)
    SELECT label, count(*) AS n, round(sum(q), 4) AS quantity FROM a GROUP BY label
    """,
    prelude="",
)
def tabular_nearest(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    own = as_samples(rows.withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber")), "id", list(TABULAR))
    found = assign.nearest_blocks(own, np.array(TABULAR_CENTERS))
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("features", F.lit(0))), 4).alias("quantity"))


# Matrix products


@register("SELECT s.id AS i, c.cluster_id AS j, round(list_sum(list_transform(list_zip(s.f, c.f), lambda t: t[1] * t[2])), 6) + 0.0 AS value FROM s CROSS JOIN c")
def matmul_rows(spark, sf_dir):
    out = linalg.matmul_rows(samples(spark, sf_dir), center_array(spark, sf_dir))
    return out.select(F.col("id").alias("i"), F.posexplode("values").alias("j", "v")).select("i", "j", r6("v").alias("value"))


WHOLE = "SELECT l.id AS i, y.cluster_id AS j, round({value}, 6) + 0.0 AS value FROM l JOIN (SELECT cluster_id, unnest(f) AS v, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS pos FROM c) y USING (pos) GROUP BY ALL"


def whole_product(spark, sf_dir, **functions) -> DataFrame:
    """All embeddings against the centres through the shuffle join."""
    right = entries(centers(spark, sf_dir).select(F.col("cluster_id").alias("id"), F.col("center").alias("features")))
    return linalg.matmul_long(entries(samples(spark, sf_dir)), right, **functions).select("i", "j", r6("value").alias("value"))


@register(WHOLE.format(value="sum(l.v * y.v)"))
def matmul_small(spark, sf_dir):
    return whole_product(spark, sf_dir)


@register(WHOLE.format(value="sum(abs(l.v - y.v))"))
def matmul_absdiff(spark, sf_dir):
    return whole_product(spark, sf_dir, multiply=lambda a, b: F.abs(a - b))


@register(WHOLE.format(value="1 + exp(sum(l.v * y.v))"))
def matmul_epilogue(spark, sf_dir):
    return whole_product(spark, sf_dir, finish=lambda v: F.exp(v) + 1)


# Update step


UPDATE = "SELECT cluster_id, pos, round(sum({w} * v) / sum({w}), 6) + 0.0 AS value FROM a JOIN (SELECT id, v, pos FROM l) USING (id) GROUP BY cluster_id, pos"


@register(UPDATE.format(w="1"))
def cluster_update(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return update.weighted_means(rows).select("cluster_id", "pos", r6("value").alias("value"))


@register(UPDATE.format(w="w"))
def weighted_cluster_update(spark, sf_dir):
    return update.weighted_means(labelled(spark, sf_dir)).select("cluster_id", "pos", r6("value").alias("value"))


@register("SELECT cluster_id, CAST(coalesce(sum(a.w), 0) AS DOUBLE) AS size FROM c LEFT JOIN a USING (cluster_id) GROUP BY cluster_id")
def cluster_sizes(spark, sf_dir):
    return update.sizes(labelled(spark, sf_dir), centers(spark, sf_dir))


def far_centers(spark, sf_dir):
    """The centres, those with odd ids moved where nothing is near."""
    moved = F.when(F.col("cluster_id") % 2 == 1, F.transform("center", lambda v: v + 50)).otherwise(F.col("center"))
    return centers(spark, sf_dir).withColumn("center", moved)


@register("SELECT cluster_id FROM c WHERE cluster_id % 2 = 1")
def empty_clusters(spark, sf_dir):
    own = far_centers(spark, sf_dir)
    return update.empty_clusters(assign.nearest(samples(spark, sf_dir), own), own)


STEP = """
    , m{n} AS (SELECT cluster_id, list(v ORDER BY pos) AS f FROM (
        SELECT cluster_id, pos, sum(a{n}.w * l.v) / sum(a{n}.w) AS v FROM {a} AS a{n} JOIN l USING (id) GROUP BY cluster_id, pos) GROUP BY cluster_id)
    , c{n} AS (SELECT cluster_id, coalesce(m{n}.f, o.f) AS f FROM {c} AS o LEFT JOIN m{n} USING (cluster_id))
    , x{n} AS (SELECT id, w, arg_min(cluster_id, (d2, cluster_id)) AS cluster_id, min(d2) AS d2 FROM (
        SELECT s.id, s.w, c{n}.cluster_id, list_sum(list_transform(list_zip(s.f, c{n}.f), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d2 FROM s CROSS JOIN c{n}) GROUP BY id, w)
"""
ONE = STEP.format(n=1, a="a", c="c")
THREE = ONE + STEP.format(n=2, a="x1", c="c1") + STEP.format(n=3, a="x2", c="c2")
FIVE = THREE + STEP.format(n=4, a="x3", c="c3") + STEP.format(n=5, a="x4", c="c4")


def lloyd_steps(spark, sf_dir, steps: int) -> tuple[DataFrame, DataFrame]:
    """Centres after some passes of the estimator, one scan each, and the samples labelled by them."""
    own, rows = center_array(spark, sf_dir), samples(spark, sf_dir)
    for _ in range(steps):
        sizes, sums, _ = lloyd.one_pass(rows, own, None, np.zeros(own.shape[1]))
        own = lloyd.means_of(sizes, sums, own)
    return centers_frame(rows, own), assign.nearest_blocks(rows, own)


@register(ONE + "SELECT round(sum(list_sum(list_transform(list_zip(c.f, c1.f), lambda t: (t[1] - t[2]) * (t[1] - t[2])))), 6) + 0.0 AS shift FROM c JOIN c1 USING (cluster_id)")
def centroid_shift(spark, sf_dir):
    own = centers(spark, sf_dir)
    return update.shift(own, update.updated(labelled(spark, sf_dir), own)).select(r6("shift").alias("shift"))


@register("SELECT round(1e-4 * sum((v - mean) * (v - mean)) / count(*), 12) AS tol_scaled FROM l JOIN (SELECT pos, avg(v) AS mean FROM l GROUP BY pos) USING (pos)")
def tol_scaled(spark, sf_dir):
    return reduce.scaled_tolerance(samples(spark, sf_dir), 1e-4).select(F.round("tol_scaled", 12).alias("tol_scaled"))


@register("SELECT min(w) = max(w) AS uniform FROM s")
def uniform_weight(spark, sf_dir):
    return reduce.uniform_weights(samples(spark, sf_dir))


@register(ONE + "SELECT cluster_id, pos, round(v, 6) + 0.0 AS value FROM (SELECT cluster_id, unnest(f) AS v, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS pos FROM c1)")
def lloyd_1(spark, sf_dir):
    own, _ = lloyd_steps(spark, sf_dir, 1)
    return own.select("cluster_id", F.posexplode("center").alias("pos", "v")).select("cluster_id", "pos", r6("v").alias("value"))


@register(THREE + "SELECT cluster_id, count(*) AS n, round(sum(w * d2), 6) + 0.0 AS inertia FROM x3 GROUP BY cluster_id")
def lloyd_3(spark, sf_dir):
    _, rows = lloyd_steps(spark, sf_dir, 3)
    return rows.groupBy(F.col("label").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("weight") * F.col("d2"))).alias("inertia"))


@register(THREE + "SELECT cluster_id, pos, round(v, 6) + 0.0 AS value FROM (SELECT cluster_id, unnest(f) AS v, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS pos FROM c3)")
def lloyd_loop_3(spark, sf_dir):
    """The estimator's own loop from explicit centres, three iterations."""
    model = KMeans(K, init=center_array(spark, sf_dir), max_iter=3, tol=0, id_col="vec_id", features_col="embedding")
    model.fit(table(spark, sf_dir, "embeddings"), F.lit(1) + F.col("vec_id") % 3)
    rows = [(i, p, float(v)) for i, c in enumerate(model.cluster_centers_) for p, v in enumerate(c)]
    return spark.createDataFrame(rows, "cluster_id int, pos int, v double").select("cluster_id", "pos", r6("v").alias("value"))


# Label sets


@register("SELECT count(DISTINCT label) AS n_labels FROM embeddings", prelude="")
def distinct_labels(spark, sf_dir):
    return compare.distinct_labels(table(spark, sf_dir, "embeddings"))


@register(
    """
    SELECT (SELECT bool_and(one) FROM (SELECT min(a.cluster_id) = max(a.cluster_id) AS one FROM a JOIN embeddings e ON e.vec_id = a.id GROUP BY e.label)) AS same
    """
)
def same_clustering(spark, sf_dir):
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return compare.same_clustering(known, labelled(spark, sf_dir).select("id", "label"))


@register("SELECT true AS same", prelude="")
def same_clustering_renamed(spark, sf_dir):
    own = labelled(spark, sf_dir).select("id", "label")
    return compare.same_clustering(own, own.withColumn("label", (F.col("label") * 5 + 3) % K), bijective=True)


# k-means++ steps


@register(
    """
    , pot AS (SELECT id, w * d2 AS pot FROM p WHERE cluster_id = 0)
    SELECT p.cluster_id AS candidate, round(sum(least(p.w * p.d2, pot.pot)), 6) + 0.0 AS potential
    FROM p JOIN pot USING (id) WHERE p.cluster_id BETWEEN 1 AND 4 GROUP BY p.cluster_id
    """
)
def kmpp_candidate_step(spark, sf_dir):
    """Total potentials that the seeding's step compares: the first centre is adopted, four others are tried."""
    own = center_array(spark, sf_dir)
    state = seeding.Potentials(samples(spark, sf_dir))
    try:
        state.add(own[0])
        found = state.totals_with(own[1:5]).sum(axis=0)
    finally:
        state.close()
    rows = [(i, float(v)) for i, v in enumerate(found, 1)]
    return spark.createDataFrame(rows, "candidate int, potential double").select("candidate", r6("potential").alias("potential"))


@register(
    """
    , pot AS (SELECT id, w * d2 AS pot FROM p WHERE cluster_id = 0), run AS (SELECT id, sum(pot) OVER (ORDER BY id) AS total FROM pot)
    SELECT u, min(run.id) AS id FROM (SELECT unnest([0.1, 0.37, 0.5, 0.93]) AS u) JOIN run ON run.total >= u * (SELECT sum(pot) FROM pot) GROUP BY u
    """
)
def kmpp_prefix_pick(spark, sf_dir):
    """For fixed draws, the sample at which the running potential reaches the target, by two-level prefix sums."""
    state = seeding.Potentials(samples(spark, sf_dir))
    try:
        state.add(state.row_at(0)[1])
        totals = state.totals()
        draws = (0.1, 0.37, 0.5, 0.93)
        found = state.pick(totals, [u * totals.sum() for u in draws])
        return spark.createDataFrame([(u, int(i)) for u, (i, _) in zip(draws, found, strict=True)], "u double, id long")
    finally:
        state.close()


@register("SELECT id, cluster_id AS label, round(d2, 6) + 0.0 AS d2 FROM a ORDER BY a.d2 DESC, id LIMIT 5")
def relocate_farthest(spark, sf_dir):
    """The samples that the estimator would move to empty clusters."""
    own = center_array(spark, sf_dir)
    found = lloyd.farthest_samples(samples(spark, sf_dir), own, own, 5, np.zeros(own.shape[1]))
    rows = [(r["id"], r["label"], -r["order"]) for r in found]
    return spark.createDataFrame(rows, "id long, label int, d2 double").select("id", "label", r6("d2").alias("d2"))


@register("SELECT count(*) AS n, CAST(min(len(f)) AS INTEGER) AS d, sum(w) AS weight FROM s")
def validated_input(spark, sf_dir):
    shape = check_samples(samples(spark, sf_dir))
    return samples(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).select("n", F.lit(shape.d).alias("d"), "weight")


# Fits and random numbers


def _embeddings_fit(spark, sf_dir, init, **parameters) -> DataFrame:
    model = KMeans(K, init=init, n_init=1, random_state=42, id_col="vec_id", features_col="embedding", **{"max_iter": 20} | parameters)
    labels = model.fit(table(spark, sf_dir, "embeddings"), F.lit(1) + F.col("vec_id") % 3).labels_
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register(FIVE + "SELECT cluster_id AS label, count(*) AS n FROM x5 GROUP BY cluster_id")
def kmeans_fit(spark, sf_dir):
    """Labels after five iterations from the first K samples, which a callable picks."""
    return _embeddings_fit(spark, sf_dir, lambda rows, k, random_state: np.array([r["features"] for r in rows.orderBy("id").limit(k).collect()]), max_iter=5, tol=0)


@register()
def kmeans_plusplus_fit(spark, sf_dir):
    return _embeddings_fit(spark, sf_dir, "k-means++")


@register()
def random_init_fit(spark, sf_dir):
    return _embeddings_fit(spark, sf_dir, "random")


@register()
def benchmark_resample(spark, sf_dir):
    rows = datasets.random_weights(datasets.min_max_scaled(datasets.resample(samples(spark, sf_dir), 1200, seed=5)), seed=6)
    return rows.select("id", r6("weight").alias("weight"), r6(V.total(F.col("features"))).alias("total"))


@register("SELECT * FROM (VALUES (0, '16756476715040848931'), (1, '6098722386207918385')) AS t(draw, raw)", prelude="")
def rng_raw(spark, sf_dir):
    stream = streams(1, 42)[0]
    return spark.createDataFrame([(i, str(stream.raw())) for i in range(2)], "draw int, raw string")


@register("SELECT * FROM (VALUES (0, '16756476715040848931'), (1, '16052925335932940643')) AS t(stream, raw)", prelude="")
def rng_jumped(spark, sf_dir):
    """The first numbers of two streams, the second one jump ahead."""
    return spark.createDataFrame([(i, str(s.raw())) for i, s in enumerate(streams(2, 42))], "stream int, raw string")


@register("SELECT bits, draw, value FROM (VALUES (24), (53)) AS b(bits) CROSS JOIN (VALUES (0, 0.90837::DOUBLE), (1, 0.33061::DOUBLE), (2, 0.95094::DOUBLE)) AS t(draw, value)", prelude="")
def rng_uniform(spark, sf_dir):
    rows = [(bits, i, round(s.uniform(bits), 5)) for bits in (24, 53) for s in streams(1, 42) for i in range(3)]
    return spark.createDataFrame(rows, "bits int, draw int, value double")
