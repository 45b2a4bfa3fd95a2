"""Nearest centres, distances to them and inertia, by expressions or by dense Arrow blocks.

Centres are K x d numbers, so they travel as a one-row table or in the closure.
Labels by blocks come from a matrix product and half squared norms; reported
distances always come from direct differences. Ties go to the lower cluster id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions.vector import squared_distance
from .blocks import dense, numbers

EXPR_VALUES = 2048


def block_labels(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; the squared norm of the row itself is left out."""
    return np.argmin((centers**2).sum(axis=1) / 2 - x @ centers.T, axis=1)


def block_squares(x: np.ndarray, centers: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return ((x - centers[labels]) ** 2).sum(axis=1)


def packed(centers: DataFrame) -> DataFrame:
    """All centres in one row, in the order of their ids."""
    return centers.agg(F.sort_array(F.collect_list(F.struct("cluster_id", "center"))).alias("centers"))


def beside(samples: DataFrame, centers: DataFrame) -> DataFrame:
    """Every sample beside the one row of centres, whose size is K x d."""
    return samples.join(F.broadcast(packed(centers)))


def nearest(samples: DataFrame, centers: DataFrame) -> DataFrame:
    """Samples with label and d2, by expressions: one row of centres is broadcast, nothing is shuffled."""
    best = F.array_min(F.transform("centers", lambda c: F.struct(squared_distance(F.col("features"), c.center).alias("d2"), c.cluster_id.alias("label"))))
    found = beside(samples, centers).withColumn("best", best)
    return found.select(*samples.columns, F.col("best.label").alias("label"), F.col("best.d2").alias("d2"))


def nearest_blocks(samples: DataFrame, centers: np.ndarray) -> DataFrame:
    """Samples with label and d2, by a matrix product over each batch."""
    centers = np.asarray(centers, np.float64)

    def run(batches):
        for batch in batches:
            x = dense(batch)
            own = block_labels(x, centers)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(block_squares(x, centers, own))], [*batch.schema.names, "label", "d2"])

    return samples.mapInArrow(run, StructType(list(samples.schema.fields)).add("label", "integer").add("d2", "double"))


def pairwise(samples: DataFrame, centers: DataFrame) -> DataFrame:
    """(id, cluster_id, distance) to every centre."""
    each = F.transform("centers", lambda c: F.struct(c.cluster_id.alias("cluster_id"), F.sqrt(squared_distance(F.col("features"), c.center)).alias("distance")))
    return beside(samples, centers).select("id", F.inline(each))


def labels(samples: DataFrame, centers: np.ndarray, backend: str = "auto") -> DataFrame:
    """(id, label) of every sample."""
    centers = np.asarray(centers, np.float64)
    if backend == "expr" or (backend == "auto" and centers.size <= EXPR_VALUES and len(centers) <= 8):
        from ..sources.frames import centers_frame

        return nearest(samples, centers_frame(samples, centers)).select("id", "label")

    def run(batches):
        for batch in batches:
            found = block_labels(dense(batch), centers).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(numbers(batch, "id")), pa.array(found)], ["id", "label"])

    return samples.select("id", "features").mapInArrow(run, "id long, label int")


def distances(samples: DataFrame, centers: np.ndarray) -> DataFrame:
    """(id, distances): Euclidean distances to all centres, in their order."""
    centers = np.asarray(centers, np.float64)

    def run(batches):
        for batch in batches:
            x = dense(batch)
            out = np.sqrt(np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(centers)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(numbers(batch, "id")), flat], ["id", "distances"])

    return samples.select("id", "features").mapInArrow(run, "id long, distances array<double>")


def inertia(labelled: DataFrame) -> DataFrame:
    """One row: the weighted sum of squared distances of ``nearest``."""
    return labelled.agg(F.coalesce(F.sum(F.col("weight") * F.col("d2")), F.lit(0.0)).alias("inertia"))


def looked_up(labelled: DataFrame, centers: DataFrame) -> DataFrame:
    """(id, label, weighted_d2) for samples with a label of their own: an equi-join on the label, d2 by direct differences."""
    own = centers.select(F.col("cluster_id").alias("label"), "center")
    return labelled.join(F.broadcast(own), "label").select("id", "label", (F.col("weight") * squared_distance(F.col("features"), F.col("center"))).alias("weighted_d2"))
