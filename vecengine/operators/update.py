"""Grouped weighted means and what Lloyd's step needs besides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.vector import squared_distance
from .blocks import dense, numbers


def sizes(labelled: DataFrame, centers: DataFrame) -> DataFrame:
    """(cluster_id, size): total weight of every cluster, 0 where no sample has the label."""
    found = labelled.groupBy(F.col("label").alias("cluster_id")).agg(F.sum("weight").alias("size"))
    return centers.select("cluster_id").join(found, "cluster_id", "left").select("cluster_id", F.coalesce("size", F.lit(0.0)).alias("size"))


def empty_clusters(labelled: DataFrame, centers: DataFrame) -> DataFrame:
    """(cluster_id) of the clusters of size exactly 0."""
    return sizes(labelled, centers).where("size = 0").select("cluster_id")


def weighted_means(labelled: DataFrame) -> DataFrame:
    """(cluster_id, pos, value): sum of w * x over sum of w; a partition adds up in blocks and gives one row per cluster and place."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, w, own = dense(batch), numbers(batch, "weight"), numbers(batch, "label")
            found, place = np.unique(own, return_inverse=True)
            hot = np.zeros((len(found), len(x)))
            hot[place, np.arange(len(x))] = w
            both = np.column_stack([hot @ x, hot.sum(axis=1)])
            for label, row in zip(found.tolist(), both, strict=True):
                sums[label] = sums[label] + row if label in sums else row
        if sums:
            table = np.stack(list(sums.values()))
            d = table.shape[1] - 1
            columns = [np.repeat(np.array(list(sums), np.int32), d), np.tile(np.arange(d, dtype=np.int32), len(table)), table[:, :d].ravel(), np.repeat(table[:, d], d)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["label", "pos", "total", "weight"])

    parts = labelled.select(F.col("label").cast("int").alias("label"), "weight", "features").mapInArrow(run, "label int, pos int, total double, weight double")
    means = parts.groupBy("label", "pos").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("value"))
    return means.select(F.col("label").alias("cluster_id"), "pos", "value")


def updated(labelled: DataFrame, centers: DataFrame) -> DataFrame:
    """(cluster_id, center): new means; a cluster without weight keeps its centre."""
    means = weighted_means(labelled).where("value IS NOT NULL").groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s.value).alias("mean"))
    return centers.join(means, "cluster_id", "left").select("cluster_id", F.coalesce("mean", "center").alias("center"))


def shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: the sum over clusters of the squared distance between old and new centres."""
    both = old.join(new.select("cluster_id", F.col("center").alias("moved")), "cluster_id")
    return both.agg(F.sum(squared_distance(F.col("center"), F.col("moved"))).alias("shift"))
