"""Reductions of matrices whose rows are vectors: along columns, along rows, or over all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.vector import Unary, square, total
from .blocks import dense

SAME: Unary = lambda v: v


def long_form(samples: DataFrame) -> DataFrame:
    """(id, pos, value) of every component."""
    return samples.select("id", F.posexplode("features").alias("pos", "value"))


def column_partials(samples: DataFrame, func: Unary = SAME) -> DataFrame:
    """(pos, n, total, low, high) of ``func`` of each column, one row a column and partition: vectors of one length are added up in blocks, before any shuffle."""

    def run(batches):
        found = None
        for batch in batches:
            if len(batch):
                x = dense(batch)
                own = np.stack([np.full(x.shape[1], float(len(x))), x.sum(axis=0), x.min(axis=0), x.max(axis=0)])
                found = own if found is None else np.stack([found[0] + own[0], found[1] + own[1], np.minimum(found[2], own[2]), np.maximum(found[3], own[3])])
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(found.shape[1], dtype=np.int32)), *(pa.array(r) for r in found)], ["pos", "n", "total", "low", "high"])

    return samples.select(F.transform("features", func).alias("features")).mapInArrow(run, "pos int, n double, total double, low double, high double")


def sum_all(samples: DataFrame, func: Unary = SAME) -> DataFrame:
    """One row: the sum of ``func`` over all components, 0 for an empty matrix."""
    return samples.agg(F.coalesce(F.sum(total(F.col("features"), func)), F.lit(0.0)).alias("total"))


def sum_axis0(samples: DataFrame, func: Unary = SAME) -> DataFrame:
    """(pos, total): sums of columns."""
    return column_partials(samples, func).groupBy("pos").agg(F.sum("total").alias("total"))


def sum_axis1(samples: DataFrame, func: Unary = SAME) -> DataFrame:
    """(id, total): sums of rows, without a shuffle."""
    return samples.select("id", total(F.col("features"), func).alias("total"))


def half_norms_axis0(samples: DataFrame) -> DataFrame:
    """(pos, half_norm): half the squared norm of each column."""
    return sum_axis0(samples, square).select("pos", (F.col("total") / 2).alias("half_norm"))


def argmin(rows: DataFrame, value: str, index: str) -> DataFrame:
    """One row: the index of the least value, the lowest one among equals."""
    return rows.agg(F.min_by(index, F.struct(value, index)).alias("argmin"))


def column_means(samples: DataFrame) -> DataFrame:
    """(pos, mean), unweighted."""
    return column_partials(samples).groupBy("pos").agg((F.sum("total") / F.sum("n")).alias("mean"))


def column_range(samples: DataFrame) -> tuple[list[float], list[float]]:
    """Least and greatest value of each column; d numbers each."""
    rows = column_partials(samples).groupBy("pos").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("pos").collect()
    return [r["low"] for r in rows], [r["high"] for r in rows]


def as_vector(per_column: DataFrame, value: str) -> DataFrame:
    """One row with the values of (pos, value) rows as a vector; d is bounded by the samples' own vectors."""
    return per_column.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col(value).alias("v")))), lambda s: s.v).alias("vector"))


def with_vector(samples: DataFrame, vector: DataFrame) -> DataFrame:
    """Every sample beside a one-row vector; the vector has one row by construction, so it is broadcast."""
    return samples.join(F.broadcast(vector.limit(1)))


def centered(samples: DataFrame) -> DataFrame:
    """Samples less their column means."""
    means = as_vector(column_means(samples), "mean")
    return with_vector(samples, means).select("id", F.zip_with("features", "vector", lambda v, m: v - m).alias("features"), "weight")


def divided_by_columns(samples: DataFrame, divisors: DataFrame) -> DataFrame:
    """M[i, j] / v[j]; a zero divisor gives null."""
    return with_vector(samples, divisors).select("id", F.zip_with("features", "vector", lambda v, d: F.try_divide(v, d)).alias("features"), "weight")


def scaled_tolerance(samples: DataFrame, tol: float) -> DataFrame:
    """One row: ``tol`` times the mean square of the centred samples."""
    squares = centered(samples).select(total(F.col("features"), square).alias("s"), F.size("features").alias("d"))
    return squares.agg((F.sum("s") / F.sum("d") * tol).alias("tol_scaled"))


def uniform_weights(samples: DataFrame) -> DataFrame:
    """One row: whether all weights are equal."""
    return samples.agg((F.min("weight") == F.max("weight")).alias("uniform"))


def digit_histogram(samples: DataFrame, buckets: int, low: float, high: float) -> DataFrame:
    """(id, bucket, n): how many components of each row fall in each of equal buckets of [low, high)."""
    width = (high - low) / buckets
    return long_form(samples).groupBy("id", F.floor((F.col("value") - low) / width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
