"""Matrix products with any multiplication and any function of the result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vector import Binary, Unary
from .blocks import dense, numbers


def times(x: Column, y: Column) -> Column:
    return x * y


def matmul_long(x: DataFrame, y_t: DataFrame, multiply: Binary = times, finish: Unary = lambda v: v) -> DataFrame:
    """(i, j, value): result[i, j] = finish(sum over k of multiply(X[i, k], Y_t[j, k])).

    Both sides are (row, col, value) tables of any size, joined on the shared index.
    """
    left = x.select(F.col("row").alias("i"), F.col("col").alias("k"), F.col("value").alias("a"))
    right = y_t.select(F.col("row").alias("j"), F.col("col").alias("k"), F.col("value").alias("b"))
    return left.join(right, "k").groupBy("i", "j").agg(finish(F.sum(multiply(F.col("a"), F.col("b")))).alias("value"))


def matmul_rows(samples: DataFrame, y_t: np.ndarray, multiply: str = "product", finish=None) -> DataFrame:
    """(id, values): each row's products with the rows of ``y_t``, a driver-side matrix of the size of a set of centres.

    ``multiply`` is "product" or "squared_diff"; ``finish`` is a function of a numpy array.
    """
    if multiply not in ("product", "squared_diff"):
        raise ValueError(f"multiply is {multiply!r}, not 'product' or 'squared_diff'")
    y_t = np.ascontiguousarray(y_t, np.float64)

    def run(batches):
        for batch in batches:
            x = dense(batch)
            out = x @ y_t.T if multiply == "product" else np.stack([((x - r) ** 2).sum(axis=1) for r in y_t], axis=1)
            out = finish(out) if finish else out
            yield pa.RecordBatch.from_arrays([pa.array(numbers(batch, "id")), pa.array(list(out), pa.list_(pa.float64()))], ["id", "values"])

    return samples.select("id", "features").mapInArrow(run, "id long, values array<double>")


def gather(samples: DataFrame, ids: list[int]) -> DataFrame:
    """(place, id, features, weight) of the rows asked for, as often as they are; the list is the caller's own, and broadcast."""
    asked = samples.sparkSession.createDataFrame(list(enumerate(map(int, ids))), "place int, id long")
    return samples.join(F.broadcast(asked), "id").select("place", *samples.columns)
