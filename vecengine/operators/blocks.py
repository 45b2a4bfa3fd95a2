"""Dense blocks of Arrow batches, and sums of per-partition partial results."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

TREE_ABOVE = 128


def dense(batch: pa.RecordBatch, name: str = "features") -> np.ndarray:
    """The vectors of a batch as an (n, d) array, without a copy where Arrow allows it."""
    column = batch.column(batch.schema.get_field_index(name))
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def map_sum(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum over partitions of a vector of ``size`` numbers that ``partial`` makes of each.

    One job; above TREE_ABOVE partitions, partial sums meet in about the square
    root of as many tasks first, so that the driver never adds up more.
    """

    def run(batches):
        total = np.asarray(partial(batches), np.float64).reshape(size)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def meet(batches):
        found = [(p, t.as_py()) for b in batches for p, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
        if found:
            total = np.zeros(size)
            for _, t in sorted(found):
                total = total + np.frombuffer(t, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([found[0][0]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    parts = rows.mapInArrow(run, "part int, total binary")
    n = rows.rdd.getNumPartitions()
    if n > TREE_ABOVE:
        width = math.isqrt(n) + 1
        parts = parts.repartition(width, F.pmod("part", F.lit(width))).mapInArrow(meet, "part int, total binary")
    total = np.zeros(size)
    for row in sorted(parts.collect(), key=lambda r: r["part"]):
        total = total + np.frombuffer(row["total"], np.float64)
    return total
