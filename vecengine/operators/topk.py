"""Largest values and where they are: over a column, or in each row of a matrix. Equal values go to the lower index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _check(rows: DataFrame, k: int) -> None:
    if k < 1:
        raise ValueError("k has to be at least 1")
    if rows.limit(k).count() < k:
        raise ValueError(f"k is {k}, beyond the number of values")


def topk(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(value): the k largest. Partial heaps on the executors, k rows from each."""
    _check(rows, k)
    return rows.select(F.col(value).alias("value")).orderBy(F.desc("value")).limit(k)


def topk_idx(rows: DataFrame, value: str, index: str, k: int) -> DataFrame:
    """(index, value) of the k largest."""
    _check(rows, k)
    return rows.select(F.col(index).alias("index"), F.col(value).alias("value")).orderBy(F.desc("value"), "index").limit(k)


def kth_value(rows: DataFrame, value: str, k: int) -> DataFrame:
    """One row: the k-th largest value, how often it occurs, and how often among the k largest."""
    kept = topk(rows, value, k).agg(F.min("value").alias("kth"), F.count(F.lit(1)).alias("k"), F.collect_list("value").alias("kept"))
    counted = rows.join(F.broadcast(kept)).agg(F.first("kth").alias("kth"), F.count(F.when(F.col(value) == F.col("kth"), 1)).alias("n_data"), F.first("kept").alias("kept"))
    return counted.select("kth", "n_data", F.size(F.filter("kept", lambda v: v == F.col("kth"))).cast("long").alias("n_topk"))


def _long_enough(k: int):
    """The vector; one of fewer than k values raises when it is read."""
    if k < 1:
        raise ValueError("k has to be at least 1")
    short = F.raise_error(F.concat(F.lit(f"k is {k}, but a row has "), F.size("features").cast("string"), F.lit(" values")))
    return F.when(F.size("features") >= k, F.col("features")).otherwise(short.cast("array<double>"))


def topk_rows(samples: DataFrame, k: int) -> DataFrame:
    """(id, values): the k largest components of each row, falling; no shuffle."""
    return samples.select("id", F.slice(F.sort_array(_long_enough(k), asc=False), 1, k).alias("values"))


def topk_idx_rows(samples: DataFrame, k: int) -> DataFrame:
    """(id, indexes) of the k largest components of each row; no shuffle."""
    ranked = F.sort_array(F.transform(_long_enough(k), lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))), asc=False)
    return samples.select("id", F.transform(F.slice(ranked, 1, k), lambda s: -s.i).alias("indexes"))
