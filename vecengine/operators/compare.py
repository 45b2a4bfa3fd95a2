"""Comparison of label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def distinct_labels(labelled: DataFrame, label: str = "label") -> DataFrame:
    """One row: the number of labels in use, exact."""
    return labelled.agg(F.count_distinct(label).alias("n_labels"))


def same_clustering(first: DataFrame, second: DataFrame, bijective: bool = False) -> DataFrame:
    """One row, same: whether the second labels are a function of the first ones (and the other way round, if ``bijective``)."""
    both = first.select("id", F.col("label").alias("l1")).join(second.select("id", F.col("label").alias("l2")), "id")

    def function_of(x: str, y: str) -> DataFrame:
        return both.groupBy(x).agg((F.min(y) == F.max(y)).alias("one")).agg(F.coalesce(F.bool_and("one"), F.lit(True)).alias("same"))

    forward = function_of("l1", "l2")
    if not bijective:
        return forward
    return forward.union(function_of("l2", "l1")).agg(F.bool_and("same").alias("same"))
