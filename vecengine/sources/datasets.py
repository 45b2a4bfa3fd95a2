"""Benchmark inputs from a sample table: features dropped, rows resampled, values scaled, weights drawn."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.reduce import column_range


def uniform(seed: int, *key: str | Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def resample(samples: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows with new ids: a random subset, or, beyond the table's size, every row at least once."""
    have = samples.count()
    if not have:
        raise ValueError("there are no samples")
    copies = math.ceil(n / have)
    more = samples.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    rest = n - (copies - 1) * have
    last = more.where(F.col("copy") == copies - 1).orderBy(uniform(seed, "id"), "id").limit(rest)
    rows = more.where(F.col("copy") < copies - 1).unionByName(last)
    return rows.select((F.col("id") * copies + F.col("copy")).alias("id"), "features", "weight")


def keep_features(samples: DataFrame, places: list[int]) -> DataFrame:
    """The vectors cut down to the given places."""
    return samples.withColumn("features", F.array(*(F.get("features", F.lit(p)) for p in places)))


def min_max_scaled(samples: DataFrame) -> DataFrame:
    """Every feature mapped to [0, 1] by its range; a constant feature becomes 0."""
    low, high = column_range(samples)
    spans = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b - a).alias("b")) for a, b in zip(low, high, strict=True)))
    return samples.withColumn("features", F.zip_with("features", spans, lambda v, s: F.when(s.b == 0, F.lit(0.0)).otherwise((v - s.a) / s.b)))


def random_weights(samples: DataFrame, seed: int = 0) -> DataFrame:
    return samples.withColumn("weight", uniform(seed, "id"))
