"""Sample tables: an id, a vector of doubles and a weight for each row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

ALGORITHMS = ("lloyd", "auto", "full")


def weight_column(weight: str | float | Column | None) -> Column:
    """None gives ones, a number that constant, a column (or its name) itself as double."""
    if weight is None:
        return F.lit(1.0)
    if isinstance(weight, (int, float)):
        return F.lit(float(weight))
    return (F.col(weight) if isinstance(weight, str) else weight).cast("double")


def as_samples(rows: DataFrame, id_col: str, features: str | list[str], weight: str | float | Column | None = None) -> DataFrame:
    """(id, features, weight) from a vector column or from scalar columns assembled in order."""
    if isinstance(features, str):
        kind = dict(rows.dtypes)[features]
        if not kind.startswith("array<"):
            raise ValueError(f"{features} is {kind}; a dense array of numbers is needed")
        vector = F.col(features).cast("array<double>")
    else:
        vector = F.array(*(F.col(c).cast("double") for c in features))
    return rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("features"), weight_column(weight).alias("weight"))


@dataclass(frozen=True)
class Shape:
    n: int
    d: int


def check_samples(samples: DataFrame) -> Shape:
    """Rows and vector length; ValueError for no rows, unequal lengths, nulls or non-finite numbers."""
    finite = F.forall("features", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    good = F.col("id").isNotNull() & F.col("features").isNotNull() & F.coalesce(finite, F.lit(False)) & F.col("weight").isNotNull() & (F.abs("weight") < float("inf")) & ~F.isnan("weight")
    size = F.size("features")
    n, low, high, bad = samples.agg(F.count(F.lit(1)), F.min(size), F.max(size), F.count(F.when(~good, 1))).first()
    if not n:
        raise ValueError("there are no samples")
    if bad:
        raise ValueError(f"{bad} samples hold nulls or numbers that are not finite")
    if low != high or not low:
        raise ValueError(f"vectors have {low} to {high} components; all need the same number, at least one")
    return Shape(n, low)


def checked(samples: DataFrame, d: int) -> DataFrame:
    """The samples, lazily; a row with a null, a number that is not finite or not ``d`` components raises when it is read."""
    finite = F.forall("features", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    good = F.col("id").isNotNull() & F.coalesce(finite & (F.size("features") == d), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit(f"a sample without {d} finite components: id "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    heavy = F.coalesce((F.abs("weight") < float("inf")) & ~F.isnan("weight"), F.lit(False))
    weight = F.when(heavy, F.col("weight")).otherwise(F.raise_error(F.lit("a weight that is null or not finite")).cast("double"))
    return samples.select("id", F.when(good, F.col("features")).otherwise(wrong.cast("array<double>")).alias("features"), weight.alias("weight"))


def check_centers(centers, shape: Shape, k: int) -> np.ndarray:
    """Explicit centres as a k x d array of their own."""
    found = np.array(centers, dtype=np.float64)
    if found.ndim != 2 or found.shape != (k, shape.d):
        raise ValueError(f"the initial centres have shape {found.shape}; ({k}, {shape.d}) is needed")
    if not np.isfinite(found).all():
        raise ValueError("the initial centres hold numbers that are not finite")
    return found


def centers_frame(like: DataFrame, centers: np.ndarray) -> DataFrame:
    """(cluster_id, center) of a K x d array."""
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(np.asarray(centers))]
    return like.sparkSession.createDataFrame(rows, "cluster_id int, center array<double>")


def accepts(algorithm: str) -> None:
    """ValueError for algorithms other than Lloyd's."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm {algorithm!r} is not one of {', '.join(ALGORITHMS)}")
