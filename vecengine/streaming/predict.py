"""Labels for a stream of samples; nothing is kept between rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..operators.assign import nearest
from ..sources.frames import as_samples, centers_frame


def predict_stream(spark, rows: DataFrame, centers: np.ndarray, id_col: str, features: str | list[str]) -> DataFrame:
    """(id, label) of a streaming table; the centres are one static row."""
    samples = as_samples(rows, id_col, features)
    return nearest(samples, centers_frame(spark.range(0), centers)).select("id", "label")
