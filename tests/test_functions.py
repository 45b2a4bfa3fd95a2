import pytest

from vecengine.functions import vector as V
from vecengine.functions.rng import streams
from pyspark.sql import functions as F


def test_raw_numbers_and_jump():
    first, second = streams(2, 42)
    assert [first.raw(), first.raw()] == [16756476715040848931, 6098722386207918385]
    assert second.raw() == 16052925335932940643
    assert streams(1, 42, skip=1)[0].raw() == 16052925335932940643


@pytest.mark.parametrize("bits", [24, 53])
def test_uniform_numbers(bits):
    stream = streams(1, 42)[0]
    assert [stream.uniform(bits) for _ in range(3)] == pytest.approx([0.9083704, 0.33061236, 0.9509354], abs=1e-6)


def test_uniform_fills_bins_evenly():
    stream, bins = streams(1, 7)[0], [0] * 5
    for _ in range(50_000):
        bins[int(stream.uniform() * 5)] += 1
    assert max(abs(b - 10_000) for b in bins) < 500


def test_vector_algebra(spark):
    row = spark.createDataFrame([([1.0, 2.0, 2.0], [0.0, 2.0, 4.0])], "x array<double>, y array<double>").select(
        V.dot(F.col("x"), F.col("y")).alias("dot"),
        V.squared_distance(F.col("x"), F.col("y")).alias("d2"),
        V.half_norm(F.col("x")).alias("half"),
        V.combine(F.col("x"), F.col("y"), V.plus).alias("sum"),
        V.elementwise(F.col("x"), V.divide_by(2)).alias("halved"),
        V.elementwise(F.col("x"), V.divide_by(0)).alias("undefined"),
        V.with_scalar(F.col("x"), F.lit(1.0), V.minus).alias("less"),
        V.zeros(2).alias("zeros"),
        V.total(F.array().cast("array<double>")).alias("empty"),
    ).first()
    assert (row["dot"], row["d2"], row["half"]) == (12.0, 5.0, 4.5)
    assert row["sum"] == [1.0, 4.0, 6.0] and row["halved"] == [0.5, 1.0, 1.0]
    assert row["undefined"] == [None] * 3 and row["less"] == [0.0, 1.0, 1.0]
    assert row["zeros"] == [0.0, 0.0] and row["empty"] == 0.0
