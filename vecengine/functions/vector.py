"""Vector algebra on array<double> columns, as expressions that Catalyst sees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

Unary = Callable[[Column], Column]
Binary = Callable[[Column, Column], Column]


def square(x: Column) -> Column:
    return x * x


def minus(x: Column, y: Column) -> Column:
    return x - y


def plus(x: Column, y: Column) -> Column:
    return x + y


def divide_by(divisor: float) -> Unary:
    """A function that divides by a constant; by zero it gives null."""
    return lambda x: F.try_divide(x, F.lit(float(divisor)))


def elementwise(vector: Column, func: Unary) -> Column:
    """``func`` of every component."""
    return F.transform(vector, func)


def combine(x: Column, y: Column, ops: Binary) -> Column:
    """``ops`` of components at equal places."""
    return F.zip_with(x, y, ops)


def with_scalar(vector: Column, scalar: Column, ops: Binary) -> Column:
    """``ops`` of every component and one scalar of the same row."""
    return F.transform(vector, lambda v: ops(v, scalar))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def total(vector: Column, func: Unary = lambda v: v) -> Column:
    """Sum over components of ``func``; an empty vector sums to 0."""
    return F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + func(v))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def squared_distance(x: Column, y: Column) -> Column:
    """By direct differences, which stay exact where the expanded form cancels."""
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def half_norm(vector: Column) -> Column:
    return total(vector, square) / 2


def literal(values) -> Column:
    """A constant vector; meant for short ones."""
    return F.array(*(F.lit(float(v)) for v in values))
