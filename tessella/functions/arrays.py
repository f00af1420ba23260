"""Small building blocks for array columns.

A value that a lambda refers to is evaluated again for every element, and an
earlier ``withColumn`` does not help when it is used once, because the
optimizer inlines it. :func:`let` binds it once per row; every builder in
this package goes through it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, functions as F

INFINITY = float("inf")


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def vector(values) -> Column:
    """A shared array<double>: one literal in the plan, whatever its length."""
    return F.lit(np.asarray(values, dtype=np.float64))


def int_vector(values) -> Column:
    return F.lit(np.asarray(values, dtype=np.int32))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(array: Column) -> Column:
    """The sum of an array, in order, so a row's sum never depends on its partition."""
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def dot(array: Column, weights: Column) -> Column:
    return total(F.zip_with(array, weights, lambda a, w: a * w))


def prefix_total(array: Column, count: Column) -> Column:
    """The sum of the first ``count`` elements."""
    return total(F.slice(array, F.lit(1), count))


def at(array: Column, index: Column) -> Column:
    """Zero-based element."""
    return F.element_at(array, (index + 1).cast("int"))


def clip(value: Column, low, high) -> Column:
    """``value`` cut to [low, high]."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(value, low), high)


def is_finite(value: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(INFINITY))


def scored(array: Column, size: int, truth: Column) -> Column:
    """Whether a row can be scored: its array has the size, its truth is a finite number. Never NULL."""
    return array.isNotNull() & (F.size(array) == F.lit(size)) & is_finite(truth)


def ratio(top: Column, bottom: Column, otherwise=0.0) -> Column:
    """``top / bottom`` where ``bottom`` > 0, else ``otherwise``; never divides by zero."""
    return F.coalesce(F.try_divide(top, F.when(bottom > 0, bottom)), F.lit(otherwise))


def positions(array: Column) -> Column:
    """0 .. size-1 as an array."""
    return F.transform(array, lambda _, i: i)


def weighted_sum(arrays: list[Column], weights) -> Column:
    """Elementwise ``sum(weight * array)`` of a few arrays of one row."""
    scaled = [_scaled(a, float(w)) for a, w in zip(arrays, weights)]
    return reduce(lambda left, right: F.zip_with(left, right, lambda s, x: s + x), scaled)


def _scaled(array: Column, weight: float) -> Column:
    return F.transform(array, lambda x: x * F.lit(weight))


def fold_arrays(collected: Column, size: int) -> Column:
    """Elementwise sum of a collected array of arrays (one per member of a row)."""
    zero = vector(np.zeros(size))
    return F.aggregate(collected, zero, lambda s, a: F.zip_with(s, a, lambda x, y: x + y))
