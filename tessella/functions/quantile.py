"""Quantile distributions: shared levels, one non-decreasing values array per row.

The CDF is piecewise linear through the values, with each tail spread over
one quantile spacing. ``locs`` below must be non-decreasing (:func:`monotone`)
and ``knots`` come from :func:`knots`; give both columns of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, functions as F

from tessella.functions import kernels
from tessella.functions.arrays import INFINITY, as_column, at, clip, let, ratio, total, vector
from tessella.functions.grids import Bins, Grid

# Fixed values.
MODE_TOLERANCE = 1e-9
OUTSIDE_TOLERANCE = 0.01


def check_levels(levels) -> np.ndarray:
    q = np.asarray(levels, dtype=float)
    if q.ndim != 1 or q.size < 2 or (np.diff(q) <= 0).any() or q[0] < 0 or q[-1] > 1:
        raise ValueError("levels must increase strictly inside [0, 1]")
    return q


def even_levels(n: int) -> np.ndarray:
    """``n`` evenly spaced interior levels."""
    return np.linspace(0.0, 1.0, n + 2)[1:-1]


def invalid_locs(locs: Column | str, n_levels: int) -> Column:
    v = as_column(locs)
    return (F.size(v) != n_levels) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(INFINITY)))


def monotone(locs: Column | str) -> Column:
    """The running maximum; rows already in order are passed through."""
    return let(as_column(locs), lambda v: F.when(F.sort_array(v) == v, v).otherwise(
        F.transform(v, lambda _, i: F.array_max(F.slice(v, F.lit(1), i + 1)))))


def tail_widths(locs: Column | str, levels) -> Column:
    """``struct<below, above>``: one spacing, the nearest non-zero one when values tie."""
    q, v = check_levels(levels), as_column(locs)
    gaps = F.filter(F.zip_with(F.slice(v, 2, len(q) - 1), F.slice(v, 1, len(q) - 1), lambda b, a: b - a), lambda g: g > 0)
    return let(gaps, lambda g: F.struct(
        (F.coalesce(F.get(g, F.lit(0)), F.lit(0.0)) * F.lit(float(q[0] > 0))).alias("below"),
        (F.coalesce(F.get(g, F.size(g) - 1), F.lit(0.0)) * F.lit(float(q[-1] < 1))).alias("above"),
    ))


def knot_levels(levels, tails: bool = True) -> np.ndarray:
    q = check_levels(levels)
    if not tails:
        return q
    return np.concatenate([[0.0] if q[0] > 0 else [], q, [1.0] if q[-1] < 1 else []])


def knots(locs: Column | str, levels) -> Column:
    """The CDF's corners, tail ends included."""
    q = check_levels(levels)

    def build(v: Column) -> Column:
        return let(tail_widths(v, q), lambda t: F.concat(
            *([F.array(F.element_at(v, 1) - t["below"])] if q[0] > 0 else []),
            v,
            *([F.array(F.element_at(v, -1) + t["above"])] if q[-1] < 1 else []),
        ))

    return let(as_column(locs), build)


def _between(k: Column, knots_: Column, levels: Column, x: Column, n: int) -> Column:
    """The level at ``x``, which has ``k`` knots before it."""
    return F.when(k <= 0, F.lit(0.0)).when(k >= n, F.lit(1.0)).otherwise(
        let(F.greatest(k, F.lit(1)), lambda j: at(levels, j - 1) + (at(levels, j) - at(levels, j - 1)) * ratio(
            x - at(knots_, j - 1), at(knots_, j) - at(knots_, j - 1))))


def cdf_at(knots_: Column | str, levels, x: Column, tails: bool = True) -> Column:
    """The CDF at a column value (right-continuous where values tie)."""
    l, v = knot_levels(levels, tails), as_column(knots_)
    inner = let(F.size(F.filter(v, lambda t: t <= x)), lambda k: _between(k, v, vector(l), x, len(l)))
    return clip(inner, 0.0, 1.0)


def cdf_values(knots_: Column | str, levels, values) -> Column:
    return let(as_column(knots_), lambda v: F.transform(vector(values), lambda x: cdf_at(v, levels, x)))


def pdf_at(locs: Column | str, levels, x: Column) -> Column:
    """Constant between values; the outermost values belong to their segments, tail ends to the tails."""
    q, v = check_levels(levels), as_column(locs)
    n, steps = len(q), vector(np.diff(q))
    low, high = F.element_at(v, 1), F.element_at(v, -1)
    below_last = F.size(F.filter(v, lambda t: t < high)) - 1
    k = F.when(x == high, below_last).otherwise(F.size(F.filter(v, lambda t: t <= x)) - 1)
    inner = let(k, lambda i: F.when((i >= 0) & (i < n - 1), let(clip(i, 0, n - 2), lambda s: (
        ratio(at(steps, s), at(v, s + 1) - at(v, s))))).otherwise(F.lit(0.0)))
    return let(tail_widths(v, q), lambda t: (
        F.when((t["below"] > 0) & (x >= low - t["below"]) & (x < low), ratio(F.lit(float(q[0])), t["below"]))
        .when((t["above"] > 0) & (x > high) & (x <= high + t["above"]), ratio(F.lit(float(1 - q[-1])), t["above"]))
        .otherwise(inner)
    ))


def ppf(knots_: Column | str, levels, at_levels) -> Column:
    """Quantiles at shared levels; the bracket of each level is known before the job."""
    l, want = knot_levels(levels), np.atleast_1d(np.asarray(at_levels, dtype=float))
    if (want < 0).any() or (want > 1).any():
        raise ValueError("levels must lie within [0, 1]")
    j = np.clip(np.searchsorted(l, want, side="right") - 1, 0, len(l) - 2)
    share = np.clip((want - l[j]) / (l[j + 1] - l[j]), 0.0, 1.0)
    plan = F.arrays_zip(F.lit(j.astype(np.int32)).alias("j"), vector(share).alias("f"))
    return let(as_column(knots_), lambda v: F.transform(plan, lambda t: (
        at(v, t["j"]) + (at(v, t["j"] + 1) - at(v, t["j"])) * t["f"])))


def ppf_at(knots_: Column | str, levels, level: Column) -> Column:
    """The quantile at a row's own level."""
    l, v = knot_levels(levels), as_column(knots_)
    bins = Bins(tuple(l))
    return let(bins.locate(level), lambda j: at(v, j) + (at(v, j + 1) - at(v, j)) * ratio(
        level - at(vector(l), j), at(vector(l), j + 1) - at(vector(l), j)))


def _segments(v: Column, l: np.ndarray) -> Column:
    n = len(l)
    return F.arrays_zip(
        F.slice(v, 1, n - 1).alias("a"), F.slice(v, 2, n - 1).alias("b"), vector(np.diff(l)).alias("s"))


def mean(knots_: Column | str, levels) -> Column:
    l = knot_levels(levels)
    return let(as_column(knots_), lambda v: total(F.transform(
        _segments(v, l), lambda t: t["s"] * 0.5 * (t["a"] + t["b"]))))


def var(knots_: Column | str, levels) -> Column:
    """About the mean: each linear piece adds ``step (l^2 + l h + h^2) / 3``."""
    l = knot_levels(levels)
    return let(as_column(knots_), lambda v: let(mean(v, levels), lambda mu: total(F.transform(
        _segments(v, l), lambda t: t["s"] * (
            (t["a"] - mu) * (t["a"] - mu) + (t["a"] - mu) * (t["b"] - mu) + (t["b"] - mu) * (t["b"] - mu)) / 3.0))))


def std(knots_: Column | str, levels) -> Column:
    return F.sqrt(F.greatest(var(knots_, levels), F.lit(0.0)))


def mode(locs: Column | str, levels) -> Column:
    """The center of the densest segment; a tail wins only when clearly denser."""
    q = check_levels(levels)

    def build(v: Column) -> Column:
        density = F.transform(_segments(v, q), lambda t: F.when(
            t["b"] > t["a"], t["s"] / (t["b"] - t["a"])).otherwise(F.lit(-INFINITY)))
        return let(density, lambda d: let(F.array_max(d), lambda peak: let(
            F.array_position(d, peak).cast("int"), lambda k: let(tail_widths(v, q), lambda t: tails(v, t, peak, k)))))

    def tails(v: Column, t: Column, peak: Column, k: Column) -> Column:
        below = F.when(t["below"] > 0, F.lit(float(q[0])) / t["below"]).otherwise(F.lit(-INFINITY))
        above = F.when(t["above"] > 0, F.lit(float(1 - q[-1])) / t["above"]).otherwise(F.lit(-INFINITY))
        edge = F.lit(1.0 + MODE_TOLERANCE)
        first = below > peak * edge
        best = F.when(first, below).otherwise(peak)
        return (
            F.when(above > best * edge, F.element_at(v, -1) + t["above"] * 0.5)
            .when(first, F.element_at(v, 1) - t["below"] * 0.5)
            .otherwise((F.element_at(v, k) + F.element_at(v, k + 1)) * 0.5)
        )

    return let(as_column(locs), build)


def atom_at(knots_: Column | str, levels, x: Column) -> Column:
    """The point mass at a value: the levels its tied knots jump over."""
    l = knot_levels(levels)
    return let(as_column(knots_), lambda v: total(F.transform(_segments(v, l), lambda t: (
        F.when((t["a"] == t["b"]) & (t["a"] == x), t["s"]).otherwise(F.lit(0.0))))))


def mass_parts(knots_: Column | str, levels, target: Bins, tails: bool = True) -> Column:
    """Exact mass below, in each of, and above the target buckets."""
    l = knot_levels(levels, tails)
    return kernels.knot_masses(as_column(knots_), l, target.array)


def regrid(knots_: Column | str, levels, target: Bins, tails: bool = True) -> Column:
    """Masses in the target buckets; ``tails=False`` leaves outer mass on the outer values."""
    return F.slice(mass_parts(knots_, levels, target, tails), 2, target.n)


def outside(knots_: Column | str, levels, target: Bins) -> Column:
    parts = mass_parts(knots_, levels, target)
    return F.element_at(parts, 1) + F.element_at(parts, -1)


def on_grid_counted(df: DataFrame, knots_: str, levels, grid: Grid, name: str, seen: Observation) -> DataFrame:
    """Adds the row on the grid, and lets ``seen`` count the rows with more than ``OUTSIDE_TOLERANCE`` outside it.

    The mass outside is worked out once, beside the row; ``n_outside`` and ``n`` come
    with the first action on the result.
    """
    parts = df.withColumn("_parts", mass_parts(knots_, levels, grid))
    out = F.element_at("_parts", 1) + F.element_at("_parts", -1)
    counted = parts.observe(seen, F.count_if(out > OUTSIDE_TOLERANCE).alias("n_outside"), F.count("*").alias("n"))
    inner = F.slice("_parts", 2, grid.n)
    return counted.withColumn(name, grid.normalize(F.zip_with(inner, vector(grid.widths), lambda m, w: m / w))).drop("_parts")


def on_grid(knots_: Column | str, levels, grid: Grid, tails: bool = True) -> Column:
    return grid.normalize(F.zip_with(regrid(knots_, levels, grid, tails), vector(grid.widths), lambda m, w: m / w))


def rescale(locs: Column | str, scale: Column, offset: Column) -> Column:
    """Standardized quantiles back in target units."""
    return F.transform(as_column(locs), lambda x: x * scale + offset)
