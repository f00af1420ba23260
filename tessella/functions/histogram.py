"""Histogram distributions: shared :class:`Bins`, one masses array per row.

``p`` below is a probabilities column (see :func:`probabilities`): put it in
its own column first, since several functions read it more than once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from tessella.functions import kernels
from tessella.functions.arrays import (
    INFINITY, as_column, at, clip, dot, int_vector, let, prefix_total, ratio, scored, total, vector,
)
from tessella.functions.grids import Bins, Grid, constant_bins


def invalid_masses(masses: Column | str, bins: Bins) -> Column:
    """True for a row whose masses do not fit the buckets or are negative, NaN or infinite."""
    m = as_column(masses)
    bad = F.exists(m, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == F.lit(INFINITY)))
    return (F.size(m) != F.lit(bins.n)) | bad


def probabilities(masses: Column | str, bins: Bins) -> Column:
    """Masses over their sum; an empty row is uniform over the buckets of positive width."""
    wide = (bins.widths > 0).astype(float)
    if not wide.any():
        wide = np.ones(bins.n)
    return let(as_column(masses), lambda m: let(total(m), lambda t: (
        F.when(t > 0, F.transform(m, lambda x: x / t)).when(t.isNotNull(), vector(wide / wide.sum()))
    )))


def _inverse_widths(bins: Bins) -> np.ndarray:
    return np.divide(1.0, bins.widths, out=np.zeros(bins.n), where=bins.widths > 0)


def pdf_at(p: Column | str, bins: Bins, x: Column) -> Column:
    """Density at a column value: zero outside and in zero-width buckets."""
    p, k = as_column(p), bins.closed_bucket(x)
    inside = (k >= 0) & (k < bins.n)
    safe = clip(k, 0, bins.n - 1)
    return F.when(inside, at(p, safe) * at(vector(_inverse_widths(bins)), safe)).otherwise(F.lit(0.0))


def pdf_values(p: Column | str, bins: Bins, values) -> Column:
    """Densities at shared values; their buckets are known before the job starts."""
    v = np.asarray(values, dtype=float)
    k = np.searchsorted(bins.array, v, side="right") - 1
    last = np.searchsorted(bins.array, bins.array[-1], side="left") - 1
    k = np.where(v == bins.array[-1], last, k)
    inside = (k >= 0) & (k < bins.n)
    k = np.clip(k, 0, bins.n - 1)
    scale = np.where(inside, _inverse_widths(bins)[k], 0.0)
    return let(as_column(p), lambda q: F.zip_with(int_vector(k), vector(scale), lambda i, s: at(q, i) * s))


def _fraction_below(bins: Bins, k: Column, x: Column) -> Column:
    width = at(vector(bins.widths), k)
    return F.when(width > 0, clip(ratio(x - at(vector(bins.array), k), width), 0.0, 1.0)).otherwise(F.lit(1.0))


def cdf_at(p: Column | str, bins: Bins, x: Column) -> Column:
    """The CDF at a column value; with the row's truth this is its PIT."""
    p = as_column(p)
    inner = let(bins.locate(x), lambda k: (
        prefix_total(p, k) + at(p, k) * _fraction_below(bins, k, x)
    ))
    return (
        F.when(~scored(p, bins.n, x), F.lit(None).cast("double"))
        .when(x < F.lit(bins.edges[0]), F.lit(0.0))
        .when(x >= F.lit(bins.edges[-1]), F.lit(1.0))
        .otherwise(clip(inner, 0.0, 1.0))
    )


def cdf_values(p: Column | str, bins: Bins, values) -> Column:
    """The CDF at shared values, as an array."""
    v = np.asarray(values, dtype=float)
    k = np.clip(np.searchsorted(bins.array, v, side="right") - 1, 0, bins.n - 1)
    w = bins.widths[k]
    share = np.divide(v - bins.array[k], w, out=np.ones_like(v), where=w > 0).clip(0.0, 1.0)
    low, high = v < bins.array[0], v >= bins.array[-1]
    # The outside values become weights: 0 * inner + 0 below, 0 * inner + 1 above.
    keep = np.where(low | high, 0.0, 1.0)
    base = np.where(high, 1.0, 0.0)
    q = as_column(p)
    return kernels.cdf_points(q, bins.n, k, share, keep, base)


def ppf(p: Column | str, bins: Bins, levels) -> Column:
    """Quantiles at shared levels, as an array; levels 0 and 1 are the ends of the support."""
    levels = np.atleast_1d(np.asarray(levels, dtype=float))
    if levels.ndim != 1 or (levels < 0).any() or (levels > 1).any():
        raise ValueError("levels must lie within [0, 1]")
    return kernels.inverse_cdf(as_column(p), bins.array, levels)


def ppf_jvm(p: Column | str, bins: Bins, levels: Column) -> Column:
    """:func:`ppf` at an array column of levels, without a Python worker."""
    edges, widths = vector(bins.array), vector(bins.widths)
    begin = F.struct(F.lit(0.0).alias("below"), F.lit(0).alias("k"), F.lit(True).alias("go"))

    def one(q: Column, first: Column, last: Column, level: Column) -> Column:
        # Walk to the first bucket whose running sum reaches the level.
        walk = F.aggregate(q, begin, lambda s, x: F.when(
            s["go"] & (s["k"] < last) & (s["below"] + x < level),
            F.struct((s["below"] + x).alias("below"), (s["k"] + 1).alias("k"), F.lit(True).alias("go")),
        ).otherwise(F.struct(s["below"].alias("below"), s["k"].alias("k"), F.lit(False).alias("go"))))
        return let(walk, lambda s: let(at(q, s["k"]), lambda m: (
            F.when(level <= 0, at(edges, first))
            .when(level >= 1, at(edges, last + 1))
            .otherwise(at(edges, s["k"]) + at(widths, s["k"]) * clip(ratio(
                level - F.when(s["k"] == last, F.lit(1.0) - m).otherwise(s["below"]), m), 0.0, 1.0))
        )))

    return let(as_column(p), lambda q: let(F.transform(q, lambda x: x > 0), lambda held: let(
        F.array_position(held, F.lit(True)).cast("int") - 1, lambda first: let(
            F.lit(bins.n) - F.array_position(F.reverse(held), F.lit(True)).cast("int"), lambda last: (
                F.transform(levels, lambda level: one(q, first, last, level)))))))


def ppf_at(p: Column | str, bins: Bins, level: Column) -> Column:
    """The quantile at a row's own level (inverse-transform draws)."""
    return F.element_at(ppf_jvm(p, bins, F.array(level)), 1)


def median(p: Column | str, bins: Bins) -> Column:
    return F.element_at(ppf(p, bins, [0.5]), 1)


def interval(p: Column | str, bins: Bins, confidence: float) -> Column:
    """The central interval as ``struct<lo, hi>``."""
    if not 0.0 < confidence < 1.0:
        raise ValueError("confidence must lie in (0, 1)")
    tail = 0.5 * (1.0 - confidence)
    ends = ppf(p, bins, [tail, 1.0 - tail])
    return F.struct(F.element_at(ends, 1).alias("lo"), F.element_at(ends, 2).alias("hi"))


def mean(p: Column | str, bins: Bins) -> Column:
    return dot(as_column(p), vector(bins.centers))


def var(p: Column | str, bins: Bins) -> Column:
    """About the mean: a bucket ``d`` away and ``w`` wide adds ``d^2 + w^2 / 12``."""
    centers, spread = vector(bins.centers), vector(bins.widths**2 / 12.0)
    return let(as_column(p), lambda q: let(mean(q, bins), lambda mu: (
        total(F.zip_with(q, centers, lambda x, c: x * (c - mu) * (c - mu))) + dot(q, spread)
    )))


def std(p: Column | str, bins: Bins) -> Column:
    return F.sqrt(F.greatest(var(p, bins), F.lit(0.0)))


def mode(p: Column | str, bins: Bins) -> Column:
    """The center of the densest bucket of positive width; ties take the lowest."""
    density = F.zip_with(as_column(p), vector(bins.widths), lambda x, w: F.when(w > 0, x / w).otherwise(F.lit(-INFINITY)))
    return let(density, lambda d: at(vector(bins.centers), F.array_position(d, F.array_max(d)).cast("int") - 1))


def atoms(p: Column | str, bins: Bins, values) -> Column:
    """Point masses at shared values."""
    zero = bins.widths == 0
    plan = [np.flatnonzero(zero & (bins.array[:-1] == v)).tolist() for v in values]
    q = as_column(p)
    return F.array(*[sum((F.element_at(q, i + 1) for i in hits), F.lit(0.0)) for hits in plan])


def atom_at(p: Column | str, bins: Bins, x: Column) -> Column:
    """The point mass at a column value."""
    q, zero = as_column(p), np.flatnonzero(bins.widths == 0)
    if zero.size == 0:
        return F.lit(0.0)
    hits = F.zip_with(int_vector(zero), vector(bins.array[zero]), lambda i, b: F.when(b == x, at(q, i)).otherwise(F.lit(0.0)))
    return total(hits)


def regrid_parts(p: Column | str, source: Bins, target: Bins) -> Column:
    """Exact mass of each row below, in each of, and above the target buckets.

    A source point mass belongs to the bucket above its edge, except that the
    last target bucket is closed. A row costs one running sum, read at the
    target's edges; nothing is exploded or joined.
    """
    return kernels.regrid_parts(as_column(p), source.array, target.array)


def regrid(p: Column | str, source: Bins, target: Bins, raw: bool = False) -> Column:
    """Exact masses in the target buckets; mass outside is dropped, not renormalized.

    With ``raw`` the rows are masses of any sum: they need no pass of their own.
    """
    if source.edges == target.edges and (target.widths > 0).all():
        return probabilities(p, source) if raw else as_column(p)
    return kernels.regrid_parts(as_column(p), source.array, target.array, raw, inner=True)


def outside(p: Column | str, source: Bins, target: Bins) -> Column:
    """Probability below plus above the target buckets."""
    return let(regrid_parts(p, source, target), lambda parts: (
        F.element_at(parts, 1) + F.element_at(parts, -1)
    ))


def bin_densities(p: Column | str, source: Bins, grid: Grid) -> Column:
    """Mass over width in each grid bin, unnormalized; own edges need no re-binning."""
    return F.zip_with(regrid(p, source, grid), vector(grid.widths), lambda m, w: m / w)


def on_grid(p: Column | str, source: Bins, grid: Grid, raw: bool = False) -> Column:
    """Densities on a grid, normalized by its convention; with ``raw`` of masses of any sum."""
    return kernels.on_grid(as_column(p), source.array, grid, raw)


def softmax(logits: Column | str, temperature: float = 1.0) -> Column:
    """Temperature-scaled softmax of a logits array."""
    scaled = F.transform(as_column(logits), lambda x: x / F.lit(float(temperature)))
    return let(scaled, lambda s: let(F.array_max(s), lambda top: (
        let(F.transform(s, lambda x: F.exp(x - top)), lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))
    )))


def scaled_bins(borders, mean: float, std: float) -> Bins:
    """Standardized borders in target units; refuses a spread too small to tell them apart."""
    edges = np.maximum.accumulate(np.asarray(borders, dtype=float) * std + mean)
    if np.unique(edges).size < np.unique(borders).size:
        raise ValueError("the target's spread is too small against its mean: buckets would merge")
    return Bins(tuple(edges))


def scaled_borders(borders, mean: Column, std: Column) -> Column:
    """The same for groups with their own mean and spread, as a per-row array."""
    return F.transform(vector(np.maximum.accumulate(borders)), lambda b: b * std + mean)


def point_mass(value: float) -> tuple[Column, Bins]:
    """Masses and buckets of a constant target."""
    return vector([0.0, 1.0, 0.0]), constant_bins(value)
