"""Bucket edges shared by all rows, and grids with a normalization convention.

Both are small driver-side values that enter a plan as literals; the work
done with them is on array columns. ``edges`` may repeat in :class:`Bins`
(a zero-width bucket is a point mass) but not in :class:`Grid`.
"""

from __future__ import annotations

import dataclasses
import math
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.functions.arrays import (
    as_column, at, clip, dot, is_finite, let, scored, vector,
)

# Grid conventions.
NORMALIZATIONS = ("trapezoid", "histogram")
DEFAULT_N_BINS = 200
DEFAULT_PADDING = 0.05
QUANTILE_GRID_BINS = 1000
QUANTILE_GRID_PADDING = 0.25


@dataclasses.dataclass(frozen=True)
class Bins:
    """Finite, non-decreasing bucket edges."""

    edges: tuple[float, ...]

    def __post_init__(self) -> None:
        array = np.asarray(self.edges, dtype=np.float64)
        if array.ndim != 1 or array.size < 2 or not np.isfinite(array).all():
            raise ValueError("edges must be at least two finite values in one dimension")
        if (np.diff(array) < 0).any():
            raise ValueError("edges must be non-decreasing")
        object.__setattr__(self, "edges", tuple(array.tolist()))

    @cached_property
    def array(self) -> np.ndarray:
        return np.asarray(self.edges)

    @cached_property
    def widths(self) -> np.ndarray:
        return np.diff(self.array)

    @cached_property
    def centers(self) -> np.ndarray:
        return 0.5 * (self.array[1:] + self.array[:-1])

    @property
    def n(self) -> int:
        return len(self.edges) - 1

    @cached_property
    def uniform(self) -> bool:
        w = self.widths
        return bool(w.min() > 0 and np.allclose(w, w.mean(), rtol=1e-6, atol=0))

    def count_le(self, x: Column) -> Column:
        """How many edges are <= x (a right-sided search)."""
        return self._search(x, lambda e: e <= x)

    def count_lt(self, x: Column) -> Column:
        """How many edges are < x (a left-sided search)."""
        return self._search(x, lambda e: e < x)

    def _search(self, x: Column, before) -> Column:
        edges = vector(self.array)
        if self.uniform and self.n >= 4:
            step = float(self.widths.mean())
            guess = F.floor((clip(x, self.edges[0], self.edges[-1]) - F.lit(self.edges[0])) / F.lit(step))
            guess = clip(guess.cast("int"), 0, self.n - 1)
            # The guess may be off by one through rounding; the real edges decide.
            return let(guess, lambda g: (
                g + before(at(edges, g)).cast("int") + before(at(edges, g + 1)).cast("int")
            ))
        if self.n <= 48:
            return F.size(F.filter(edges, before))
        # Two levels: every s-th edge first, then the block below it.
        s = math.isqrt(self.n + 1)
        coarse = vector(self.array[s - 1::s])
        return let(F.size(F.filter(coarse, before)), lambda c: (
            c * s + F.size(F.filter(F.slice(edges, c * s + 1, F.lit(s)), before))
        ))

    def locate(self, x: Column) -> Column:
        """Zero-based bucket ``edges[i] <= x < edges[i+1]``, clipped to the end buckets."""
        return clip(self.count_le(x) - 1, 0, self.n - 1)

    def closed_bucket(self, x: Column) -> Column:
        """As :meth:`locate` but -1 / n outside; the last edge closes the last wide bucket."""
        last = int(np.searchsorted(self.array, self.array[-1], side="left")) - 1
        return F.when(x == F.lit(self.edges[-1]), F.lit(last)).otherwise(self.count_le(x) - 1)

    def left_open_bucket(self, x: Column) -> Column:
        """Bucket ``edges[i] < x <= edges[i+1]``; -1 / n when off the edges."""
        return self.count_lt(x) - 1

    def table(self, spark: SparkSession) -> DataFrame:
        """The bin dimension ``(bin, lo, hi, center, width)``."""
        edges, n = vector(self.array), self.n
        return spark.range(0, n, 1, 1).select(
            F.col("id").cast("int").alias("bin"),
            at(edges, F.col("id")).alias("lo"),
            at(edges, F.col("id") + 1).alias("hi"),
            (F.lit(0.5) * (at(edges, F.col("id")) + at(edges, F.col("id") + 1))).alias("center"),
            (at(edges, F.col("id") + 1) - at(edges, F.col("id"))).alias("width"),
        )


def union_bins(parts: list[Bins]) -> Bins:
    """The union of several members' edges."""
    edges = np.unique(np.concatenate([p.array for p in parts]))
    if edges.size < 3:
        edges = np.array([edges[0], edges.mean(), edges[-1]])
    return Bins(tuple(edges))


@dataclasses.dataclass(frozen=True)
class Grid(Bins):
    """Strictly increasing edges and how a density on them integrates to one.

    ``trapezoid``: the trapezoid rule over the bin centers. ``histogram``:
    constant density in each bin. Either rule is one dot product with
    :attr:`node_weights`, and either CDF is piecewise linear over
    :attr:`nodes`, so the scores need a single implementation.
    """

    normalization: str = "trapezoid"

    def __post_init__(self) -> None:
        super().__post_init__()
        if len(self.edges) < 3 or not (np.diff(self.edges) > 0).all():
            raise ValueError("grid edges must be at least three strictly increasing values")
        if self.normalization not in NORMALIZATIONS:
            raise ValueError(f"normalization must be one of {NORMALIZATIONS}")

    @classmethod
    def linear(cls, low: float, high: float, n_bins: int, normalization: str = "trapezoid") -> Grid:
        return cls(tuple(np.linspace(low, high, n_bins + 1)), normalization)

    @property
    def histogram(self) -> bool:
        return self.normalization == "histogram"

    @cached_property
    def node_weights(self) -> np.ndarray:
        if self.histogram:
            return self.widths
        gaps = np.diff(self.centers)
        return 0.5 * (np.r_[gaps, 0.0] + np.r_[0.0, gaps])

    @cached_property
    def nodes(self) -> Bins:
        """Where the CDF has its corners: the edges, or the centers under the trapezoid rule."""
        return Bins(self.edges) if self.histogram else Bins(tuple(self.centers))

    def same_edges(self, other: Bins) -> bool:
        return self.edges == other.edges

    # -- column work -------------------------------------------------------

    def clean(self, pdf: Column) -> Column:
        """NaN, infinities and negatives become zero."""
        return F.transform(pdf, lambda x: F.when(is_finite(x), F.greatest(x, F.lit(0.0))).otherwise(F.lit(0.0)))

    def normalize(self, pdf: Column | str) -> Column:
        """Cleaned and rescaled to unit mass; a row without mass becomes uniform.

        A NULL row and one of another length than the grid become NULL.
        """
        weights = vector(self.node_weights)
        flat = vector(np.full(self.n, 1.0 / self.node_weights.sum()))
        return let(self.clean(as_column(pdf)), lambda d: let(dot(d, weights), lambda m: (
            F.when(F.size(d) != F.lit(self.n), F.lit(None)).when(m > 0, F.transform(d, lambda x: x / m)).when(m.isNotNull(), flat)
        )))

    def mass(self, pdf: Column | str) -> Column:
        return dot(as_column(pdf), vector(self.node_weights))

    def normalization_error(self, pdf: Column | str) -> Column:
        return F.abs(self.mass(pdf) - F.lit(1.0))

    def masses(self, density: Column) -> Column:
        """Mass between consecutive :attr:`nodes`."""
        if self.histogram:
            return F.zip_with(density, vector(self.widths), lambda d, w: d * w)
        gaps = vector(0.5 * np.diff(self.centers))
        m = self.n
        return let(density, lambda d: F.zip_with(
            F.zip_with(F.slice(d, 1, m - 1), F.slice(d, 2, m - 1), lambda a, b: a + b),
            gaps, lambda s, g: s * g,
        ))

    def cdf(self, density: Column | str) -> Column:
        """Cumulative mass at the bin centers, as an array."""
        from tessella.functions import kernels

        return kernels.grid_cdf(as_column(density), self)

    def bin_index(self, x: Column) -> Column:
        """The bin of a value, clipped to the grid."""
        return self.locate(x)

    def density_at(self, density: Column, x: Column) -> Column:
        """The density of the value's own bin, or of the nearest center; zero off the grid, NULL if either is missing."""
        missing = F.when(~scored(density, self.n, x), F.lit(None).cast("double"))
        if self.histogram:
            off = (x < F.lit(self.edges[0])) | (x > F.lit(self.edges[-1]))
            return missing.when(off, F.lit(0.0)).otherwise(at(density, self.locate(x)))
        c = self.centers
        mid = 0.5 * (c[1:] + c[:-1])
        near = Bins(tuple(mid)).count_le(x) if mid.size > 1 else (x >= F.lit(float(mid[0]))).cast("int")
        off = (x < F.lit(float(c[0] - 0.5 * (c[1] - c[0])))) | (x > F.lit(float(c[-1] + 0.5 * (c[-1] - c[-2]))))
        return missing.when(off, F.lit(0.0)).otherwise(at(density, near))


def default_grid(low: float, high: float, n_bins: int = DEFAULT_N_BINS) -> Grid:
    """The grid used when none is given: the target range widened by 5 % on each side."""
    pad = DEFAULT_PADDING * (high - low) or DEFAULT_PADDING
    return Grid.linear(low - pad, high + pad, n_bins)


def quantile_native_grid(low: float, high: float) -> Grid:
    """The native grid of quantile predictions: 1,500 equal bins, range padded by 25 %."""
    pad = QUANTILE_GRID_PADDING * (high - low)
    n = round(QUANTILE_GRID_BINS * (1.0 + 2.0 * QUANTILE_GRID_PADDING))
    return Grid.linear(low - pad, high + pad, n, normalization="histogram")


def constant_bins(value: float) -> Bins:
    """Buckets around one value with a zero-width bucket on it (a constant target)."""
    pad = 0.01 * max(abs(value), 1.0) / 3.0
    return Bins((value - pad, value, value, value + pad))


def target_range(df: DataFrame, y: str) -> tuple[float, float]:
    """The target's minimum and maximum: one aggregate row."""
    row = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi")).first()
    if row["lo"] is None:
        raise ValueError(f"{y} has no values")
    return float(row["lo"]), float(row["hi"])

