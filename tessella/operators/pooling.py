"""Pools of several models' predictions for the same rows, on one grid of equal bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, functions as F

from tessella.functions import histogram as H, kernels, quantile as Q
from tessella.functions.arrays import clip, weighted_sum
from tessella.functions.grids import Bins, Grid

# The pools' conventions.
POOL_PADDING = 0.25
MIN_POOL_BINS = 200
MAX_POOL_BINS = 10_000
LOG_FLOOR = 1e-10
POOL_LEVELS = np.linspace(0.0, 1.0, 1001)
EXACT_EDGES = 20_000


def pool_grid(y_range: tuple[float, float], members: Sequence[Bins], n_bins: int | None = None) -> Grid:
    """Targets' range padded by 25 %, cut to the members' union, at the finest member's median width."""
    reach = POOL_PADDING * (y_range[1] - y_range[0])
    wanted = (y_range[0] - reach, y_range[1] + reach)
    common = (max(wanted[0], min(m.edges[0] for m in members)), min(wanted[1], max(m.edges[-1] for m in members)))
    low, high = common if common[0] < common[1] else wanted
    if n_bins is None:
        overlapping = [m.widths[(m.array[1:] > low) & (m.array[:-1] < high)] for m in members]
        finest = min((float(np.median(w)) for w in overlapping if w.size), default=0.0)
        fitting = math.ceil((high - low) / finest) if finest > 0 else MAX_POOL_BINS
        n_bins = int(np.clip(fitting, MIN_POOL_BINS, MAX_POOL_BINS))
    return Grid.linear(low, high, n_bins, normalization="histogram")


def _weights(n: int, weights: Sequence[float] | None) -> np.ndarray:
    w = np.full(n, 1.0 / n) if weights is None else np.asarray(weights, dtype=float)
    return w / w.sum()


def linear(members: Sequence[Column], grid: Grid, weights: Sequence[float] | None = None) -> Column:
    """The weighted mean of the masses. ``members`` are masses already on ``grid``."""
    return kernels.linear_pool(list(members), _weights(len(members), weights), grid.n)


def geometric(members: Sequence[Column], grid: Grid, weights: Sequence[float] | None = None) -> Column:
    """The weighted mean of floored log densities, exponentiated: agreement counts, tails shrink."""
    floor = LOG_FLOOR / (grid.edges[-1] - grid.edges[0])
    return kernels.geometric_pool(list(members), _weights(len(members), weights), grid.widths, floor)


def member_quantiles(p: Column | str, bins: Bins, grid: Grid) -> Column:
    """A member's quantiles at the pool's levels, cut to the pool grid."""
    q = H.ppf(p, bins, POOL_LEVELS)
    return F.transform(q, lambda x: clip(x, grid.edges[0], grid.edges[-1]))


def quantile_member_quantiles(knots: Column | str, levels, grid: Grid) -> Column:
    q = Q.ppf(knots, levels, POOL_LEVELS)
    return F.transform(q, lambda x: clip(x, grid.edges[0], grid.edges[-1]))


def exact_bins(union: Bins, grid: Grid) -> Bins:
    """Where a mixture is inverted: its own union edges, or the pool grid's when there are too many."""
    if union.n + 1 <= EXACT_EDGES:
        return union
    return Bins(tuple(np.unique(np.r_[union.edges[0], grid.array, union.edges[-1]])))


def quantile(members: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """The weighted mean of quantile functions."""
    return weighted_sum(list(members), _weights(len(members), weights))
