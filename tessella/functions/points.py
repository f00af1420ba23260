"""Point estimates of a density on a grid. ``d`` is a normalized density column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessella.functions import kernels
from tessella.functions.arrays import as_column, at, dot, let, vector
from tessella.functions.grids import Grid

# The estimates in reporting order, and the main peak's floor.
POINT_ESTIMATORS = ("mode", "peak_mean", "mean", "median")
PEAK_FRACTION = 0.05


def mode(d: Column | str, grid: Grid) -> Column:
    """The center of the highest bin, the lowest of several."""
    return let(as_column(d), lambda a: at(vector(grid.centers), F.array_position(a, F.array_max(a)).cast("int") - 1))


def peak_mean(d: Column | str, grid: Grid, frac: float = PEAK_FRACTION) -> Column:
    """The mean over the contiguous run around the mode with density >= ``frac`` of it."""
    return kernels.point_estimates(as_column(d), grid, frac)["peak_mean"]


def mean(d: Column | str, grid: Grid) -> Column:
    return dot(as_column(d), vector(grid.node_weights * grid.centers))


def median(d: Column | str, grid: Grid) -> Column:
    """Where the CDF reaches one half: the same inverse on edges or on centers."""
    return F.element_at(kernels.inverse_cdf(as_column(d), grid.nodes.array, [0.5], grid), 1)


def estimate(d: Column | str, grid: Grid, method: str) -> Column:
    """One estimate by name."""
    if method not in POINT_ESTIMATORS:
        raise ValueError(f"method must be one of {POINT_ESTIMATORS}, got {method!r}")
    return {"mode": mode, "peak_mean": peak_mean, "mean": mean, "median": median}[method](d, grid)


def all_estimates(d: Column | str, grid: Grid, raw: bool = False) -> list[Column]:
    """The four estimates as aliased columns, from one kernel call; with ``raw`` of densities of any scale."""
    found = kernels.point_estimates(as_column(d), grid, PEAK_FRACTION, raw)
    return [found[m].alias(m) for m in POINT_ESTIMATORS]


def peaks(d: Column | str, share: float = 0.1) -> Column:
    """How many local maxima reach ``share`` of the maximum in height and in prominence.

    A plateau counts once; the first and last bins are never peaks.
    """

    def flat(a: Column) -> Column:
        # Consecutive repeats removed, so that a plateau is one value.
        return F.transform(F.filter(
            F.transform(a, lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get(a, i - 1) == x, F.lit(False)).alias("same"))),
            lambda t: ~t["same"]), lambda t: t["x"])

    def prominence(r: Column, x: Column, i: Column) -> Column:
        left, right = F.slice(r, F.lit(1), i), F.slice(r, i + 2, F.size(r))
        # The lowest point on each side before a higher bin.
        def base(side: Column) -> Column:
            return let(F.array_position(F.transform(side, lambda v: v > x), F.lit(True)).cast("int"), lambda p: (
                F.array_min(F.when(p > 0, F.slice(side, F.lit(1), p)).otherwise(side))))
        return x - F.greatest(base(F.reverse(left)), base(right))

    def count(r: Column, top: Column) -> Column:
        n = F.size(r)
        hits = F.filter(F.transform(r, lambda x, i: F.when(
            (i > 0) & (i < n - 1) & (x >= top * F.lit(share))
            & (x > F.get(r, i - 1)) & (x > F.get(r, i + 1)),
            prominence(r, x, i)).otherwise(F.lit(-1.0))), lambda v: v >= top * F.lit(share))
        return F.size(hits)

    return let(as_column(d), lambda a: let(flat(a), lambda r: let(F.array_max(a), lambda top: count(r, top))))


