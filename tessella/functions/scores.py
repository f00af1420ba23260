"""Per-row scores of a density on a grid against the row's truth.

``d`` is a normalized density column (``grid.normalize``) of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions import histogram, kernels
from tessella.functions.arrays import as_column, clip, is_finite, ratio, scored, total, vector
from tessella.functions.grids import Bins, Grid

# Score conventions.
NLL_FLOOR = 1e-12
SCALES = ("1+y", "none")
INVALID = ("drop", "null", "raise")


def pit(d: Column | str, grid: Grid, y: Column) -> Column:
    """The mass below the truth; 0 and 1 at and beyond the ends."""
    value = histogram.cdf_at(grid.masses(as_column(d)), grid.nodes, y)
    if grid.histogram:
        return value
    return F.when(value.isNotNull() & (y <= F.lit(float(grid.centers[0]))), F.lit(0.0)).otherwise(value)


def cde(d: Column | str, grid: Grid, y: Column) -> Column:
    """``integral of p^2 - 2 p(y)``, the row's part of the density-estimation loss."""
    a = as_column(d)
    square = total(F.zip_with(a, vector(grid.node_weights), lambda x, w: x * x * w))
    return square - F.lit(2.0) * grid.density_at(a, y)


def nll(d: Column | str, grid: Grid, y: Column, floor: float = NLL_FLOOR) -> Column:
    if not (floor > 0 and np.isfinite(floor)):
        raise ValueError("floor must be positive and finite")
    return -F.ln(F.greatest(grid.density_at(as_column(d), y), F.lit(floor)))


def crps(d: Column | str, grid: Grid, y: Column) -> Column:
    """The continuous ranked probability score, exact for the grid's piecewise-linear CDF; NULL if either is missing."""
    return kernels.crps(as_column(d), y, grid)


def crps_jvm(masses: Column, y: Column, nodes: Bins) -> Column:
    """:func:`crps` as one JVM fold over the pieces."""
    pieces = F.zip_with(masses, F.arrays_zip(
        vector(nodes.array[:-1]).alias("a"), vector(nodes.array[1:]).alias("b")),
        lambda m, t: F.struct(m.alias("m"), t["a"].alias("a"), t["b"].alias("b")))
    begin = F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("s"))

    def area(u: Column, v: Column) -> Column:
        return (u * u + u * v + v * v) / 3.0

    def step(s: Column, t: Column) -> Column:
        end = s["f"] + t["m"]
        cut = clip(y, t["a"], t["b"])
        mid = s["f"] + t["m"] * ratio(cut - t["a"], t["b"] - t["a"])
        return F.struct(end.alias("f"), (
            s["s"] + (cut - t["a"]) * area(s["f"], mid) + (t["b"] - cut) * area(mid - 1.0, end - 1.0)).alias("s"))

    first, last = F.lit(nodes.edges[0]), F.lit(nodes.edges[-1])
    beyond = F.greatest(first - y, F.lit(0.0)) + F.greatest(y - last, F.lit(0.0))
    return F.when(is_finite(y), F.aggregate(pieces, begin, step, lambda s: s["s"]) + beyond)


def problems(df: DataFrame, density: str, y: str, grid: Grid) -> DataFrame:
    """One row: n, and how many rows lack a truth, lack a density, or have one of another length than the grid."""
    d = F.col(density)
    return df.agg(
        F.count("*").alias("n"), F.count_if(~is_finite(F.col(y).cast("double"))).alias("missing_truth"),
        F.count_if(d.isNull()).alias("missing_density"), F.count_if(F.coalesce(F.size(d) != F.lit(grid.n), F.lit(False)) & d.isNotNull()).alias("wrong_length"))


def object_scores(df: DataFrame, density: str, y: str, grid: Grid, point: str | None = None, *, invalid: str = "drop") -> DataFrame:
    """Adds ``cde, pit, crps, nll`` (and ``y_pred``) from one normalization.

    A row without a finite truth, without a density, or with a density of
    another length than the grid cannot be scored: it is dropped
    (:func:`problems` counts such rows), or kept with NULL scores
    (``invalid="null"``), or ends the job (``"raise"``). The result without
    its density column is the compact table that
    :func:`tessella.operators.metrics.summarize` aggregates.
    """
    from tessella.functions import points

    if invalid not in INVALID:
        raise ValueError(f"invalid must be one of {INVALID}, got {invalid!r}")
    t = F.col(y).cast("double")
    # One pass over the batch instead of one per score; F.col pins the density as a column.
    out = df.withColumn("_s", kernels.object_scores(F.col(density), t, grid, NLL_FLOOR))
    fits = F.col("_s.cde").isNotNull()
    if invalid == "drop":
        out = out.where(fits)
    elif invalid == "raise":
        out = out.where(F.when(fits, True).otherwise(F.raise_error(F.lit("a row has no finite truth or no density of the grid's length")).cast("boolean")))
    found = {n: F.col(f"_s.{n}") for n in ("cde", "pit", "crps", "nll")}
    if point in ("mean", "mode"):
        found["y_pred"] = F.col(f"_s.{point}")
    out = out.withColumns(found).drop("_s")
    if point in (None, "mean", "mode"):
        return out
    out = out.withColumn("_d", grid.normalize(density))
    return out.withColumn("y_pred", F.when(F.col("cde").isNotNull(), points.estimate("_d", grid, point))).drop("_d")


def residual(y: Column, prediction: Column, scale: str = "none") -> Column:
    if scale not in SCALES:
        raise ValueError(f"scale must be one of {SCALES}")
    plain = prediction - y
    return plain if scale == "none" else plain / (F.lit(1.0) + y)


def pinball(y: Column, quantiles: Column | str, levels) -> Column:
    """The row's quantile loss averaged over levels."""
    levels = np.asarray(levels, dtype=float)
    if (levels < 0).any() or (levels > 1).any():
        raise ValueError("levels must lie within [0, 1]")
    terms = F.zip_with(as_column(quantiles), vector(levels), lambda q, t: F.greatest(t * (y - q), (t - 1.0) * (y - q)))
    return total(terms) / F.lit(float(levels.size))
