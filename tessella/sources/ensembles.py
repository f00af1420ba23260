"""Portable ensembles: parquet tables of distributions with their shared axis beside them.

``<path>/data`` holds one row per object with its values and metadata;
``<path>/meta`` holds one row: the kind, the shared buckets or levels, and
free-form provenance.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.functions.arrays import as_column, let, total, vector
from tessella.functions.grids import Bins
from tessella.functions.quantile import knot_levels, knots
from tessella.operators.mixtures import Mixture

KINDS = ("hist", "quant")


def merged_bins(bins: Bins) -> Bins:
    """Distinct edges: zero-width buckets are merged into the one above."""
    return Bins(tuple(np.unique(bins.array)))


def histogram_pdfs(p: Column | str, bins: Bins) -> Column:
    """Densities on the distinct edges. A point mass joins the bucket above it, or the last one."""
    distinct = merged_bins(bins)
    # The first copy of each edge value starts its bucket, so the copies' masses belong to it.
    first = np.searchsorted(bins.array, distinct.array, side="left")
    starts, counts = first[:-1], np.diff(np.r_[first[:-1], bins.n])
    masses = let(as_column(p), lambda a: F.zip_with(
        F.lit(starts.astype(np.int32)), F.lit(counts.astype(np.int32)), lambda s, n: total(F.slice(a, s + 1, n))))
    return F.zip_with(masses, vector(distinct.widths), lambda m, w: m / w)


def _write(df: DataFrame, path: str, kind: str, axis, provenance: dict | None) -> None:
    df.write.mode("overwrite").parquet(f"{path}/data")
    meta = df.sparkSession.createDataFrame(
        [(kind, [float(x) for x in axis], json.dumps(provenance or {}))], "kind string, axis array<double>, provenance string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def write_histograms(df: DataFrame, p: str, bins: Bins, path: str, keep: list[str], provenance: dict | None = None) -> None:
    _write(df.select(*keep, histogram_pdfs(p, bins).alias("pdfs")), path, "hist", merged_bins(bins).edges, provenance)


def write_quantiles(df: DataFrame, locs: str, levels, path: str, keep: list[str], provenance: dict | None = None) -> None:
    """Both tail ends are stored at levels 0 and 1."""
    _write(df.select(*keep, knots(locs, levels).alias("locs")), path, "quant", knot_levels(levels), provenance)


def write_mixture(mixture: Mixture, path: str, provenance: dict | None = None) -> None:
    """As its histogram on the union of edges."""
    from tessella.functions.histogram import probabilities

    h = mixture.to_histogram(name="_m").withColumn("_p", probabilities("_m", mixture.bins))
    write_histograms(h, "_p", mixture.bins, path, [mixture.id], provenance)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, str, list[float]]:
    """The table (``masses`` or ``locs``), its kind and its axis; other kinds are refused."""
    meta = spark.read.parquet(f"{path}/meta").first()
    df, axis = spark.read.parquet(f"{path}/data"), list(meta["axis"])
    if meta["kind"] not in KINDS:
        raise TypeError(f"only {KINDS} ensembles can be read, not {meta['kind']!r}")
    if meta["kind"] == "hist":
        masses = F.zip_with("pdfs", vector(np.diff(axis)), lambda d, w: d * w)
        df = df.withColumn("masses", masses).drop("pdfs")
    return df, meta["kind"], axis
