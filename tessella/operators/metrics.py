"""Dataset-level statistics of per-row scores, per group.

The per-row table (``tessella.functions.scores.object_scores``) is the partial
result; everything here is the final aggregate over it, in two shuffles of
compact columns whatever the width of the densities.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.arrays import is_finite
from tessella.functions.scores import residual
from tessella.operators.ranks import Sketch, exact_quantiles, join_groups, named, running_counts, sketch, unnamed
from tessella.session import materialize

# The statistics' conventions.
MAD_SCALE = 1.4826
IQR_SCALE = 1.349
OUTLIER_FLOOR = 0.06
FIXED_OUTLIER = 0.15
PIT_EXTREME = 1e-4
AD_CUTS = ((0.05, 0.95), (0.01, 0.99))
KL_BINS = 20
# Rows up to which the exact distribution of the Kolmogorov statistic is worked out.
EXACT_ROWS = 2_000
SUMMARY_COLUMNS = (
    "n", "bias", "sigma_mad", "sigma_iqr", "outlier_rate", "outlier_threshold", "outlier_rate_015",
    "median_abs_error", "cde_loss", "pit_ks", "pit_ks_pvalue", "pit_cvm", "pit_ad1", "pit_ad2",
    "pit_rmse", "pit_kl", "pit_outlier_rate", "crps", "nll",
)


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A group is named by a struct of its columns (a constant without any): every statistic has one form, and NULL is a group."""
    return named(df, by, "_all"), ["_all"]


def point_metrics(
    df: DataFrame, y: str, prediction: str, by: Sequence[str] = (), scale: str = "none", *,
    written: bool = False, known: Sketch | None = None,
) -> DataFrame:
    """Bias, robust scatter and outlier rates of point estimates, one row per group.

    The residuals are read several times, so they are written down first
    unless the table already is (``written``). ``known`` is a sketch of the
    columns ``e`` (residual) and ``a`` (its size), if there is one.
    """
    df, keys = _grouped(df, by)
    e = df.select(*keys, residual(F.col(y), F.col(prediction), scale).alias("e"))
    e = (e if written else materialize(e)).withColumn("a", F.abs("e"))
    known = sketch(e, ["e", "a"], keys) if known is None else known
    quart = exact_quantiles(e, "e", [0.25, 0.5, 0.75], keys, cuts=known.cuts["e"])
    quart = quart.select(*keys, "n", F.col("q")[1].alias("bias"), ((F.col("q")[2] - F.col("q")[0]) / IQR_SCALE).alias("sigma_iqr"))
    # A row per group, read by three branches.
    quart = materialize(quart.withColumn("outlier_threshold", F.greatest(F.lit(OUTLIER_FLOOR), F.lit(3.0) * F.col("sigma_iqr"))))
    centered = join_groups(e, quart.select(*keys, "bias", "outlier_threshold"), keys, known.groups).withColumn("m", F.abs(F.col("e") - F.col("bias")))
    spread = exact_quantiles(centered, "m", [0.5], keys, cuts=known.cuts["a"]).select(*keys, (F.col("q")[0] * MAD_SCALE).alias("sigma_mad"))
    middle = exact_quantiles(e, "a", [0.5], keys, cuts=known.cuts["a"]).select(*keys, F.col("q")[0].alias("median_abs_error"))
    rates = centered.groupBy(*keys).agg(
        F.avg((F.col("a") > F.col("outlier_threshold")).cast("double")).alias("outlier_rate"),
        F.avg((F.col("a") > FIXED_OUTLIER).cast("double")).alias("outlier_rate_015"))
    out = quart.join(spread, keys).join(rates, keys).join(middle, keys)
    return out.select(*unnamed(by, "_all"), *SUMMARY_COLUMNS[:8])


def _block(a: Column, c: Column) -> Column:
    """Sum of ``2 i - 1`` over the ranks a+1 .. a+c of one run of equal values."""
    return c * (F.lit(2.0) * a + c)


def _anderson_darling(u: Column, a: Column, c: Column, low: float, high: float, name: str) -> list[Column]:
    """Sums from which :func:`_ad_statistic` makes ``sum (2i-1) ln v + (2n+1-2i) ln(1-v)`` over the values inside the cut.

    ``a`` counts from the group's start; the values below the cut are taken
    off the ranks afterwards, so no second pass is needed.
    """
    v = F.least(F.greatest((u - low) / (high - low), F.lit(1e-15)), F.lit(1.0 - 1e-15))
    inside = (u > low) & (u < high)
    tilt = F.ln(v) - F.log1p(-v)
    return [F.sum(F.when(inside, _block(a, c) * tilt)).alias(f"{name}_ranked"), F.sum(F.when(inside, c * tilt)).alias(f"{name}_tilt"),
            F.sum(F.when(inside, c * F.log1p(-v))).alias(f"{name}_above"), F.sum(F.when(inside, c).otherwise(0.0)).alias(f"{name}_n"),
            F.sum(F.when(u <= low, c).otherwise(0.0)).alias(f"{name}_skip")]


def _ad_statistic(name: str) -> Column:
    n, skip = F.col(f"{name}_n"), F.col(f"{name}_skip")
    total = F.col(f"{name}_ranked") - 2.0 * skip * F.col(f"{name}_tilt") + 2.0 * n * F.col(f"{name}_above")
    return F.when(n > 0, -n - F.try_divide(total, n)).otherwise(F.lit(float("nan")))


def ks_pvalue(d: Column, n: Column) -> Column:
    """The asymptotic tail of the Kolmogorov statistic with its first two size corrections."""
    x = F.sqrt(n) * d
    k = F.sequence(F.lit(0), F.lit(24))
    pi2 = 9.869604401089358

    def series(term) -> Column:
        return F.aggregate(k, F.lit(0.0), lambda s, i: s + term((i + 0.5) * (i + 0.5)))

    root = 1.2533141373155001  # sqrt(pi / 2)
    small = F.least(F.greatest(x, F.lit(0.08)), F.lit(6.0))
    decay = lambda h: F.exp(-pi2 * h / (2.0 * small * small))
    zero = 2.0 * root / small * series(decay)
    first = root / (3.0 * F.pow(small, 4)) * series(lambda h: (pi2 * h - small * small) * decay(h))
    cdf = zero + first / F.sqrt(n)
    return F.when(x > 6.0, F.lit(0.0)).otherwise(F.least(F.greatest(F.lit(1.0) - cdf, F.lit(0.0)), F.lit(1.0)))


def kolmogorov(n: int, d: float) -> float:
    """P(D_n < d) for the two-sided statistic of ``n`` uniform values, exactly: the n-th power of one matrix.

    With d = (k - h) / n, 0 <= h < 1, the probability is n! / n^n times the middle
    entry of the n-th power of a (2k - 1)-square matrix of inverse factorials.
    """
    if n <= 0 or d >= 1.0:
        return 1.0
    if 2.0 * n * d <= 1.0:
        return 0.0
    k = int(n * d) + 1
    h, m = k - n * d, 2 * k - 1
    steps = np.arange(1, m + 1)
    inverse = np.concatenate(([1.0], np.exp(-np.cumsum(np.log(steps)))))  # 1 / i!
    gap = np.arange(m)[:, None] - np.arange(m)[None, :] + 1
    matrix = np.where(gap >= 0, inverse[np.clip(gap, 0, m)], 0.0)
    edge = (1.0 - h ** steps) * inverse[1:]
    matrix[:, 0], matrix[-1, :] = edge, edge[::-1]
    matrix[-1, 0] = (1.0 - 2.0 * h ** m + (max(0.0, 2.0 * h - 1.0) ** m if h > 0.5 else 0.0)) * inverse[m]
    # Powers by squaring, each scaled by a power of two that is kept apart.
    power, shift, base, base_shift, left = np.eye(m), 0, matrix, 0, n
    while left:
        if left & 1:
            power, shift = power @ base, shift + base_shift
            e = int(np.frexp(max(power[k - 1, k - 1], 1e-300))[1])
            power, shift = np.ldexp(power, -e), shift + e
        left >>= 1
        if left:
            base, base_shift = base @ base, 2 * base_shift
            e = int(np.frexp(base[k - 1, k - 1])[1])
            base, base_shift = np.ldexp(base, -e), base_shift + e
    log = np.log(max(power[k - 1, k - 1], 1e-300)) + shift * np.log(2.0) + math.lgamma(n + 1) - n * math.log(n)
    return float(min(1.0, max(0.0, np.exp(log))))


def ks_pvalue_exact(d: Column, n: Column) -> Column:
    """The exact tail of the statistic, batch by batch; beyond 18 = n d^2 its leading term, exact to a double's last digits."""
    @F.arrow_udf("double")
    def of(d: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for x, rows in zip(d.to_pylist(), n.to_pylist(), strict=True):
            known = x is not None and rows is not None
            out.append(None if not known else 2.0 * math.exp(-2.0 * rows * x * x) if rows * x * x > 18.0 else 1.0 - kolmogorov(int(rows), x))
        return pa.array(out, pa.float64())

    return of(d, n.cast("double"))


def with_exact_pvalue(df: DataFrame, most: int = EXACT_ROWS, d: str = "pit_ks", n: str = "n", name: str = "pit_ks_pvalue") -> DataFrame:
    """The p-value made exact in groups of up to ``most`` rows, where the asymptotic one is some percent off."""
    small = F.when(F.col(n) <= most, F.col(d))
    return df.withColumn("_exact", ks_pvalue_exact(small, F.col(n))).withColumn(name, F.coalesce("_exact", name)).drop("_exact")


def pit_statistics(
    df: DataFrame, pit: str = "pit", by: Sequence[str] = (), *, written: bool = False, cuts: list[float] | None = None,
) -> DataFrame:
    """Uniformity of the PIT values several ways, from one ordered table of distinct values.

    The p-value is asymptotic; see :func:`with_exact_pvalue` for few rows.
    """
    df, keys = _grouped(df, by)
    values = df.select(*keys, F.col(pit).alias("u"))
    ranked = running_counts(values if written else materialize(values), "u", keys, cuts=cuts)
    u, a, c, n = F.col("u"), F.col("before").cast("double"), F.col("c").cast("double"), F.col("n").cast("double")
    middle = (a + c / 2.0) / n
    square = c * (middle - u) * (middle - u) + c * (c * c - 1.0) / (12.0 * n * n)
    sums = [
        F.max(F.col("n")).alias("n"),
        F.max(F.greatest((a + c) / n - u, u - a / n)).alias("pit_ks"),
        F.sum(square).alias("_ss"),
        F.sum(F.when((u < PIT_EXTREME) | (u > 1.0 - PIT_EXTREME), c).otherwise(0.0)).alias("_extreme"),
    ]
    for i, (low, high) in enumerate(AD_CUTS, 1):
        sums += _anderson_darling(u, a, c, low, high, f"_ad{i}")
    bins = [F.sum(F.when(pit_bin(u, KL_BINS) == b, c).otherwise(0.0)).alias(f"_h{b}") for b in range(KL_BINS)]
    out = ranked.groupBy(*keys).agg(*sums, *bins)
    share = [F.col(f"_h{b}") / F.col("n") for b in range(KL_BINS)]
    kl = sum((F.when(s > 0, s * F.ln(s * KL_BINS)).otherwise(F.lit(0.0)) for s in share), F.lit(0.0))
    return out.select(
        *unnamed(by, "_all"), "n", "pit_ks", ks_pvalue(F.col("pit_ks"), F.col("n").cast("double")).alias("pit_ks_pvalue"),
        (F.col("_ss") + F.lit(1.0) / (F.lit(12.0) * F.col("n"))).alias("pit_cvm"),
        *[_ad_statistic(f"_ad{i}").alias(f"pit_ad{i}") for i in (1, 2)],
        F.sqrt(F.col("_ss") / F.col("n")).alias("pit_rmse"), kl.alias("pit_kl"),
        (F.col("_extreme") / F.col("n")).alias("pit_outlier_rate"))


def pit_bin(u: Column, n_bins: int) -> Column:
    """Equal bins of [0, 1]; 1.0 falls in the last."""
    return F.least(F.floor(u * n_bins), F.lit(n_bins - 1)).cast("int")


def anderson_darling(df: DataFrame, pit: str, low: float, high: float, by: Sequence[str] = ()) -> DataFrame:
    """The statistic of the values strictly inside (low, high); NaN when there is none."""
    df, keys = _grouped(df, by)
    ranked = running_counts(df.select(*keys, F.col(pit).alias("u")), "u", keys)
    a, c = F.col("before").cast("double"), F.col("c").cast("double")
    return ranked.groupBy(*keys).agg(*_anderson_darling(F.col("u"), a, c, low, high, "_ad")).select(*unnamed(by, "_all"), _ad_statistic("_ad").alias("ad"))


def mean_scores(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The means of the per-row scores that are present; an absent one is NaN."""
    names = {"cde": "cde_loss", "crps": "crps", "nll": "nll"}
    return df.groupBy(*by).agg(*[
        (F.avg(k) if k in df.columns else F.lit(float("nan"))).alias(v) for k, v in names.items()])


def pdf_metrics(
    scores: DataFrame, by: Sequence[str] = (), *, written: bool = False, cuts: list[float] | None = None,
) -> DataFrame:
    """CDE loss, PIT statistics, CRPS and NLL per group."""
    scores = scores.select(*by, *[c for c in ("cde", "pit", "crps", "nll") if c in scores.columns])
    df, keys = _grouped(scores if written else materialize(scores), by)
    stats = pit_statistics(df, "pit", keys, written=True, cuts=cuts)
    return stats.join(mean_scores(df, keys), keys).select(*unnamed(by, "_all"), "n", "cde_loss", *SUMMARY_COLUMNS[9:17], "crps", "nll")


def summarize(
    scores: DataFrame, y: str = "y", prediction: str = "y_pred", by: Sequence[str] = (), *,
    point: str = "mode", scale: str = "none", label: str | None = None, written: bool = False,
) -> DataFrame:
    """The one-row-per-group report of a score table, columns in the fixed order.

    The score table is written down once, unless it already is (``written``), sketched in one pass, and read by
    the aggregates; the quartiles are the only other job before the result is
    asked for.
    """
    df, keys = _grouped(scores if written else materialize(scores), by)
    e = residual(F.col(y), F.col(prediction), scale)
    known = sketch(df.withColumns({"e": e, "a": F.abs(e)}), ["e", "a", "pit"], keys)
    left = point_metrics(df, y, prediction, keys, scale, written=True, known=known)
    right = pdf_metrics(df, keys, written=True, cuts=known.cuts["pit"]).drop("n")
    lead = [] if label is None else [F.lit(label).alias("model")]
    return left.join(right, keys).select(
        *lead, *unnamed(by, "_all"), F.lit(point).alias("point_estimate"), F.lit(scale).alias("scale"), *SUMMARY_COLUMNS)


def coverage(df: DataFrame, level: float, pit: str = "pit", by: Sequence[str] = ()) -> DataFrame:
    """The share of truths inside their central interval, read from the PIT."""
    inside = F.abs(F.col(pit) - 0.5) <= 0.5 * level
    return df.groupBy(*by).agg(F.avg(inside.cast("double")).alias("coverage"))


def interval_coverage(df: DataFrame, y: str, lo: Column, hi: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(y).between(lo, hi).cast("double")).alias("coverage"))


def side_by_side(tables: Sequence[DataFrame], id_col: str = "id") -> DataFrame:
    """Tables of the same rows joined by id; an id that lacks in one of them is refused when the rows are read."""
    marked = [t.withColumn(f"_has{k}", F.lit(True)) for k, t in enumerate(tables)]
    joined = reduce(lambda a, b: a.join(b, id_col, "full"), marked)
    have = reduce(lambda a, b: a & b, [F.col(f"_has{k}").isNotNull() for k in range(len(tables))])
    lacking = F.concat(F.lit(f"a table of {len(tables)} lacks the row {id_col} = "), F.coalesce(F.col(id_col).cast("string"), F.lit("NULL")))
    return joined.where(F.when(have, F.lit(True)).otherwise(F.raise_error(lacking).cast("boolean"))).drop(*[f"_has{k}" for k in range(len(tables))])


def paired_difference(a: DataFrame, b: DataFrame, score: str, id_col: str = "id") -> DataFrame:
    """Mean difference of two models' scores on the same rows, with its standard error."""
    joined = side_by_side([a.select(id_col, F.col(score).alias("_a")), b.select(id_col, F.col(score).alias("_b"))], id_col)
    d = F.col("_a") - F.col("_b")
    return joined.agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_difference"),
        (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("standard_error"))


def absolute_errors(df: DataFrame, y: str, estimates: Sequence[str]) -> DataFrame:
    """MAE and RMSE of several point estimates, one row each, from one pass."""
    row = df.agg(*[a for m in estimates for a in (
        F.avg(F.abs(F.col(m) - F.col(y))).alias(f"mae_{m}"), F.sqrt(F.avg((F.col(m) - F.col(y)) * (F.col(m) - F.col(y)))).alias(f"rmse_{m}"))])
    pairs = F.array(*[F.struct(F.lit(m).alias("estimate"), F.col(f"mae_{m}").alias("mae"), F.col(f"rmse_{m}").alias("rmse")) for m in estimates])
    return row.select(F.explode(pairs).alias("r")).select("r.*")


def finite_pairs(df: DataFrame, *names: str) -> DataFrame:
    """Rows where every named column is a finite number."""
    for name in names:
        df = df.where(is_finite(F.col(name)))
    return df
