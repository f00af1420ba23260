"""Feature building, and transforms fitted on context rows and applied to any rows.

A fitted transform is a handful of numbers per column; applying it is one
``select``. NULL and NaN are ignored when fitting and stay missing.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.functions.arrays import at, let, ratio, vector
from tessella.functions.grids import Bins
from tessella.functions.uniform import noise, normal_ppf
from tessella.operators.ranks import bracket, exact_quantiles, spread_knots
from tessella.operators.validate import require_columns
from tessella.session import materialize

# Feature modes and transform conventions.
FEATURE_MODES = ("mag", "mag-color", "all")
BANDS = ("U", "G", "R", "I", "Z", "Y")
CLIP_FLOOR = 1e-6
NOISE_SCALE = 1e-3
NORMAL_BOUND = 1e-7


def build_features(
    df: DataFrame, mode: str = "mag-color", *, bands: Sequence[str] = BANDS, reference: str = "I", keep: Sequence[str] = (),
) -> DataFrame:
    """Magnitudes, differences and their errors (in quadrature), float32, errors last."""
    if mode not in FEATURE_MODES:
        raise ValueError(f"mode must be one of {FEATURE_MODES}, got {mode!r}")
    require_columns(df, [*bands, *[f"{b}ERR" for b in bands]])
    if reference not in bands:
        raise ValueError(f"reference {reference!r} is not one of {bands}")
    singles = [reference] if mode == "mag-color" else list(bands)
    pairs = {"mag": [], "mag-color": list(itertools.pairwise(bands)), "all": list(itertools.combinations(bands, 2))}[mode]
    m = lambda b: F.col(b).cast("float")
    e = lambda b: F.col(f"{b}ERR").cast("float")
    return df.select(
        *keep,
        *[m(b).alias(b) for b in singles],
        *[(m(a) - m(b)).alias(f"{a}-{b}") for a, b in pairs],
        *[e(b).alias(f"{b}ERR") for b in singles],
        *[F.hypot(e(a), e(b)).cast("float").alias(f"{a}-{b}ERR") for a, b in pairs])


def _known(c: str) -> Column:
    """NaN as NULL, so that aggregates skip it."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _row(df: DataFrame, aggregates: Sequence[Column]) -> dict:
    return df.agg(*aggregates).first().asDict()


def informative_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least two distinct known values on the context."""
    row = _row(df, [a for c in columns for a in (F.min(_known(c)).alias(f"lo_{c}"), F.max(_known(c)).alias(f"hi_{c}"))])
    kept = [c for c in columns if row[f"lo_{c}"] is not None and row[f"lo_{c}"] < row[f"hi_{c}"]]
    if not kept:
        raise ValueError("every feature is constant or missing on the context")
    return kept


@dataclasses.dataclass(frozen=True)
class SoftClip:
    """Two-pass outlier bounds per column; beyond a bound a value grows only by its logarithm."""

    bounds: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], threshold: float) -> SoftClip:
        single = df.limit(2).count() < 2

        def measure(limits: dict[str, tuple[float, float]] | None) -> dict[str, tuple[float, float]]:
            aggregates = []
            for c in columns:
                v = _known(c)
                if limits is not None:
                    v = F.when(v.between(*limits[c]), v)
                spread = F.stddev_pop(v) if single else F.try_divide(F.stddev_samp(v), F.when(F.count(v) > 1, F.lit(1.0)))
                aggregates += [F.avg(v).alias(f"m_{c}"), spread.alias(f"s_{c}")]
            row, out = _row(df, aggregates), {}
            for c in columns:
                mean, std = row[f"m_{c}"], row[f"s_{c}"]
                if mean is None or std is None:
                    out[c] = (-float("inf"), float("inf"))
                else:
                    reach = threshold * max(std, CLIP_FLOOR)
                    out[c] = (mean - reach, mean + reach)
            return out

        return cls(measure(measure(None)))

    def value(self, c: str) -> Column:
        low, high = self.bounds[c]
        x = _known(c)
        raised = F.greatest(x, F.lit(low) - F.log1p(F.abs(x)))
        return F.when(x.isNotNull(), F.least(raised, F.lit(high) + F.log1p(F.abs(raised))))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.value(c) for c in self.bounds})


@dataclasses.dataclass(frozen=True)
class Robust:
    """``(x - median) / IQR`` (an IQR of 0 counts as 1)."""

    params: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Robust:
        q = column_quantiles(df, columns, [0.25, 0.5, 0.75])
        return cls({c: (v[1], (v[2] - v[0]) or 1.0) for c, v in q.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (_known(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.params.items()})


def column_quantiles(df: DataFrame, columns: Sequence[str], levels: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles of several columns: the columns, written once, stacked as groups of one pass."""
    df = materialize(df.select(*[_known(c).alias(c) for c in columns]))
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), _known(c).alias("v")) for c in columns])).alias("t")).select("t.*")
    return {r["c"]: list(r["q"]) for r in exact_quantiles(stacked, "v", levels, ["c"]).collect()}


@dataclasses.dataclass(frozen=True)
class QuantileMap:
    """The empirical quantile map to a uniform or normal output."""

    knots: dict[str, list[float]]
    levels: tuple[float, ...]
    normal: bool

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], *, output: str = "normal", rule: str = "default", seed: int | None = None, id_col: str = "id") -> QuantileMap:
        """``rule`` sets the knots: default ``min(1000, n)``, uniform ``n / 5``, noisy ``n / 30`` in [10, 1000]
        with a little seeded noise first so that ties do not collapse."""
        n = df.count()
        count = {"default": min(1000, n), "uniform": max(n // 5, 2), "noisy": max(min(n // 30, 1000), 10)}[rule]
        count = max(min(count, n), 1)
        if rule == "noisy":
            row = _row(df, [F.stddev_pop(_known(c)).alias(c) for c in columns])
            df = df.withColumns({c: _known(c) + noise(f"{seed}/{c}", F.col(id_col)) * F.lit(NOISE_SCALE * (row[c] or 0.0)) for c in columns})
        levels = np.linspace(0.0, 1.0, count)
        return cls(column_quantiles(df, columns, levels), tuple(levels), output == "normal")

    def value(self, c: str) -> Column:
        q = np.maximum.accumulate(np.asarray(self.knots[c]))
        l, x = np.asarray(self.levels), _known(c)
        if q.size == 1:
            share = F.when(x < F.lit(float(q[0])), F.lit(0.0)).otherwise(F.lit(1.0))
        else:
            bins, values, levels = Bins(tuple(q)), vector(q), vector(l)

            def lerp(k: Column) -> Column:
                # k knots lie before x.
                j = F.least(F.greatest(k, F.lit(1)), F.lit(q.size - 1))
                return let(j, lambda i: at(levels, i - 1) + (at(levels, i) - at(levels, i - 1)) * ratio(
                    x - at(values, i - 1), at(values, i) - at(values, i - 1)))

            # Ties take the middle of their run of levels.
            low = let(bins.count_lt(x), lambda k: F.when(k == 0, F.lit(0.0)).otherwise(lerp(k)))
            high = let(bins.count_le(x), lambda k: F.when(k >= q.size, F.lit(1.0)).otherwise(lerp(k)))
            share = (low + high) * 0.5
            share = F.when(x <= F.lit(float(q[0])) + (NORMAL_BOUND if self.normal else 0.0), F.lit(0.0)).when(
                x >= F.lit(float(q[-1])) - (NORMAL_BOUND if self.normal else 0.0), F.lit(1.0)).otherwise(share)
        if self.normal:
            share = let(F.least(F.greatest(share, F.lit(NORMAL_BOUND)), F.lit(1.0 - NORMAL_BOUND)), normal_ppf)
        return F.when(x.isNotNull(), share)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.value(c) for c in self.knots})


@dataclasses.dataclass(frozen=True)
class SpreadMap:
    """The empirical quantile map with a knot for every few rows: its knots are a table, fitted and applied by joins.

    ``knots`` is (c, q, first, last, top), one row per distinct knot of a column.
    """

    knots: DataFrame
    columns: tuple[str, ...]
    normal: bool

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], *, output: str = "uniform", rows_per_knot: int = 5) -> SpreadMap:
        """``n / rows_per_knot`` knots per column, two at least, over the known values; a column needs two of them."""
        stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), _known(c).alias("v")) for c in columns])).alias("t")).select("t.*")
        count = F.greatest(F.floor(F.col("n") / rows_per_knot), F.lit(2))
        return cls(materialize(spread_knots(stacked, "v", count, ["c"])), tuple(columns), output == "normal")

    def shares(self, df: DataFrame) -> DataFrame:
        """(c, v, share) of every distinct known value of the columns."""
        stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), _known(c).alias("v")) for c in self.columns])).alias("t")).select("t.*")
        ends = self.knots.groupBy("c").agg(F.min("q").alias("low"), F.max("q").alias("high"), F.max("top").alias("top"))
        x, a, b = F.col("v"), F.col("below"), F.col("above")
        inner = F.when(x == a["q"], (a["first"] + a["last"]) / F.lit(2.0)).otherwise(
            a["last"] + (b["first"] - a["last"]) * ratio(x - a["q"], b["q"] - a["q"]))
        room = NORMAL_BOUND if self.normal else 0.0
        share = F.when(x <= F.col("low") + room, F.lit(0.0)).when(x >= F.col("high") - room, F.lit(1.0)).otherwise(inner / F.col("top"))
        if self.normal:
            share = let(F.least(F.greatest(share, F.lit(NORMAL_BOUND)), F.lit(1.0 - NORMAL_BOUND)), normal_ppf)
        # One row per column.
        return bracket(stacked, "v", self.knots, "q", ["c"]).join(F.broadcast(ends), "c").select("c", "v", share.alias("share"))

    def transform(self, df: DataFrame) -> DataFrame:
        """The columns mapped; a value that many rows hold is looked up once. Missing values stay missing."""
        found = materialize(self.shares(df))
        for c in self.columns:
            own = found.where(F.col("c") == c).select(F.col("v").alias("_v"), F.col("share").alias("_share"))
            df = df.withColumn("_v", _known(c)).join(own, "_v", "left").withColumn(c, F.col("_share")).drop("_v", "_share")
        return df


def yeo_johnson(x: Column, lam: Column | float) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))

    def branch(power: Column) -> Column:
        return F.when(F.abs(power) < 1e-9, F.log1p(F.abs(x))).otherwise(
            (F.pow(F.abs(x) + 1.0, power) - 1.0) / F.when(F.abs(power) < 1e-9, F.lit(1.0)).otherwise(power))

    return F.when(x >= 0, branch(lam)).otherwise(-branch(F.lit(2.0) - lam))


@dataclasses.dataclass(frozen=True)
class Power:
    """Yeo-Johnson, standardized. Columns without spread pass through."""

    params: dict[str, tuple[float, float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], passes: int = 12, candidates: int = 11, widenings: int = 12) -> Power:
        """The exponent of largest likelihood, by narrowing.

        The search starts on [-5, 5]; while the best candidate is at an end,
        the bracket moves on beyond it and doubles. A pass is one aggregate
        over plain expressions, one row in all. The columns are written once,
        so a pass does not compute them again.
        """
        df = materialize(df.select(*[_known(c).alias(c) for c in columns]))
        known = {c: _known(c) for c in columns}
        row = _row(df, [a for c, x in known.items() for a in (
            F.min(x).alias(f"lo_{c}"), F.max(x).alias(f"hi_{c}"), F.count(x).alias(f"n_{c}"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"j_{c}"))])
        span = {c: (-5.0, 5.0) for c in columns if row[f"lo_{c}"] is not None and row[f"lo_{c}"] < row[f"hi_{c}"]}
        if not span:
            return cls({})
        left = dict.fromkeys(span, (passes, widenings))
        while any(n for n, _ in left.values()):
            tried = {c: np.linspace(*span[c], candidates) for c in span if left[c][0]}
            spread = _row(df, [F.var_pop(yeo_johnson(known[c], float(lam))).alias(f"{c}_{i}") for c, t in tried.items() for i, lam in enumerate(t)])
            for c, t in tried.items():
                v = [spread[f"{c}_{i}"] for i in range(candidates)]
                score = [-0.5 * row[f"n_{c}"] * np.log(x) + (lam - 1.0) * row[f"j_{c}"] if x and np.isfinite(x) else -np.inf for x, lam in zip(v, t)]
                k, (n, wide), width = int(np.argmax(score)), left[c], t[-1] - t[0]
                if k in (0, candidates - 1) and wide and n == passes:
                    span[c] = (t[0] - 2 * width, t[1]) if k == 0 else (t[-2], t[-1] + 2 * width)
                    left[c] = (n, wide - 1)
                else:
                    step = t[1] - t[0]
                    span[c], left[c] = (t[k] - step, t[k] + step), (n - 1, wide)
        found = {c: 0.5 * sum(ends) for c, ends in span.items()}
        row = _row(df, [a for c, lam in found.items() for a in (
            F.avg(yeo_johnson(_known(c), lam)).alias(f"m_{c}"), F.stddev_pop(yeo_johnson(_known(c), lam)).alias(f"s_{c}"))])
        return cls({c: (lam, row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c, lam in found.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (yeo_johnson(_known(c), lam) - F.lit(m)) / F.lit(s) for c, (lam, m, s) in self.params.items()})


def target_scaling(df: DataFrame, y: str, sample: bool = False) -> tuple[float, float]:
    """(offset, scale): mean and standard deviation; a constant target gives (c, 1)."""
    std = F.stddev_samp(y) if sample else F.stddev_pop(y)
    row = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.avg(y).alias("m"), std.alias("s")).first()
    if row["lo"] == row["hi"]:
        return float(row["lo"]), 1.0
    return float(row["m"]), float(row["s"]) if row["s"] and row["s"] > 0 else 1.0


def group_scaling(df: DataFrame, key: str, y: str) -> DataFrame:
    """The same per group: ``(key, offset, scale)``."""
    constant = F.min(y) == F.max(y)
    return df.groupBy(key).agg(
        F.when(constant, F.min(y)).otherwise(F.avg(y)).alias("offset"),
        F.when(constant, F.lit(1.0)).otherwise(F.stddev_pop(y)).alias("scale"))


def ordinal_dictionary(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)`` of the context's categories in sorted order, numbered through range partitions."""
    from tessella.operators.ranks import dense_ids

    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return dense_ids(values, "code", ["value"])


def ordinal_encode(df: DataFrame, column: str, dictionary: DataFrame, out: str | None = None) -> DataFrame:
    """Codes learned on the context; unseen and missing categories become missing."""
    codes = dictionary.select(F.col("value").alias(column), F.col("code").cast("double").alias(out or f"{column}_code"))
    return df.join(codes, column, "left")


def ordered_codes(df: DataFrame, column: str, order: Sequence[str], out: str) -> DataFrame:
    """Codes of an ordered category, worst to best; refuses values outside the order."""
    code = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column)).cast("int") - 1
    if not df.where(F.col(column).isNotNull() & (code < 0)).isEmpty():
        raise ValueError(f"{column} has values outside {list(order)}")
    return df.withColumn(out, code)


def with_original(df: DataFrame, transformed: DataFrame, columns: Sequence[str], id_col: str, suffix: str = "_original") -> DataFrame:
    """Transformed columns followed by the untransformed ones."""
    raw = df.select(id_col, *[F.col(c).alias(f"{c}{suffix}") for c in columns])
    return transformed.join(raw, id_col)
