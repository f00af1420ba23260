"""Mergeable states of a score table: what a growing table's report needs, kept beside each batch.

A batch leaves two small tables. ``moments`` has one row per group: counts and
sums of the scores, and a quantile sketch of the residuals. ``counts`` has
one row per group and interval of the residual. States of any number of
batches add up; a report reads them, finds the intervals that hold the
wanted order statistics, and reads only the rows of these intervals from the
score table itself, so its medians are exact.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.functions.scores import residual
from tessella.operators.metrics import FIXED_OUTLIER, IQR_SCALE, KL_BINS, PIT_EXTREME, pit_bin
from tessella.operators.ranks import GROUP, named, unnamed

#: Entries of a sketch's buffer: a rank is wrong by at most about 2.5 / k of the rows, in 99 of 100 cases.
SKETCH_K = 200
SKETCH_ERROR = 0.025
SCORES = ("cde", "crps", "nll")
INTERVAL = "_interval"


@dataclasses.dataclass(frozen=True)
class Resolution:
    """Width of the residuals' intervals, a power of two, so that a value falls in the same one everywhere.

    It decides how many rows a report reads, not its result.
    """

    width: float = 2.0 ** -3

    def interval(self, value: Column) -> Column:
        return F.floor(value / F.lit(self.width))


def sketch(value: Column | str) -> Column:
    """A quantile sketch of bounded size that can be stored and merged (``merge_sketches``)."""
    return F.kll_sketch_agg_double(value, F.lit(SKETCH_K))


def merge_sketches(column: Column | str) -> Column:
    return F.kll_merge_agg_double(column, F.lit(SKETCH_K))


def sketched_quantiles(column: Column | str, levels: Sequence[float]) -> Column:
    return F.array(*[F.kll_sketch_get_quantile_double(column, F.lit(float(q))) for q in levels])


def moments(scores: DataFrame, by: Sequence[str], y: str = "y", prediction: str = "y_pred") -> DataFrame:
    """One row per group; every column but the sketch adds up over batches."""
    e, u = residual(F.col(y), F.col(prediction), "none"), F.col("pit")
    sums = [a for s in SCORES for a in (F.count(s).alias(f"n_{s}"), F.sum(s).alias(f"sum_{s}"))]
    bins = F.array(*[F.count_if(pit_bin(u, KL_BINS) == b) for b in range(KL_BINS)])
    return scores.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(e).alias("n_e"), *sums, F.count_if(F.abs(e) > FIXED_OUTLIER).alias("n_far"),
        F.count_if((u < PIT_EXTREME) | (u > 1.0 - PIT_EXTREME)).alias("n_extreme"), bins.alias("pit_bins"), sketch(e).alias("sketch"))


def merged(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """The moments of several batches as those of one."""
    names = ["n", "n_e", *[f"{k}_{s}" for s in SCORES for k in ("n", "sum")], "n_far", "n_extreme"]
    bins = F.array(*[F.sum(F.col("pit_bins")[b]) for b in range(KL_BINS)])
    return states.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names], bins.alias("pit_bins"), merge_sketches("sketch").alias("sketch"))


def intervals(scores: DataFrame, by: Sequence[str], resolution: Resolution, y: str = "y", prediction: str = "y_pred") -> DataFrame:
    """(*by, _interval, c): residuals per interval."""
    e = residual(F.col(y), F.col(prediction), "none")
    return scores.where(e.isNotNull()).groupBy(*by, resolution.interval(e).alias(INTERVAL)).agg(F.count("*").alias("c"))


def exact_from_states(scores: DataFrame, counts: DataFrame, by: Sequence[str], levels: Sequence[float], y: str = "y", prediction: str = "y_pred") -> DataFrame:
    """(*by, q): exact quantiles of the residual; ``scores`` has the column ``_interval``, ``counts`` is their number per interval.

    Only rows of intervals that hold a wanted rank are read: the intervals
    are a filter on the table's own column, beside the join.
    """
    per = named(counts, by).groupBy(GROUP, INTERVAL).agg(F.sum("c").alias("c"))
    own = Window.partitionBy(GROUP)
    ends = per.withColumns({"_end": F.sum("c").over(own.orderBy(INTERVAL)), "_n": F.sum("c").over(own)}).withColumn("_start", F.col("_end") - F.col("c"))
    low = [F.floor((F.col("_n") - 1) * q) for q in levels]
    ranks = F.array_distinct(F.filter(F.flatten(F.array(*[F.array(r, F.least(r + 1, F.col("_n") - 1)) for r in low])), lambda r: (r >= F.col("_start")) & (r < F.col("_end"))))
    targets = ends.select(GROUP, INTERVAL, "_start", "_n", ranks.alias("_ranks")).where(F.size("_ranks") > 0)
    wanted = [r[INTERVAL] for r in targets.select(INTERVAL).distinct().limit(1001).collect()]
    rows = scores if len(wanted) > 1000 else scores.where(F.col(INTERVAL).isin(wanted))
    e = residual(F.col(y), F.col(prediction), "none")
    values = named(rows, by).select(GROUP, INTERVAL, e.alias("_e")).where("_e IS NOT NULL").groupBy(GROUP, INTERVAL, "_e").agg(F.count("*").alias("c"))
    inside = Window.partitionBy(GROUP, INTERVAL).orderBy("_e")
    found = values.join(targets, [GROUP, INTERVAL]).withColumn("_hi", F.col("_start") + F.sum("c").over(inside)).withColumn("_lo", F.col("_hi") - F.col("c"))
    found = found.withColumn("_rank", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_lo")) & (r < F.col("_hi")))))
    at = found.groupBy(GROUP).agg(F.max("_n").alias("_n"), F.map_from_entries(F.collect_set(F.struct("_rank", "_e"))).alias("_at"))

    def pick(q: float) -> Column:
        h = (F.col("_n") - 1) * F.lit(float(q))
        a, b, part = F.element_at("_at", F.floor(h)), F.element_at("_at", F.least(F.floor(h) + 1, F.col("_n") - 1)), h - F.floor(h)
        return F.when((part == 0) | (a == b), a).otherwise((F.lit(1.0) - part) * a + part * b)

    return at.select(*unnamed(by), F.array(*[pick(q) for q in levels]).alias("q"))


def report(scores: DataFrame, states: DataFrame, counts: DataFrame, by: Sequence[str], y: str = "y", prediction: str = "y_pred") -> DataFrame:
    """One row per group: n, means of the scores, exact bias and interquartile spread, rates and the PIT's divergence, from the states."""
    total = named(merged(states, by), by)
    quart = named(exact_from_states(scores, counts, by, [0.25, 0.5, 0.75], y, prediction), by).select(GROUP, "q")
    share = F.transform("pit_bins", lambda c: c / F.col("n"))
    kl = F.aggregate(share, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.ln(p * KL_BINS)).otherwise(F.lit(0.0)))
    means = [F.try_divide(F.col(f"sum_{s}"), F.col(f"n_{s}")).alias("cde_loss" if s == "cde" else s) for s in SCORES]
    return total.join(quart, GROUP, "left").select(
        *by, "n", *means, F.col("q")[1].alias("bias"), ((F.col("q")[2] - F.col("q")[0]) / IQR_SCALE).alias("sigma_iqr"),
        F.try_divide(F.col("n_far"), F.col("n_e")).alias("outlier_rate_015"), kl.alias("pit_kl"), (F.col("n_extreme") / F.col("n")).alias("pit_outlier_rate"))
