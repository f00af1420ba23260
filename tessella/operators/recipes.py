"""Recurring analyses of predicted distributions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.functions import histogram as H, points
from tessella.functions.arrays import as_column, at, vector
from tessella.functions.grids import Bins, Grid
from tessella.functions.uniform import hash_uniform
from tessella.operators.estimators import DensityModel
from tessella.operators.ranks import exact_quantiles, hash_blocks, hash_ranks
from tessella.operators.selection import mask_cells
from tessella.session import materialize


def region_probability(df: DataFrame, p: str, bins: Bins, below: float | None = None, above: float | None = None, name: str = "prob") -> DataFrame:
    """P(y <= below) or P(y > above) per row."""
    value = H.cdf_at(p, bins, F.lit(float(below))) if above is None else F.lit(1.0) - H.cdf_at(p, bins, F.lit(float(above)))
    return df.withColumn(name, value)


def level_probabilities(p: str, bins: Bins, levels: Sequence[int]) -> Column:
    """P(k) = F(k + 1/2) - F(k - 1/2) for consecutive integer levels."""
    edges = np.asarray([levels[0] - 0.5] + [k + 0.5 for k in levels], dtype=float)
    cdf = H.cdf_values(p, bins, edges)
    n = len(levels)
    return F.zip_with(F.slice(cdf, 2, n), F.slice(cdf, 1, n), lambda b, a: b - a)


def predicted_and_observed(df: DataFrame, prob: str, y: str, levels: Sequence[int], weight: str | None = None) -> DataFrame:
    """Mean predicted and observed share of each level, one pass. A row counts ``weight`` times, or once."""
    w = F.col(weight) if weight else F.lit(1)
    mean = lambda v: F.sum(v * w) / F.sum(F.when(v.isNotNull(), w))
    row = df.agg(*[a for i, k in enumerate(levels) for a in (
        mean(F.col(prob)[i]).alias(f"p{i}"), mean((F.col(y) == k).cast("double")).alias(f"o{i}"))])
    cells = F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"p{i}").alias("predicted"), F.col(f"o{i}").alias("observed")) for i, k in enumerate(levels)])
    return row.select(F.explode(cells).alias("r")).select("r.*")


def most_probable_level(prob: Column | str, levels: Sequence[int]) -> Column:
    a = as_column(prob)
    return F.element_at(F.lit(np.asarray(levels, dtype=np.int32)), F.array_position(a, F.array_max(a)).cast("int"))


def randomized_pit(p: str, bins: Bins, y: Column, seed, key: Column, half: float = 0.5) -> Column:
    """Uniform between the CDF just below and just above a discrete value."""
    low, high = H.cdf_at(p, bins, y - half), H.cdf_at(p, bins, y + half)
    return low + hash_uniform(seed, key) * (high - low)


def change_of_variable(density: Column | str, source: Grid, target: Grid) -> Column:
    """A density in a transformed variable, brought to the original one: bins match one to one,
    so each keeps its mass and only the width changes."""
    if source.n != target.n:
        raise ValueError("the grids must have matching bins")
    return F.transform(F.arrays_zip(as_column(density).alias("d"), vector(source.widths).alias("a"), vector(target.widths).alias("b")),
                       lambda t: t["d"] * t["a"] / t["b"])


def conditional_coverage(df: DataFrame, y: str, lo: str, mid: str, hi: str, feature: str, edges: Sequence[float]) -> DataFrame:
    """Per feature bin (left-open): n, coverage, and the median width relative to the middle."""
    bins = Bins(tuple(edges))
    placed = df.withColumn("bin", bins.left_open_bucket(F.col(feature))).where((F.col("bin") >= 0) & (F.col("bin") < bins.n))
    placed = placed.withColumn("_w", (F.col(hi) - F.col(lo)) / F.col(mid))
    cover = placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"))
    width = exact_quantiles(placed, "_w", [0.5], ["bin"]).select("bin", F.col("q")[0].alias("relative_width"))
    return cover.join(width, "bin")


def estimate_spread(df: DataFrame, d: str, grid: Grid) -> DataFrame:
    """Largest minus smallest point estimate, and the density at the mean over the density at the mode."""
    out = df.withColumns({m: points.estimate(d, grid, m) for m in points.POINT_ESTIMATORS})
    each = [F.col(m) for m in points.POINT_ESTIMATORS]
    return out.withColumn("spread", F.greatest(*each) - F.least(*each)).withColumn(
        "mean_over_mode", at(F.col(d), grid.bin_index(F.col("mean"))) / F.array_max(d))


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def hardest(df: DataFrame, width: str, level: float = 0.95) -> DataFrame:
    """Rows above a quantile of their interval width; the threshold is one number."""
    threshold = exact_quantiles(df, width, [level]).first()["q"][0]
    return df.where(F.col(width) > F.lit(threshold))


def relative_to_best(table: DataFrame, dataset: str, score: str, name: str = "relative") -> DataFrame:
    return table.withColumn(name, F.col(score) / F.min(score).over(Window.partitionBy(dataset)))


def pivot_models(table: DataFrame, dataset: str, model: str, score: str, models: Sequence[str]) -> DataFrame:
    """One row per dataset, one column per model."""
    return table.groupBy(dataset).pivot(model, list(models)).agg(F.first(score))


def evaluate_contexts(make: Callable[[], DensityModel], contexts: dict[str, DataFrame], test: DataFrame, **options) -> DataFrame:
    """One report row per named context: bias repair, learning curves, bag sizes."""
    out = None
    for name, context in contexts.items():
        row = make().fit(context).evaluate(test, label=name, **options)
        out = row if out is None else out.unionByName(row)
    return out


def bias_repair(make: Callable[[], DensityModel], biased: DataFrame, calibration: DataFrame, test: DataFrame, sizes: Sequence[int], id_col: str = "id", seed: int = 0, **options) -> DataFrame:
    """Adds the first n calibration rows to a biased context and scores each n."""
    ranked = hash_ranks(calibration, seed, id_col)
    contexts = {f"biased + {n}": biased.unionByName(ranked.where(F.col("rank") <= n).drop("rank")) for n in sizes}
    return evaluate_contexts(make, contexts, test, **options)


def learning_curve(make: Callable[[], DensityModel], pool: DataFrame, test: DataFrame, sizes: Sequence[int], id_col: str = "id", seed: int = 0, **options) -> DataFrame:
    ranked = hash_ranks(pool, seed, id_col)
    return evaluate_contexts(make, {str(n): ranked.where(F.col("rank") <= n).drop("rank") for n in sizes}, test, **options)


def shuffled_column(df: DataFrame, column: str, id_col: str, seed) -> DataFrame:
    """A column's values dealt to other rows: the values' random ranks meet the rows' own.

    Rows and values move once, to the block of their rank, and meet there by their place in it.
    """
    kept = [c for c in df.columns if c != column]
    types = {f.name: f.dataType for f in df.schema.fields}
    nothing = lambda c: F.lit(None).cast(types[c]).alias(c)
    order, side = [F.col("_u"), F.col("_id")], F.col("_side")
    rows = hash_blocks(df.drop(column), f"{seed}/rows", id_col).select(
        F.lit(0).alias("_side"), "_block", "_u", F.col(id_col).alias("_id"), *[c for c in kept if c != id_col], nothing(column))
    dealt = hash_blocks(df.select(id_col, column), f"{seed}/values", id_col).select(
        F.lit(1).alias("_side"), "_block", "_u", F.col(id_col).alias("_id"), *[nothing(c) for c in kept if c != id_col], column)
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.unionByName(dealt).repartition(count, "_block")
    placed = both.withColumn("_r", F.row_number().over(Window.partitionBy("_block", "_side").orderBy(*order)))
    one = lambda c, of: F.first(F.when(side == of, F.col(c)), ignorenulls=True).alias(c)
    met = placed.groupBy("_block", "_r").agg(one("_id", 0), *[one(c, 0) for c in kept if c != id_col], one(column, 1))
    return met.select(*[F.col("_id").alias(id_col) if c == id_col else F.col(c) for c in kept], column)


def permutation_importance(df: DataFrame, features: Sequence[str], score: Callable[[DataFrame], float], id_col: str = "id", repeats: int = 5, seed: int = 0) -> DataFrame:
    """How much a score falls when one feature is shuffled: ``(feature, mean, std)``. The rows are written once for all repeats."""
    df = materialize(df)
    base, rows = score(df), []
    for f in features:
        drops = [base - score(shuffled_column(df, f, id_col, f"{seed}/{f}/{r}")) for r in range(repeats)]
        rows.append((f, float(np.mean(drops)), float(np.std(drops))))
    return df.sparkSession.createDataFrame(rows, "feature string, mean double, std double")


def temperature_sweep(df: DataFrame, logits: str, bins: Bins, y: str, temperatures: Sequence[float], level: float = 0.68) -> DataFrame:
    """Coverage of the central interval at each temperature: one pass, a row per temperature."""
    pits = [H.cdf_at(H.softmax(logits, t), bins, F.col(y)) for t in temperatures]
    named = df.select(*[p.alias(f"_{i}") for i, p in enumerate(pits)])
    row = named.agg(*[F.avg((F.abs(F.col(f"_{i}") - 0.5) <= 0.5 * level).cast("double")).alias(f"_{i}") for i in range(len(pits))])
    cells = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"_{i}").alias("coverage")) for i, t in enumerate(temperatures)])
    return row.select(F.explode(cells).alias("r")).select("r.*")


def folds(df: DataFrame, id_col: str, k: int, seed) -> DataFrame:
    return df.withColumn("fold", F.floor(hash_uniform(seed, F.col(id_col)) * k).cast("int"))


def missing_data_stress(make: Callable[[], DensityModel], context: DataFrame, test: DataFrame, features: Sequence[str], fractions: Sequence[float], id_col: str = "id", seed: int = 0, **options) -> DataFrame:
    """Scores with cells masked in the test rows only, and in both."""
    out, fitted = None, make().fit(context)
    for f in fractions:
        hidden = mask_cells(test, id_col, features, f, f"{seed}/test")
        refit = make().fit(mask_cells(context, id_col, features, f, f"{seed}/context"))
        for where, model in (("test", fitted), ("both", refit)):
            row = model.evaluate(hidden, label=where, **options).withColumn("fraction", F.lit(float(f)))
            out = row if out is None else out.unionByName(row)
    return out
