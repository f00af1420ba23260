"""Many fits of one model in one plan: contexts that grow step by step, or differ by what is masked in them.

A density of bin shares is known from counts, so the fits of all steps are one
table of counts per (step, key, bin); nested contexts are sums of the counts
of their steps so far. All steps are scored in one pass over the test rows and
reported as groups of one table, so the number of jobs does not grow with the
number of steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tessella.functions import histogram as H
from tessella.functions.grids import Bins, Grid
from tessella.functions.scores import object_scores
from tessella.functions.uniform import hash_uniform
from tessella.operators.estimators import pivot_counts, predict
from tessella.operators.metrics import SUMMARY_COLUMNS, summarize
from tessella.operators.ranks import hash_ranks
from tessella.session import materialize


def first_step(pool: DataFrame, sizes: Sequence[int], id_col: str = "id", seed=0) -> DataFrame:
    """The rows of the largest context, each with ``step``: the first of the rising sizes whose context holds it.

    Contexts are the pool's first rows in hash order, so a smaller one is part of every larger one.
    """
    if list(sizes) != sorted(sizes):
        raise ValueError("sizes must not fall")
    ranked = hash_ranks(pool, seed, id_col).where(F.col("rank") <= sizes[-1])
    return ranked.withColumn("step", F.aggregate(F.lit(list(map(int, sizes))), F.lit(0), lambda s, k: s + (k < F.col("rank")).cast("int"))).drop("rank")


def step_counts(context: DataFrame, y: str, bins: Bins, by: Sequence[str], nested: int | None = None) -> DataFrame:
    """``(step, *by, bin, c)``: context rows per bin. With ``nested`` steps, a row counts in its own step and all later ones.

    Counts combine where the rows lie; what is added up over the steps are counts, not rows.
    """
    counts = context.groupBy("step", *by, bins.locate(F.col(y)).alias("bin")).agg(F.count("*").cast("double").alias("c"))
    if nested is None:
        return counts
    later = counts.withColumn("step", F.explode(F.sequence("step", F.lit(nested - 1))))
    return later.groupBy("step", *by, "bin").agg(F.sum("c").alias("c"))


def step_densities(counts: DataFrame, by: Sequence[str], bins: Bins, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """``(step, *by, density)`` per key that has no NULL, and ``(step, density)`` of each whole context."""
    def dense(table: DataFrame) -> DataFrame:
        p = table.withColumn("p", H.probabilities("masses", bins))
        return p.withColumn("density", H.on_grid("p", bins, grid)).drop("masses", "p")

    known = counts.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by]))
    whole = counts.groupBy("step", "bin").agg(F.sum("c").alias("c"))
    return dense(pivot_counts(known, ["step", *by], "bin", "c", bins.n)), dense(pivot_counts(whole, ["step"], "bin", "c", bins.n))


def step_report(counts: DataFrame, test: DataFrame, y: str, by: Sequence[str], bins: Bins, grid: Grid, labels: Sequence[str], point: str = "mode", **options) -> DataFrame:
    """One report row per label: the test rows of step k (their ``report`` column) scored by the densities of their ``step``.

    A test row whose key is missing or unknown to its context takes the whole
    context's density. A step whose context is empty has no report.
    """
    own, whole = step_densities(materialize(counts), by, bins, grid)
    rows = predict(test, own, ["step", *by], name="density")
    # One row per step.
    rows = rows.join(F.broadcast(whole.withColumnRenamed("density", "_whole")), "step")
    rows = rows.withColumn("density", F.coalesce("density", "_whole")).drop("_whole")
    scored = object_scores(rows, "density", y, grid, point).select("report", y, "y_pred", "cde", "pit", "crps", "nll")
    out = summarize(scored, y, "y_pred", ["report"], point=point, **options)
    name = F.element_at(F.lit(list(labels)), F.col("report") + 1)
    return out.select(name.alias("model"), "point_estimate", "scale", *SUMMARY_COLUMNS)


def _every_step(test: DataFrame, steps: int) -> DataFrame:
    """Each test row once per step."""
    return test.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("report", F.col("step"))


def learning_curve(pool: DataFrame, test: DataFrame, y: str, by: Sequence[str], bins: Bins, grid: Grid, sizes: Sequence[int], id_col: str = "id", seed=0, **options) -> DataFrame:
    """A report row per context size."""
    counts = step_counts(first_step(pool, sizes, id_col, seed), y, bins, by, len(sizes))
    return step_report(counts, _every_step(test, len(sizes)), y, by, bins, grid, [str(n) for n in sizes], **options)


def bias_repair(biased: DataFrame, calibration: DataFrame, test: DataFrame, y: str, by: Sequence[str], bins: Bins, grid: Grid, sizes: Sequence[int], id_col: str = "id", seed=0, **options) -> DataFrame:
    """A report row per number of calibration rows added to a biased context."""
    keep = [id_col, *by, y]
    context = biased.select(*keep).withColumn("step", F.lit(0)).unionByName(first_step(calibration.select(*keep), sizes, id_col, seed))
    counts = step_counts(context, y, bins, by, len(sizes))
    return step_report(counts, _every_step(test, len(sizes)), y, by, bins, grid, [f"biased + {n}" for n in sizes], **options)


def missing_data_stress(context: DataFrame, test: DataFrame, y: str, by: Sequence[str], bins: Bins, grid: Grid, fractions: Sequence[float], id_col: str = "id", seed=0, **options) -> DataFrame:
    """Two report rows per fraction of masked keys: masked in the test rows only (``test``), and in the context too (``both``).

    A row with a masked key takes the whole context's density.
    """
    def masked(df: DataFrame, number: str, share, tag: str) -> DataFrame:
        """``share`` is the fraction hidden in the rows numbered so; the same cells as :func:`tessella.operators.selection.mask_cells` hides."""
        return df.withColumns({k: F.when(hash_uniform(f"{seed}/{tag}", F.lit(k), F.col(id_col)) >= F.element_at(share, F.col(number) + 1), F.col(k)) for k in by})

    # Context 0 is whole; context k hides the k-th fraction. Report 2 k is fraction k in the test alone, 2 k + 1 in both.
    hidden = F.lit([0.0, *map(float, fractions)])
    contexts = masked(context.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(fractions))))), "step", hidden, "context")
    rows = test.withColumn("report", F.explode(F.sequence(F.lit(0), F.lit(2 * len(fractions) - 1))))
    rows = masked(rows, "report", F.lit([float(f) for f in fractions for _ in "tb"]), "test")
    rows = rows.withColumn("step", F.when(F.col("report") % 2 == 0, 0).otherwise((F.col("report") + 1).cast("int") / 2).cast("int"))
    labels = [f"{where} {f}" for f in fractions for where in ("test", "both")]
    out = step_report(step_counts(contexts, y, bins, by), rows, y, by, bins, grid, labels, **options)
    parts = F.split("model", " ")
    return out.withColumns({"model": parts[0], "fraction": parts[1].cast("double")})
