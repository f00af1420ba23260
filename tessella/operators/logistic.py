"""Hierarchies of ordered bins by logistic regressions, all fitted at once.

Bins of a level are told apart by a chain of two-way splits: of the rows in
bin i or above, which are above? Each split of each level is one logistic
regression, and a Newton step of all of them needs one grouped aggregate of
gradients and curvatures, so the number of jobs does not depend on the number
of bins. What reaches the driver is a few sums per split.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tessella.operators.estimators import Layout, level_labels
from tessella.session import materialize

RIDGE, STEPS, SETTLED, LONGEST = 1e-3, 12, 1e-5, 5.0


def _starts(layout: Layout) -> list[int]:
    """The number of the first split of each coarse bin's fine level; the coarse level has the first numbers."""
    return (layout.coarse.n - 1 + np.concatenate(([0], np.cumsum([f.n - 1 for f in layout.fine])))).astype(int).tolist()


def _chain(bin_: Column, n: Column, start: Column) -> Column:
    """The splits that a row in ``bin_`` of ``n`` bins takes part in: (split, up)."""
    last = F.least(bin_, n - 2)
    none = F.array().cast("array<struct<split:int,up:double>>")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        (start + i).cast("int").alias("split"), (bin_ > i).cast("double").alias("up")))).otherwise(none)


@dataclasses.dataclass(frozen=True)
class LogisticHierarchy:
    """Fitted splits. ``weights`` has a row per split: the intercept and a weight per standardized feature."""

    features: tuple[str, ...]
    layout: Layout
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]
    #: Splits whose rows all went one way, and that way's probability of "above" (0 or 1).
    settled: dict[int, float]

    @classmethod
    def fit(cls, context: DataFrame, features: Sequence[str], y: str, layout: Layout, *, ridge: float = RIDGE, steps: int = STEPS) -> LogisticHierarchy:
        """Newton steps from zero until one moves no weight by more than ``SETTLED`` (what is left then is about its square), at most ``steps`` of them.

        ``ridge`` is per row and spares the intercept. Rows with a missing
        target, feature or bin take no part; a split that all rows pass the
        same way is that way for sure.
        """
        d = len(features)
        # Written once: it is read for the scales, then once per step. Columns are renamed, so features of any name will do.
        rows = level_labels(context.select(F.col(y).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]), "_y", layout)
        known = ["coarse", "fine", "_y", *[f"_f{i}" for i in range(d)]]
        rows = materialize(rows.dropna(subset=known).select("coarse", "fine", *[f"_f{i}" for i in range(d)]))
        sums = rows.agg(*[F.avg(f"_f{i}").alias(f"m{i}") for i in range(d)], *[F.stddev_pop(f"_f{i}").alias(f"s{i}") for i in range(d)], F.count("*").alias("n")).first()
        if not sums["n"]:
            raise ValueError("no context row has a target, a bin and all features")
        mean = tuple(float(sums[f"m{i}"]) for i in range(d))
        scale = tuple(float(sums[f"s{i}"]) or 1.0 for i in range(d))
        starts, sizes = _starts(layout), [f.n for f in layout.fine]
        n_splits = starts[-1]
        place = F.col("coarse") + 1
        of = F.concat(_chain(F.col("coarse"), F.lit(layout.coarse.n), F.lit(0)), _chain(F.col("fine"), F.element_at(F.lit(sizes), place), F.element_at(F.lit(starts), place)))
        x = [F.lit(1.0), *[(F.col(f"_f{i}") - mean[i]) / scale[i] for i in range(d)]]
        taking = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], F.explode(of).alias("s")).select("s.split", "s.up", *[f"x{i}" for i in range(d + 1)])

        w = np.zeros((n_splits, d + 1))
        settled = {k: 0.0 for k in range(n_splits)}
        penalty = ridge * np.diag([0.0] + [1.0] * d)
        for _ in range(steps if n_splits else 0):
            moved = 0.0
            for r in cls._sums(taking, w).collect():
                k, n = r["split"], r["n"]
                if r["up"] in (0, n):
                    settled[k] = float(r["up"] > 0)
                    continue
                settled.pop(k, None)
                curve = np.zeros((d + 1, d + 1))
                curve[np.triu_indices(d + 1)] = r["h"]
                curve = np.triu(curve) + np.triu(curve, 1).T + n * penalty
                step = np.linalg.solve(curve, np.array(r["g"]) - n * penalty @ w[k])
                longest = np.abs(step).max()
                w[k] += step * min(1.0, LONGEST / longest) if longest else 0.0
                moved = max(moved, longest)
            if moved <= SETTLED:
                break
        return cls(tuple(features), layout, mean, scale, tuple(map(tuple, w.tolist())), settled)

    @staticmethod
    def _sums(taking: DataFrame, w: np.ndarray) -> DataFrame:
        """``(split, n, up, g, h)``: rows, rows above, gradient and the upper half of the curvature."""
        d = w.shape[1]
        own = F.element_at(F.lit(w.tolist()), F.col("split") + 1)
        line = sum((F.col(f"x{i}") * F.col("w")[i] for i in range(1, d)), F.col("w")[0])
        rows = taking.withColumn("w", own).withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-line)))
        rows = rows.withColumns({"g": F.col("up") - F.col("p"), "v": F.col("p") * (1.0 - F.col("p"))})
        pairs = list(zip(*np.triu_indices(d)))
        out = rows.groupBy("split").agg(
            F.count("*").alias("n"), F.sum("up").alias("up"), *[F.sum(F.col("g") * F.col(f"x{i}")).alias(f"g{i}") for i in range(d)],
            *[F.sum(F.col("v") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in pairs])
        return out.select("split", "n", "up", F.array(*[f"g{i}" for i in range(d)]).alias("g"), F.array(*[f"h{i}_{j}" for i, j in pairs]).alias("h"))

    def predict(self, queries: DataFrame, name: str = "masses") -> DataFrame:
        """Adds each row's masses in ``layout.bins``: P(coarse) P(fine | coarse). A row with a missing feature gets NULL."""
        z = F.array(*[(F.col(f"`{f}`").cast("double") - m) / s for f, m, s in zip(self.features, self.mean, self.scale, strict=True)])
        sure = [self.settled.get(k) for k in range(len(self.weights))]
        splits = F.lit([list(r) for r in self.weights]) if self.weights else F.array().cast("array<array<double>>")
        kept = F.lit([float("nan") if s is None else s for s in sure]) if sure else F.array().cast("array<double>")
        line = lambda w: F.aggregate(F.zip_with(F.slice(w, 2, len(self.features)), "_z", lambda a, b: a * b), w[0], lambda s, t: s + t)
        above = F.zip_with(splits, kept, lambda w, s: F.when(F.isnan(s), F.lit(1.0) / (F.lit(1.0) + F.exp(-line(w)))).otherwise(s))
        rows = queries.withColumn("_z", z).withColumn("_above", above)

        def level(start: int, n: int) -> Column:
            """Shares of the level's bins: those left by all splits below, times what stays at the next."""
            begin = F.struct(F.lit(1.0).alias("left"), F.array().cast("array<double>").alias("p"))
            chain = F.aggregate(F.slice("_above", start + 1, n - 1), begin, lambda s, a: F.struct(
                (s["left"] * a).alias("left"), F.concat(s["p"], F.array(s["left"] * (1.0 - a))).alias("p")), lambda s: F.concat(s["p"], F.array(s["left"])))
            return chain if n > 1 else F.array(F.lit(1.0))

        starts = _starts(self.layout)
        rows = rows.withColumn("_c", level(0, self.layout.coarse.n))
        rows = rows.withColumns({f"_p{j}": level(starts[j], f.n) for j, f in enumerate(self.layout.fine)})

        def part(j: int) -> Column:
            return F.transform(f"_p{j}", lambda p: p * F.col("_c")[j])

        parts = F.concat(*[part(j) for j in range(len(self.layout.fine))])
        whole = ~F.exists("_z", lambda v: v.isNull() | F.isnan(v))
        return rows.withColumn(name, F.when(whole, parts)).drop("_z", "_above", "_c", *[f"_p{j}" for j in range(len(self.layout.fine))])
