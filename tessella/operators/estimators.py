"""Spark-native conditional densities: shares of context rows per bin, hierarchies of bins,
nearest neighbours, and external predictors applied batch by batch."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions import histogram as H, kernels, points, quantile as Q
from tessella.functions.arrays import clip, let, vector
from tessella.functions.grids import Bins, Grid, constant_bins, default_grid, target_range, union_bins
from tessella.functions.scores import object_scores
from tessella.operators.metrics import summarize
from tessella.operators.mixtures import Mixture, Part
from tessella.operators.neighbours import nearest
from tessella.operators.ranks import GROUP, exact_quantiles, named, unnamed
from tessella.operators.validate import check_target

# Bin layouts and the neighbour floor.
MAX_CLASSES = 10
ROWS_PER_BIN = 5
MAX_GRID_BINS = 100
NEIGHBOUR_FLOOR = 1e-3
TOP_NUDGE = 1e-6


def pivot_counts(counts: DataFrame, keys: Sequence[str], bin_col: str, value: str, n: int, name: str = "masses") -> DataFrame:
    """``(keys, bin, value)`` as one array of ``n`` values per key; absent bins are 0.

    A key has at most ``n`` rows here, whatever the data behind the counts.
    """
    entries = F.map_from_entries(F.collect_list(F.struct(bin_col, value)))
    grouped = counts.groupBy(*keys).agg(entries.alias("_e"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.col("_e")[i], F.lit(0.0)))
    return grouped.select(*keys, filled.alias(name))


def bin_shares(df: DataFrame, y: str, bins: Bins, by: Sequence[str] = (), name: str = "masses") -> DataFrame:
    """Context rows per bin and key, as masses. Counts combine map-side, so a hot key is one row per task."""
    counts = df.groupBy(*by, bins.locate(F.col(y)).alias("bin")).agg(F.count("*").cast("double").alias("c"))
    if by:
        return pivot_counts(counts, by, "bin", "c", bins.n, name)
    return pivot_counts(counts.withColumn("_all", F.lit(0)), ["_all"], "bin", "c", bins.n, name).drop("_all")


def cross_fitted(df: DataFrame, y: str, bins: Bins, by: Sequence[str], fold: str, name: str = "masses") -> DataFrame:
    """``(*by, fold, masses)``: each fold's density from the rows of all other folds.

    One count per (key, fold, bin); a fold's table is the key's total minus its own.
    """
    own = df.groupBy(*by, fold, bins.locate(F.col(y)).alias("bin")).agg(F.count("*").cast("double").alias("c"))
    per_fold = pivot_counts(own, [*by, fold], "bin", "c", bins.n, "_own")
    totals = pivot_counts(own.groupBy(*by, "bin").agg(F.sum("c").alias("c")), by, "bin", "c", bins.n, "_all")
    return predict(per_fold, totals, by).select(*by, fold, F.zip_with("_all", "_own", lambda a, o: a - o).alias(name))


def predict(queries: DataFrame, table: DataFrame, by: Sequence[str], otherwise: Sequence[float] | None = None, name: str = "masses") -> DataFrame:
    """Every query row with its key's distribution; NULL is a key like any other.

    A row whose key the context never had gets ``otherwise`` (the context's
    marginal, say), or NULL. The join is left to Spark's size statistics: a
    small table is broadcast, a large one is shuffled with skew handling.
    """
    out = named(queries, by).join(named(table, by).drop(*by), GROUP, "left").drop(GROUP)
    return out if otherwise is None else out.withColumn(name, F.coalesce(name, vector(otherwise)))


def overall(context: DataFrame, make: Callable[[DataFrame, list[str]], DataFrame], name: str = "masses") -> list[float]:
    """What ``make(context, keys)`` gives for the context as one group: a short array, kept by the driver."""
    return list(make(context.withColumn("_one", F.lit(1)), ["_one"]).first()[name])


def marginal(queries: DataFrame, context: DataFrame, y: str, bins: Bins, name: str = "masses") -> DataFrame:
    """The baseline: the context's N(y) for every row, joined on a constant."""
    row = bin_shares(context.withColumn("_one", F.lit(1)), y, bins, ["_one"], name)
    return queries.withColumn("_one", F.lit(1)).join(F.broadcast(row), "_one").drop("_one")


def stored_density(queries: DataFrame, density: DataFrame, at: str, value: str, grid: Grid, name: str = "density") -> DataFrame:
    """One stored density repeated for every row.

    ``density`` is a short table of points: per-bin probabilities when it has
    one point per bin, else samples of a density, integrated exactly.
    """
    one = density.groupBy(F.lit(1).alias("_one")).agg(F.array_sort(F.collect_list(F.struct(F.col(at).cast("double").alias("x"), F.col(value).cast("double").alias("p")))).alias("_s"))
    xs, ps = F.transform("_s", lambda t: t["x"]), F.transform("_s", lambda t: t["p"])
    row = one.select("_one", F.when(F.size("_s") == grid.n, ps).otherwise(_integrated(xs, ps, grid)).alias("_m"))
    row = row.select("_one", F.zip_with(H.probabilities("_m", grid), vector(grid.widths), lambda m, w: m / w).alias(name))
    return queries.withColumn("_one", F.lit(1)).join(F.broadcast(row), "_one").drop("_one")


def _integrated(xs: Column, ps: Column, grid: Grid) -> Column:
    """Integral of a sampled, linearly joined density over each grid bin."""
    def below(e: Column) -> Column:
        # Area of each piece up to e, summed.
        pieces = F.arrays_zip(F.slice(xs, F.lit(1), F.size(xs) - 1).alias("a"), F.slice(xs, F.lit(2), F.size(xs) - 1).alias("b"),
                              F.slice(ps, F.lit(1), F.size(xs) - 1).alias("p"), F.slice(ps, F.lit(2), F.size(xs) - 1).alias("q"))
        # The cumulative trapezoid area is joined linearly between samples.
        return F.aggregate(pieces, F.lit(0.0), lambda s, t: s + F.lit(0.5) * (t["p"] + t["q"]) * clip(e - t["a"], 0.0, t["b"] - t["a"]))
    return F.zip_with(vector(grid.array[:-1]), vector(grid.array[1:]), lambda a, b: below(b) - below(a))


# -- equal-mass bins -----------------------------------------------------------


def auto_bin_count(n: int) -> int:
    """Bins per level: about five rows per final bin, between 2 and 10."""
    return min(MAX_CLASSES, max(2, math.isqrt(n // ROWS_PER_BIN)))


def edge_levels(n_bins: int, shift: float = 0.0) -> list[float]:
    return np.clip(np.linspace(0.0, 1.0, n_bins + 1) + shift / n_bins, 0.0, 1.0).tolist()


def equal_mass_edges(df: DataFrame, y: str, n_bins: int, low: float, high: float, shift: float = 0.0) -> Bins:
    """Equal-mass edges over [low, high]; the ends replace the outer quantiles."""
    row = exact_quantiles(df, y, edge_levels(n_bins, shift)).first()
    if row is None or row["n"] is None or not row["n"]:
        return Bins(tuple(np.linspace(low, high, n_bins + 1)))
    return Bins(tuple(np.maximum.accumulate([low, *row["q"][1:-1], high])))


@dataclasses.dataclass(frozen=True)
class Layout:
    """Coarse edges, and the fine edges inside each coarse bin."""

    coarse: Bins
    fine: tuple[Bins, ...]

    @property
    def bins(self) -> Bins:
        return Bins(tuple(e for f in self.fine for e in f.edges[:-1]) + (self.coarse.edges[-1],))


def equal_mass_layout(df: DataFrame, y: str, n_coarse: int, n_fine: int, low: float, high: float, shift: float = 0.0) -> Layout:
    """Equal-mass coarse bins, each cut into equal-mass fine bins; an empty one is cut evenly."""
    top = high + TOP_NUDGE * (high - low)
    coarse = equal_mass_edges(df, y, n_coarse, low, top, shift)
    placed = df.select(coarse.locate(F.col(y)).alias("coarse"), F.col(y).alias("y"))
    found = {r["coarse"]: r["q"] for r in exact_quantiles(placed, "y", edge_levels(n_fine, shift), ["coarse"]).collect()}
    fine = []
    for j, (a, b) in enumerate(zip(coarse.edges[:-1], coarse.edges[1:])):
        inner = found[j][1:-1] if j in found else np.linspace(a, b, n_fine + 1)[1:-1]
        fine.append(Bins(tuple(np.minimum(np.maximum.accumulate([a, *inner, b]), b))))
    return Layout(coarse, tuple(fine))


def grid_layout(grid: Bins) -> Layout:
    """The bins of a grid of at most 100 as they are, in the fewest balanced runs of at most ten."""
    if grid.n > MAX_GRID_BINS:
        raise ValueError(f"a matched grid holds at most {MAX_GRID_BINS} bins, not {grid.n}")
    runs = math.ceil(grid.n / MAX_CLASSES)
    short, longer = divmod(grid.n, runs)
    ends = np.cumsum([0] + [short + (i < longer) for i in range(runs)])
    return Layout(Bins(tuple(grid.array[ends])), tuple(Bins(tuple(grid.array[a:b + 1])) for a, b in zip(ends[:-1], ends[1:])))


def choose_layout(df: DataFrame, y: str, *, n_coarse: int | str = "auto", n_fine: int | str = "auto", grid: Bins | None = None, low: float, high: float, shift: float = 0.0) -> Layout:
    """Auto counts, explicit counts (which need a context row per bin), or the grid's own bins."""
    if "grid" in (n_coarse, n_fine):
        if n_coarse != n_fine or grid is None:
            raise ValueError("'grid' bins need both levels and a grid")
        return grid_layout(grid)
    n = df.count()
    coarse, fine = (auto_bin_count(n) if k == "auto" else int(k) for k in (n_coarse, n_fine))
    if (n_coarse, n_fine) != ("auto", "auto") and n < coarse * fine:
        raise ValueError(f"{n} context rows for {coarse * fine} bins")
    return equal_mass_layout(df, y, coarse, fine, low, high, shift)


def level_labels(df: DataFrame, y: str, layout: Layout) -> DataFrame:
    """Adds ``coarse`` and ``fine`` (the bin inside the coarse one); of zero-width bins the last."""
    t = F.col(y)
    fine = None
    for j, f in enumerate(layout.fine):
        test = F.col("coarse") == j
        fine = F.when(test, f.locate(t)) if fine is None else fine.when(test, f.locate(t))
    return df.withColumn("coarse", layout.coarse.locate(t)).withColumn("fine", fine)


def hierarchy_shares(context: DataFrame, y: str, layout: Layout, by: Sequence[str], name: str = "masses") -> DataFrame:
    """P(coarse | key) times P(fine | coarse, key) from context shares, one array per key.

    A coarse bin that a key never reaches has zero probability; its fine
    split is then irrelevant. Two levels of counts, both combined map-side.
    """
    labelled = level_labels(context, y, layout)
    counts = labelled.groupBy(*by, "coarse", "fine").agg(F.count("*").cast("double").alias("c"))
    counts = named(counts, by).drop(*by)
    level = counts.groupBy(GROUP, "coarse").agg(F.sum("c").alias("level"))
    key = level.groupBy(GROUP).agg(F.sum("level").alias("total"))
    starts = np.cumsum([0] + [f.n for f in layout.fine])
    start = F.element_at(F.lit(starts.astype(np.int32)), F.col("coarse") + 1)
    joined = counts.join(level, [GROUP, "coarse"]).join(key, GROUP)
    cells = joined.select(*unnamed(by), (start + F.col("fine")).alias("bin"), (F.col("level") / F.col("total") * (F.col("c") / F.col("level"))).alias("p"))
    return pivot_counts(cells, by, "bin", "p", layout.bins.n, name)


def bagged_levels(labelled: DataFrame, bags: DataFrame, id_col: str, n_fine: int) -> DataFrame:
    """Fine shares per coarse bin under bagging: ``(coarse, fine, p)``.

    Each member uses the rows of its bag inside the coarse bin; a member with
    none sits out; where no member has any, the context's own shares stand in.
    """
    member = bags.join(labelled.select(id_col, "coarse", "fine"), id_col).groupBy("member", "coarse", "fine").agg(F.count("*").cast("double").alias("c"))
    size = member.groupBy("member", "coarse").agg(F.sum("c").alias("n"))
    active = size.groupBy("coarse").agg(F.count("*").cast("double").alias("k"))
    p = member.join(size, ["member", "coarse"]).join(active, "coarse").groupBy("coarse", "fine").agg(F.sum(F.col("c") / F.col("n") / F.col("k")).alias("p"))
    whole = labelled.groupBy("coarse", "fine").agg(F.count("*").cast("double").alias("c"))
    total = whole.groupBy("coarse").agg(F.sum("c").alias("n"))
    neutral = whole.join(total, "coarse").join(active, "coarse", "left_anti").select("coarse", "fine", (F.col("c") / F.col("n")).alias("p"))
    return p.select("coarse", "fine", "p").unionByName(neutral)


def dithered(context: DataFrame, queries: DataFrame, y: str, by: Sequence[str], n_dither: int, n_coarse: int, n_fine: int, low: float, high: float, id_col: str = "id") -> Mixture:
    """Equal mixture over edge shifts of d / n_dither bins."""
    frames, parts = [], []
    for d in range(n_dither):
        layout = equal_mass_layout(context, y, n_coarse, n_fine, low, high, d / n_dither)
        table = hierarchy_shares(context, y, layout, by)
        whole = overall(context, lambda df, keys, layout=layout: hierarchy_shares(df, y, layout, keys))
        frames.append(predict(queries, table, by, whole).select(id_col, F.lit(str(d)).alias("component"), "masses"))
        parts.append(Part(str(d), layout.bins))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return Mixture(out, tuple(parts), id_col)


# -- hierarchy with spark.ml classifiers ----------------------------------------


def classifier_hierarchy(context: DataFrame, queries: DataFrame, features: Sequence[str], y: str, layout: Layout, classifier=None, name: str = "masses") -> DataFrame:
    """P(coarse) P(fine | coarse) from spark.ml classifiers, one for the coarse level and one per coarse bin.

    A level whose rows share one class gives it all the probability; a level
    without rows gives none.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    make = classifier or (lambda: LogisticRegression(maxIter=25, regParam=1e-3))
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error")
    train = level_labels(assembler.transform(context), y, layout)
    out = assembler.transform(queries)

    def level(data: DataFrame, label: str, n: int, table: DataFrame, column: str) -> DataFrame:
        present = sorted(r[0] for r in data.select(label).distinct().collect())
        if len(present) < 2:
            return table.withColumn(column, vector([1.0 if i in present else 0.0 for i in range(n)]))
        # Classes are numbered by position among those present, then put back in place.
        place = F.create_map(*[x for i, c in enumerate(present) for x in (F.lit(c), F.lit(float(i)))])
        model = make().setFeaturesCol("_x").setLabelCol("_y").setPredictionCol("_pred").setProbabilityCol("_prob").setRawPredictionCol("_raw").fit(
            data.withColumn("_y", place[F.col(label)]))
        scored = model.transform(table).withColumn("_a", vector_to_array("_prob"))
        spots = [F.col("_a")[present.index(i)] if i in present else F.lit(0.0) for i in range(n)]
        return scored.withColumn(column, F.array(*spots)).drop("_pred", "_prob", "_raw", "_a")

    out = level(train, "coarse", layout.coarse.n, out, "_c")
    for j, f in enumerate(layout.fine):
        out = level(train.where(F.col("coarse") == j), "fine", f.n, out, f"_f{j}")
    def block(j: int) -> Column:
        return F.transform(f"_f{j}", lambda p: p * F.col("_c")[j])

    blocks = [block(j) for j in range(len(layout.fine))]
    return out.withColumn(name, F.concat(*blocks)).drop("_x", "_c", *[f"_f{j}" for j in range(len(layout.fine))])


# -- neighbours --------------------------------------------------------------------


def neighbour_histogram(found: DataFrame, bins: Bins, name: str = "masses", floor: float = NEIGHBOUR_FLOOR) -> DataFrame:
    """Neighbours' targets counted per bucket over a small floor."""
    idx = F.transform("neighbours", lambda t: bins.locate(t["y"]))
    counts = let(idx, lambda ks: F.transform(F.sequence(F.lit(0), F.lit(bins.n - 1)), lambda i: (
        F.lit(floor) + F.size(F.filter(ks, lambda k: k == i)))))
    return found.withColumn(name, counts)


def neighbour_quantiles(found: DataFrame, levels, name: str = "locs") -> DataFrame:
    """Normal quantiles at the neighbours' mean and spread."""
    from tessella.functions.uniform import normal_ppf

    n = F.size("neighbours")
    mean = F.aggregate("neighbours", F.lit(0.0), lambda s, t: s + t["y"]) / n
    var = F.aggregate("neighbours", F.lit(0.0), lambda s, t: s + (t["y"] - F.col("_m")) * (t["y"] - F.col("_m"))) / n
    out = found.withColumn("_m", mean).withColumn("_s", F.sqrt(var) + F.lit(NEIGHBOUR_FLOOR))
    return out.withColumn(name, F.transform(vector(levels), lambda q: F.col("_m") + F.col("_s") * normal_ppf(q))).drop("_m", "_s")


# -- external predictors -------------------------------------------------------------


def apply_predictor(df: DataFrame, features: Sequence[str], f: Callable[[pd.DataFrame], np.ndarray], width: int, *, id_col: str = "id", keep: Sequence[str] = (), name: str = "masses", bins: Bins | None = None) -> DataFrame:
    """An external row-batch predictor as a narrow stage; row count, width and sign are checked per batch."""
    kept = [id_col, *keep]
    types = {s.name: s.dataType.simpleString() for s in df.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + f", `{name}` array<double>"
    names, check_sign = list(features), bins is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.asarray(f(batch[names]), dtype=np.float64)
            if out.shape != (len(batch), width):
                raise ValueError(f"the predictor returned {out.shape} for {len(batch)} rows of {width}")
            if not np.isfinite(out).all() or (check_sign and (out < 0).any()):
                raise ValueError("the predictor returned invalid values")
            yield batch[kept].assign(**{name: list(out)})

    return df.select(*dict.fromkeys([*kept, *names])).mapInPandas(run, schema)


@dataclasses.dataclass
class DensityModel:
    """``fit(df)`` as Spark jobs, ``transform(df)`` as a narrow stage over a small fitted table.

    The built-in model is the bin-share estimator. Subclass and override
    ``_fit`` and ``_distribution`` for another.
    """

    keys: Sequence[str]
    y: str = "y"
    id: str = "id"
    grid: Grid | None = None
    n_bins: int = 50
    table: DataFrame | None = None
    marginal: Sequence[float] | None = None
    bins: Bins | None = None
    constant: float | None = None

    def fit(self, df: DataFrame) -> DensityModel:
        """Refuses an empty table and targets that are missing or infinite."""
        check_target(df, self.y)
        low, high = target_range(df, self.y)
        if self.grid is None:
            self.grid = default_grid(low, high)
        if low == high:
            # A constant target needs no model: every row is a point mass.
            self.constant, self.bins = low, constant_bins(low)
        else:
            self._fit(df, low, high)
        return self

    def _fit(self, df: DataFrame, low: float, high: float) -> None:
        self.bins = Bins(tuple(np.linspace(low, high, self.n_bins + 1)))
        self.table = bin_shares(df, self.y, self.bins, self.keys)
        self.marginal = overall(df, lambda rows, keys: bin_shares(rows, self.y, self.bins, keys))

    def _distribution(self, df: DataFrame) -> DataFrame:
        return predict(df, self.table, self.keys, self.marginal)

    def aligned(self, df: DataFrame) -> DataFrame:
        """The rows with the fit's feature columns: by name, or by position where they are named ``x0, x1, ...``."""
        missing = [k for k in self.keys if k not in df.columns]
        plain = [f"x{i}" for i in range(len(self.keys))]
        if missing and all(c in df.columns for c in plain) and f"x{len(plain)}" not in df.columns:
            return df.withColumnsRenamed(dict(zip(plain, self.keys, strict=True)))
        if missing:
            raise ValueError(f"feature names differ from the fit's: missing {missing}")
        return df

    def distribution(self, df: DataFrame) -> DataFrame:
        """Adds ``p``: each row's probabilities in :attr:`bins`."""
        if self.bins is None:
            raise RuntimeError("transform before fit")
        df = self.aligned(df)
        rows = df.withColumn("masses", vector([0.0, 1.0, 0.0])) if self.constant is not None else self._distribution(df)
        return rows.withColumn("p", H.probabilities("masses", self.bins)).drop("masses")

    def transform(self, df: DataFrame, output: str = "density", *, grid: Grid | None = None, values=(), levels=(), confidence: float = 0.68, point: str = "mode") -> DataFrame:
        """``output``: density, pdf, cdf, quantiles, interval, pit or point. The CDF is native: it includes mass below the grid."""
        grid, rows = grid or self.grid, self.distribution(df)
        build = self._outputs(grid, values, levels, confidence)
        if output == "point":
            rows = rows.withColumn("_d", build["density"]())
            return rows.withColumn(output, points.estimate("_d", grid, point)).drop("p", "_d", "_knots")
        if output not in build:
            raise ValueError(f"output must be one of {[*build, 'point']}")
        return rows.withColumn(output, build[output]()).drop("p", "_knots")

    def _outputs(self, grid: Grid, values, levels, confidence: float) -> dict[str, Callable[[], Column]]:
        """What can be asked of the column ``p``."""
        b = self.bins
        return {
            "density": lambda: H.on_grid("p", b, grid),
            "pdf": lambda: H.pdf_values("p", b, values),
            "cdf": lambda: H.cdf_values("p", b, values),
            "quantiles": lambda: H.ppf("p", b, levels),
            "interval": lambda: H.interval("p", b, confidence),
            "pit": lambda: H.cdf_at("p", b, F.col(self.y)),
        }

    def scores(self, df: DataFrame, point: str = "mode", grid: Grid | None = None) -> DataFrame:
        grid = grid or self.grid
        dense = self.transform(df, "density", grid=grid)
        return object_scores(dense, "density", self.y, grid, point).drop("density")

    def evaluate(self, df: DataFrame, point: str = "mode", by: Sequence[str] = (), **options) -> DataFrame:
        """The report of the model on labelled rows."""
        keep = dict.fromkeys([*by, self.y, "y_pred", "cde", "pit", "crps", "nll"])
        return summarize(self.scores(df, point).select(*keep), self.y, "y_pred", by, point=point, **options)

    def score(self, df: DataFrame) -> float:
        """Minus the CDE loss: larger is better."""
        return -self.scores(df).agg(F.avg("cde")).first()[0]


@dataclasses.dataclass
class QuantileModel(DensityModel):
    """A model that predicts quantiles at shared levels: those of the key's context rows."""

    levels: Sequence[float] = tuple(i / 20 for i in range(1, 20))

    def _fit(self, df: DataFrame, low: float, high: float) -> None:
        self.bins = Bins((low, high))
        self.table = exact_quantiles(df, self.y, self.levels, self.keys).select(*self.keys, F.col("q").alias("masses"))
        self.marginal = list(exact_quantiles(df, self.y, self.levels).first()["q"])

    def distribution(self, df: DataFrame) -> DataFrame:
        """Adds ``p``, each row's quantiles at :attr:`levels`, and the CDF's corners ``_knots``."""
        if self.bins is None:
            raise RuntimeError("transform before fit")
        df = self.aligned(df)
        if self.constant is not None:
            rows = df.withColumn("p", vector([self.constant] * len(self.levels)))
        else:
            rows = self._distribution(df).withColumn("p", Q.monotone("masses")).drop("masses")
        return rows.withColumn("_knots", Q.knots("p", self.levels))

    def _outputs(self, grid: Grid, values, levels, confidence: float) -> dict[str, Callable[[], Column]]:
        own, knots = self.levels, "_knots"
        tail = 0.5 * (1.0 - confidence)
        return {
            "density": lambda: Q.on_grid(knots, own, grid),
            "pdf": lambda: F.transform(vector(values), lambda x: Q.pdf_at(F.col("p"), own, x)),
            "cdf": lambda: Q.cdf_values(knots, own, values),
            "quantiles": lambda: Q.ppf(knots, own, levels),
            "interval": lambda: let(Q.ppf(knots, own, [tail, 1.0 - tail]), lambda q: F.struct(q[0].alias("lo"), q[1].alias("hi"))),
            "pit": lambda: Q.cdf_at(knots, own, F.col(self.y)),
        }


@dataclasses.dataclass
class MixtureModel(DensityModel):
    """A weighted mixture of histogram models, in one row.

    The members' bins are known once they are fitted, so a row's mixture is one
    histogram on the union of all edges: nothing is exploded or shuffled.
    """

    members: Sequence[DensityModel] = ()
    weights: Sequence[float] = ()

    def _fit(self, df: DataFrame, low: float, high: float) -> None:
        if len(self.weights) not in (0, len(self.members)) or not self.members or any(w < 0 for w in self.weights):
            raise ValueError("a mixture needs members, and a weight >= 0 for each")
        for m in self.members:
            m.fit(df)
        self.bins = union_bins([m.bins for m in self.members])

    def distribution(self, df: DataFrame) -> DataFrame:
        """Adds ``p``: each row's probabilities in :attr:`bins`. Every member finds its own columns."""
        if self.bins is None:
            raise RuntimeError("transform before fit")
        if self.constant is not None:
            return df.withColumn("p", vector([0.0, 1.0, 0.0]))
        weights = list(self.weights) or [1.0] * len(self.members)
        share = [w / sum(weights) for w in weights]
        names = [f"_m{i}" for i in range(len(self.members))]
        for m, name in zip(self.members, names, strict=True):
            df = m.distribution(df).withColumnRenamed("p", name)
        masses = kernels.mixed_masses([F.col(n) for n in names], [m.bins.array for m in self.members], share, self.bins.array)
        return df.withColumn("p", masses).drop(*names)
