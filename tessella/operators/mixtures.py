"""Mixtures of histograms whose buckets differ, and operations over a row's few members.

Long form: one row per (id, component) with its masses; the buckets and the
weight of each component are shared by all ids and live in :class:`Part`. A
row has as many members as there are parts, so collecting a row's members is
bounded by the plan, never by the data.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions import histogram as H, kernels
from tessella.functions.arrays import fold_arrays, let, total, vector
from tessella.functions.grids import Bins, Grid, union_bins
from tessella.operators.metrics import side_by_side


@dataclasses.dataclass(frozen=True)
class Part:
    """One component: its key in the table, its buckets and its weight."""

    key: str
    bins: Bins
    weight: float = 1.0


def normalized(parts: Sequence[Part]) -> list[Part]:
    w = np.asarray([p.weight for p in parts], dtype=float)
    if not np.isfinite(w).all() or (w < 0).any() or not w.sum() > 0:
        raise ValueError("weights must be finite, non-negative, with a positive sum")
    return [dataclasses.replace(p, weight=float(x)) for p, x in zip(parts, w / w.sum())]


@dataclasses.dataclass(frozen=True)
class Mixture:
    """A long table ``(id, component, masses, ...)`` and its parts."""

    df: DataFrame
    parts: tuple[Part, ...]
    id: str = "id"
    component: str = "component"
    masses: str = "masses"

    def __post_init__(self) -> None:
        object.__setattr__(self, "parts", tuple(normalized(self.parts)))

    @property
    def bins(self) -> Bins:
        return union_bins([p.bins for p in self.parts])

    def incomplete(self) -> DataFrame:
        """Ids that do not have every component exactly once."""
        n = F.countDistinct(self.component)
        return self.df.groupBy(self.id).agg(n.alias("n_components"), F.count("*").alias("n_rows")).where(
            (F.col("n_components") != len(self.parts)) | (F.col("n_rows") != len(self.parts)))

    def _each(self, build: Callable[[Column, Part], Column]) -> Column:
        """``build(p, part)`` chosen by the row's component."""
        out = None
        for part in self.parts:
            value, test = build(F.col("_p"), part), F.col(self.component) == F.lit(part.key)
            out = F.when(test, value) if out is None else out.when(test, value)
        return out

    def _rows(self) -> DataFrame:
        p = None
        for part in self.parts:
            value, test = H.probabilities(self.masses, part.bins), F.col(self.component) == F.lit(part.key)
            p = F.when(test, value) if p is None else p.when(test, value)
        return self.df.withColumn("_p", p)

    def _weight(self) -> Column:
        """The row's weight; NULL for a component that the mixture does not have."""
        return self._each(lambda _, part: F.lit(part.weight))

    def _sum(self, build: Callable[[Column, Part], Column], name: str, keep: Sequence[str] = ()) -> DataFrame:
        """Weighted over the components that an id has, by their share of its weights: one that lacks some is renormalized."""
        rows = self._rows().withColumns({"_v": self._each(lambda p, part: build(p, part) * F.lit(part.weight)), "_w": self._weight()})
        first = [F.first(c).alias(c) for c in keep]
        return rows.groupBy(self.id).agg((F.sum("_v") / F.sum("_w")).alias(name), *first)

    def pdf(self, x: Column, name: str = "pdf") -> DataFrame:
        return self._sum(lambda p, part: H.pdf_at(p, part.bins, x), name)

    def cdf(self, x: Column, name: str = "cdf") -> DataFrame:
        """At a shared value or at a row's own (its PIT)."""
        out = self._sum(lambda p, part: H.cdf_at(p, part.bins, x), name)
        return out.withColumn(name, F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(1.0)))

    def atoms(self, x: Column, name: str = "atom") -> DataFrame:
        return self._sum(lambda p, part: H.atom_at(p, part.bins, x), name)

    def moments(self) -> DataFrame:
        """Mean and variance: each part's variance plus its mean's squared distance from the mixture's."""
        rows = self._rows().withColumn("_m", self._each(lambda p, part: F.struct(
            F.lit(part.weight).alias("w"), H.mean(p, part.bins).alias("m"), H.var(p, part.bins).alias("v"))))
        members = F.array_sort(F.filter(F.collect_list("_m"), lambda t: t["w"].isNotNull()))
        one = rows.groupBy(self.id).agg(members.alias("_m"))
        share = F.aggregate("_m", F.lit(0.0), lambda s, t: s + t["w"])
        one = one.withColumn("_m", let(share, lambda all_: F.transform("_m", lambda t: F.struct((t["w"] / all_).alias("w"), t["m"].alias("m"), t["v"].alias("v")))))
        return one.withColumn("mean", F.aggregate("_m", F.lit(0.0), lambda s, t: s + t["w"] * t["m"])).withColumn(
            "var", let(F.col("mean"), lambda mu: F.aggregate("_m", F.lit(0.0), lambda s, t: (
                s + t["w"] * (t["v"] + (t["m"] - mu) * (t["m"] - mu)))))).drop("_m")

    def to_histogram(self, target: Bins | None = None, name: str = "masses", keep: Sequence[str] = ()) -> DataFrame:
        """Exact masses on the union of the edges, or on the edges given."""
        target = target or self.bins
        rows = self._rows().withColumn("_v", self._each(lambda p, part: F.transform(
            H.regrid(p, part.bins, target), lambda m: m * F.lit(part.weight)))).withColumn("_w", self._weight())
        held = rows.where(F.col("_w").isNotNull())
        found = sum_members(held.withColumn("_v", F.concat("_v", F.array("_w"))), self.id, "_v", target.n + 1, name, self.component, keep)
        # The last element is the weight that the id's components have together.
        return found.withColumn(name, let(F.col(name), lambda a: let(F.element_at(a, -1), lambda w: F.transform(F.slice(a, 1, target.n), lambda m: m / w))))

    def on_grid(self, grid: Grid, name: str = "density") -> DataFrame:
        """Bin densities averaged unnormalized, then normalized once."""
        raw = self.to_histogram(grid, "_m")
        return raw.withColumn(name, grid.normalize(F.zip_with("_m", vector(grid.widths), lambda m, w: m / w))).drop("_m")

    def quantiles(self, levels: Sequence[float], name: str = "q") -> DataFrame:
        h = self.to_histogram(name="_m").withColumn("_p", H.probabilities("_m", self.bins))
        return h.withColumn(name, H.ppf("_p", self.bins, levels)).drop("_m", "_p")

    def mode(self, name: str = "mode") -> DataFrame:
        h = self.to_histogram(name="_m").withColumn("_p", H.probabilities("_m", self.bins))
        return h.withColumn(name, H.mode("_p", self.bins)).drop("_m", "_p")


def one_row(members: Sequence[Column], parts: Sequence[Part], target: Bins | None = None, raw: bool = False) -> Column:
    """Exact masses of a mixture whose members lie side by side in one row, on the union of their edges or on ``target``.

    ``members`` are columns of probabilities, one per part. The running sums
    are read at the target's edges and added up in one kernel: no array is
    shuffled and nothing is collected. A row that lacks a member is NULL. With
    ``raw`` the members are masses of any sum.
    """
    if len(members) != len(parts):
        raise ValueError(f"{len(members)} members for {len(parts)} parts")
    held = normalized(parts)
    edges = (target or union_bins([p.bins for p in held])).array
    return kernels.mixed_masses(list(members), [p.bins.array for p in held], [p.weight for p in held], edges, raw)


def sum_members(
    df: DataFrame, id_col: str, array: str, size: int, name: str, order: str, keep: Sequence[str] = (),
) -> DataFrame:
    """Elementwise sum over a row's members, in member order, without exploding the arrays."""
    members = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(array).alias("a"))))
    grouped = df.groupBy(id_col).agg(members.alias("_l"), *[F.first(c).alias(c) for c in keep])
    return grouped.withColumn(name, fold_arrays(F.transform("_l", lambda t: t["a"]), size)).drop("_l")


def flatten(parts: Sequence[tuple[float, Sequence[Part]]]) -> list[Part]:
    """A mixture of mixtures as one list of parts, weights multiplied."""
    return [
        dataclasses.replace(p, weight=p.weight * w / total_weight)
        for w, inner in parts
        for total_weight in [sum(x.weight for x in inner)]
        for p in inner
    ]


def same_buckets(parts: Sequence[Part]) -> bool:
    """Whether the mixture is one histogram: every part has the same edges."""
    return len({p.bins.edges for p in parts}) == 1


def combine(mixture: Mixture, name: str = "masses") -> tuple[DataFrame, Bins] | Mixture:
    """One histogram when all buckets agree (a plain weighted sum), else the mixture itself."""
    if same_buckets(mixture.parts):
        bins = mixture.parts[0].bins
        return mixture.to_histogram(bins, name), bins
    return mixture


def concatenate(parts: Sequence[tuple[DataFrame, Bins | tuple]]) -> tuple[DataFrame, Bins | tuple]:
    """Stacks tables of one kind; refuses other buckets or levels. Metadata that a part lacks is dropped."""
    frame, spec = parts[0]
    for other, s in parts[1:]:
        if type(s) is not type(spec):
            raise TypeError("cannot concatenate different kinds of distribution")
        if s != spec:
            raise ValueError("parts must share their buckets or levels")
        frame = frame.select(*[c for c in frame.columns if c in other.columns])
        frame = frame.unionByName(other.select(*frame.columns))
    return frame, spec


def quantile_average(df: DataFrame, id_col: str, locs: str, n_levels: int, weights: dict[str, float], member: str, name: str = "locs") -> DataFrame:
    """The weighted average of quantile functions at shared levels; a row must have every member once, and no other."""
    share = sum(weights.values())
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v / share))])
    own = F.coalesce(w[F.col(member)], F.raise_error(F.concat(F.lit("no weight for member "), F.coalesce(F.col(member).cast("string"), F.lit("NULL")))).cast("double"))
    rows = df.withColumn("_v", let(own, lambda x: F.concat(F.transform(locs, lambda q: q * x), F.array(F.lit(1.0)))))
    found = sum_members(rows, id_col, "_v", n_levels + 1, name, member)
    # The last element counts the members.
    whole = F.when(F.element_at(name, -1) == len(weights), F.slice(name, 1, n_levels))
    return found.withColumn(name, F.coalesce(whole, F.raise_error(F.lit("a row lacks a member or has one twice")).cast("array<double>")))


def trimmed_average(df: DataFrame, id_col: str, locs: str, n_levels: int, trim: float, name: str = "locs") -> DataFrame:
    """Per level, the mean without the lowest and highest ``int(trim * K)`` members."""
    if not 0.0 <= trim < 0.5:
        raise ValueError("trim must be in [0, 0.5)")
    grouped = df.groupBy(id_col).agg(F.collect_list(locs).alias("_l"))

    def level(rows: Column, i: Column) -> Column:
        cut = F.floor(F.size(rows) * F.lit(trim)).cast("int")
        values = F.sort_array(F.transform(rows, lambda a: F.get(a, i)))
        kept = F.slice(values, cut + 1, F.size(rows) - cut * 2)
        return let(kept, lambda k: total(k) / F.size(k))

    out = let(F.col("_l"), lambda rows: F.transform(F.sequence(F.lit(0), F.lit(n_levels - 1)), lambda i: level(rows, i)))
    return grouped.select(id_col, out.alias(name))


def regrid_rows(df: DataFrame, id_col: str, bins: str, masses: str, grid: Grid, spark=None) -> DataFrame:
    """Re-bins rows that carry their own edges: ``(id, bin, mass)`` for the bins they touch.

    Each bucket names the grid bins it overlaps by arithmetic, so the match is
    an equi-join on the bin, not a range join.
    """
    total_mass = F.aggregate(masses, F.lit(0.0), lambda s, x: s + x)
    buckets = F.zip_with(
        F.arrays_zip(F.slice(bins, F.lit(1), F.size(masses)).alias("lo"), F.slice(bins, F.lit(2), F.size(masses)).alias("hi")),
        F.col(masses), lambda t, m: F.struct(t["lo"].alias("lo"), t["hi"].alias("hi"), m.alias("m")))
    # total_mass is one value per row, put in its own column before the explode.
    rows = df.select(id_col, buckets.alias("_t"), total_mass.alias("_n")).select(id_col, F.explode("_t").alias("t"), "_n")
    rows = rows.where("t.m > 0").select(id_col, "t.lo", "t.hi", (F.col("t.m") / F.col("_n")).alias("m"))
    first, last = grid.bin_index(F.col("lo")), grid.bin_index(F.col("hi"))
    meets = (F.col("hi") >= grid.edges[0]) & (F.col("lo") <= grid.edges[-1])
    touched = rows.where(meets).withColumn("bin", F.explode(F.sequence(first, last)))
    spark = df.sparkSession
    dim = grid.table(spark).select("bin", F.col("lo").alias("glo"), F.col("hi").alias("ghi"))
    wide = F.greatest(F.lit(0.0), F.least("hi", "ghi") - F.greatest("lo", "glo"))
    share = F.when(F.col("hi") > F.col("lo"), F.try_divide(wide, F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0))
    # The grid has one row per bin, a driver-side list: small by construction.
    joined = touched.join(F.broadcast(dim), "bin")
    return joined.groupBy(id_col, "bin").agg(F.sum(F.col("m") * share).alias("mass")).where("mass > 0")


def align(tables: Sequence[DataFrame], id_col: str = "id") -> DataFrame:
    """K prediction tables of the same rows side by side (columns must differ in name); rows that lack in one are refused."""
    return side_by_side(tables, id_col)
