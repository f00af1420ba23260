"""Queries of the grid, histogram, quantile, mixture and common distribution operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Observation, functions as F

from tessella.functions import histogram as H, points as P, quantile as Q
from tessella.functions.arrays import vector
from tessella.functions.grids import Bins, Grid, default_grid, quantile_native_grid, target_range
from tessella.functions.uniform import hash_uniform
from tessella.operators import features as FE, mixtures as MX
from tessella.plans import inputs as I
from tessella.plans.inputs import rounded as r
from tessella.plans.registry import query
from tessella.session import scratch

OTHER = Bins(tuple(np.linspace(20.0, 420.0, 26)))  # 25 buckets that cut across the source's
VALUES = (0.0, 15.0, 37.5, 100.0, 480.0, 500.0)
QLEVELS = (0.0, 0.1, 0.5, 0.84, 1.0)


def users(spark, sf) -> DataFrame:
    return I.user_histograms(spark, sf).withColumn("p", H.probabilities("masses", I.GRID))


def per_event(spark, sf) -> DataFrame:
    return I.event_predictions(spark, sf).withColumn("p", H.probabilities("masses", I.GRID))


def long(df: DataFrame, key: str, array: str, name: str) -> DataFrame:
    return df.select(key, F.posexplode(array).alias("bin", name)).select(key, F.col("bin").cast("long").alias("bin"), r(name).alias(name))


# -- grids -------------------------------------------------------------------------


@query("g3_bin_table", f"""WITH {I.EV}, {I.grid_sql()}
SELECT CAST(bin AS BIGINT) AS bin, lo, hi, c AS center, w AS width, count(id) AS n FROM g LEFT JOIN ev ON {I.bin_sql('y')} = bin GROUP BY ALL""")
def g3(spark, sf):
    placed = I.events(spark, sf).groupBy(I.GRID.bin_index(F.col("y")).alias("bin")).agg(F.count("*").alias("n"))
    return I.GRID.table(spark).join(placed, "bin", "left").select(
        F.col("bin").cast("long").alias("bin"), "lo", "hi", "center", "width", F.coalesce("n", F.lit(0)).alias("n"))


DIRTY = f"""{I.USER}, d AS (SELECT usr, bin, c, CASE WHEN (usr + bin) % 7 = 0 THEN 0.0 ELSE greatest(m, 0) END AS x FROM h),
e AS (SELECT *, 10.0 * CASE WHEN bin IN (0, 49) THEN 0.5 ELSE 1 END AS tw FROM d)"""


def dirty(spark, sf) -> DataFrame:
    """Densities with NaN, infinite and negative cells, by position."""
    bad = F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(-3.0))
    return I.user_histograms(spark, sf).select("usr", F.transform("masses", lambda x, i: (
        F.when((F.col("usr") + i) % 7 == 0, F.element_at(bad, (i % 3 + 1).cast("int"))).otherwise(x))).alias("pdf"))


@query("g5_normalize_trapezoid", f"{DIRTY} SELECT usr, CAST(bin AS BIGINT) AS bin, round(x / sum(x * tw) OVER (PARTITION BY usr), 8) AS density FROM e")
def g5_trapezoid(spark, sf):
    d = dirty(spark, sf).select("usr", I.TRAPEZOID.normalize("pdf").alias("density"))
    return d.select("usr", F.posexplode("density").alias("bin", "x")).select("usr", F.col("bin").cast("long").alias("bin"), r("x", 8).alias("density"))


@query("g5_normalize_histogram", f"{DIRTY} SELECT usr, CAST(bin AS BIGINT) AS bin, round(x / sum(x * 10.0) OVER (PARTITION BY usr), 8) AS density FROM e")
def g5_histogram(spark, sf):
    d = dirty(spark, sf).select("usr", I.GRID.normalize("pdf").alias("density"))
    return d.select("usr", F.posexplode("density").alias("bin", "x")).select("usr", F.col("bin").cast("long").alias("bin"), r("x", 8).alias("density"))


@query("g6_normalization_error", f"""{I.USER} SELECT usr, round(abs(sum(m * 10.0 * CASE WHEN bin IN (0, 49) THEN 0.5 ELSE 1 END) - 1), 4) AS trapezoid,
round(abs(sum(m * w) - 1), 4) AS histogram FROM h GROUP BY usr""")
def g6(spark, sf):
    return I.user_histograms(spark, sf).select(
        "usr", r(I.TRAPEZOID.normalization_error("masses"), 4).alias("trapezoid"), r(I.GRID.normalization_error("masses"), 4).alias("histogram"))


@query("g7_cdf_at_centers", f"""{I.USER}, t AS (SELECT *, m / sum(m * 10.0 * CASE WHEN bin IN (0, 49) THEN 0.5 ELSE 1 END) OVER (PARTITION BY usr) AS d FROM h),
u AS (SELECT usr, bin, coalesce((d + lag(d) OVER (PARTITION BY usr ORDER BY bin)) / 2 * 10.0, 0) AS inc FROM t)
SELECT usr, CAST(bin AS BIGINT) AS bin, round(f0 + p / 2, 8) AS histogram,
  round(sum(inc) OVER (PARTITION BY usr ORDER BY bin), 8) AS trapezoid FROM p JOIN u USING (usr, bin)""")
def g7(spark, sf):
    df = I.user_histograms(spark, sf).withColumn("a", I.GRID.normalize("masses")).withColumn("b", I.TRAPEZOID.normalize("masses"))
    df = df.select("usr", I.GRID.cdf("a").alias("a"), I.TRAPEZOID.cdf("b").alias("b"))
    both = df.select("usr", F.posexplode(F.arrays_zip("a", "b")).alias("bin", "t"))
    return both.select("usr", F.col("bin").cast("long").alias("bin"), r("t.a", 8).alias("histogram"), r("t.b", 8).alias("trapezoid"))


@query("g8_bin_index", f"WITH {I.EV} SELECT o.o_orderkey AS id, CAST({I.bin_sql('coalesce(y, 0)', 20.0, 300.0, 28)} AS BIGINT) AS bin, CAST({I.bin_sql('o.o_totalprice', 0.0, 500000.0, 40)} AS BIGINT) AS price_bin FROM orders o LEFT JOIN ev ON o.o_orderkey = ev.id")
def g8(spark, sf):
    """Every order, with the event of the same number where there is one."""
    grid = Grid.linear(20.0, 300.0, 28)
    orders = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return orders.join(I.events(spark, sf).select("id", "y"), "id", "left").select(
        "id", grid.bin_index(F.coalesce("y", F.lit(0.0))).cast("long").alias("bin"), I.PRICE_GRID.bin_index(F.col("o_totalprice")).cast("long").alias("price_bin"))


@query("g12_default_grid", f"""WITH {I.EV}, a AS (SELECT min(y) AS lo, max(y) AS hi FROM ev),
b AS (SELECT lo - 0.05 * (hi - lo) AS s, hi + 0.05 * (hi - lo) AS e FROM a),
x AS (SELECT CAST(least(greatest(floor((y - s) / ((e - s) / 200)), 0), 199) AS BIGINT) AS bin FROM ev, b)
SELECT bin, count(*) AS n FROM x GROUP BY bin""")
def g12(spark, sf):
    ev = I.events(spark, sf)
    grid = default_grid(*target_range(ev, "y"))
    return ev.groupBy(grid.bin_index(F.col("y")).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("g13_quantile_native_grid", """WITH a AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT lo - 0.25 * (hi - lo) AS s, hi + 0.25 * (hi - lo) AS e FROM a),
x AS (SELECT CAST(least(greatest(floor((o_totalprice - s) / ((e - s) / 1500)), 0), 1499) AS BIGINT) AS bin FROM orders, b)
SELECT bin, count(*) AS n FROM x GROUP BY bin""")
def g13(spark, sf):
    o = I.table(spark, sf, "orders")
    grid = quantile_native_grid(*target_range(o, "o_totalprice"))
    return o.groupBy(grid.bin_index(F.col("o_totalprice")).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("g14_union_edges", f"WITH {I.EV} SELECT DISTINCT round(unnest(quantile_cont(y, [0.0, 0.25, 0.5, 0.75, 1.0])), 9) AS edge FROM ev GROUP BY key")
def g14(spark, sf):
    """Each type's equal-mass edges, united: a distinct over exploded edges, not one gathered list."""
    from tessella.operators.ranks import exact_quantiles
    parts = exact_quantiles(I.events(spark, sf), "y", [0.0, 0.25, 0.5, 0.75, 1.0], ["key"])
    return parts.select(F.explode("q").alias("e")).select(r("e", 9).alias("edge")).distinct()


# -- histograms --------------------------------------------------------------------


@query("h1_invalid_rows", f"{I.USER} SELECT usr, bool_or(m < 0) OR count(*) <> 50 OR bool_or((usr % 11 = 3) AND bin = 5) AS invalid FROM h GROUP BY usr")
def h1(spark, sf):
    df = I.user_histograms(spark, sf).withColumn("masses", F.transform("masses", lambda x, i: (
        F.when((F.col("usr") % 11 == 3) & (i == 5), F.lit(-1.0)).otherwise(x))))
    return df.select("usr", H.invalid_masses("masses", I.GRID).alias("invalid"))


@query("h2_probabilities", f"""{I.ATOMS}, z AS (SELECT sup, bin, w, CASE WHEN sup % 5 = 0 THEN 0.0 ELSE m END AS m FROM h)
SELECT sup, CAST(bin AS BIGINT) AS bin, round(CASE WHEN sum(m) OVER (PARTITION BY sup) > 0 THEN m / sum(m) OVER (PARTITION BY sup)
  WHEN w > 0 THEN 0.25 ELSE 0 END, 8) AS p FROM z""")
def h2(spark, sf):
    df = I.supplier_atoms(spark, sf).withColumn("masses", F.when(F.col("sup") % 5 == 0, vector(np.zeros(5))).otherwise(F.col("masses")))
    out = df.select("sup", F.posexplode(H.probabilities("masses", I.ATOM_BINS)).alias("bin", "p"))
    return out.select("sup", F.col("bin").cast("long").alias("bin"), r("p", 8).alias("p"))


@query("h3_pdf_values", f"""{I.USER}, v AS (SELECT unnest({list(VALUES)})::DOUBLE AS x)
SELECT usr, x, round(sum(CASE WHEN (x >= lo AND x < hi) OR (x = 500 AND bin = 49) THEN p / w ELSE 0 END), 9) AS pdf FROM p CROSS JOIN v GROUP BY usr, x""")
def h3(spark, sf):
    pairs = F.arrays_zip(vector(VALUES).alias("x"), H.pdf_values("p", I.GRID, VALUES).alias("d"))
    return users(spark, sf).select("usr", F.explode(pairs).alias("t")).select("usr", "t.x", r("t.d", 9).alias("pdf"))


@query("h3_pdf_at_truth", f"{I.USER} SELECT e.id, round(p.p / p.w, 9) AS pdf FROM ev e JOIN p ON p.usr = e.usr AND p.bin = {I.bin_sql('e.y')}")
def h3_at(spark, sf):
    return per_event(spark, sf).select("id", r(H.pdf_at("p", I.GRID, F.col("y")), 9).alias("pdf"))


CDF = "sum(p * least(greatest((x - lo) / w, 0), 1))"


@query("h4_cdf_values", f"""{I.USER}, v AS (SELECT unnest({list(VALUES)})::DOUBLE AS x)
SELECT usr, x, round({CDF}, 8) AS cdf FROM p CROSS JOIN v GROUP BY usr, x""")
def h4(spark, sf):
    pairs = F.arrays_zip(vector(VALUES).alias("x"), H.cdf_values("p", I.GRID, VALUES).alias("f"))
    return users(spark, sf).select("usr", F.explode(pairs).alias("t")).select("usr", "t.x", r("t.f", 8).alias("cdf"))


@query("h4_cdf_point_mass", f"""{I.ATOMS}, v AS (SELECT unnest([5.0, 25.0, 24.999, 31.0, 50.0])::DOUBLE AS x)
SELECT sup, x, round(sum(p * CASE WHEN w = 0 THEN CAST(x >= lo AS INT) ELSE least(greatest((x - lo) / w, 0), 1) END), 8) AS cdf FROM p CROSS JOIN v GROUP BY sup, x""")
def h4_atoms(spark, sf):
    xs = [5.0, 25.0, 24.999, 31.0, 50.0]
    df = I.supplier_atoms(spark, sf).withColumn("p", H.probabilities("masses", I.ATOM_BINS))
    pairs = F.arrays_zip(vector(xs).alias("x"), H.cdf_values("p", I.ATOM_BINS, xs).alias("f"))
    return df.select("sup", F.explode(pairs).alias("t")).select("sup", "t.x", r("t.f", 8).alias("cdf"))


@query("h5_pit", f"{I.USER} SELECT e.id, round(p.f0 + p.p * (e.y - p.lo) / p.w, 8) AS pit FROM ev e JOIN p ON p.usr = e.usr AND p.bin = {I.bin_sql('e.y')}")
def h5(spark, sf):
    return per_event(spark, sf).select("id", r(H.cdf_at("p", I.GRID, F.col("y")), 8).alias("pit"))


def ppf_sql(source: str, key: str, levels) -> str:
    return f"""lv AS (SELECT unnest({list(levels)})::DOUBLE AS level),
held AS (SELECT {key}, min(lo) FILTER (p > 0) AS first, max(hi) FILTER (p > 0) AS last FROM {source} GROUP BY {key}),
qv AS (SELECT {key}, level, CASE WHEN level <= 0 THEN any_value(first) WHEN level >= 1 THEN any_value(last)
  ELSE min(lo + least(greatest((level - f0) / p, 0), 1) * (hi - lo)) FILTER (p > 0 AND f1 >= level) END AS q
  FROM {source} JOIN held USING ({key}) CROSS JOIN lv GROUP BY {key}, level)"""


@query("h6_ppf", f"{I.USER}, {ppf_sql('p', 'usr', QLEVELS)} SELECT usr, level, round(q, 6) AS q FROM qv")
def h6(spark, sf):
    df = users(spark, sf).withColumn("q", H.ppf("p", I.GRID, QLEVELS))
    return df.select("usr", F.explode(F.arrays_zip(vector(QLEVELS).alias("level"), "q")).alias("t")).select("usr", "t.level", r("t.q").alias("q"))


@query("h7_moments", f"""{I.USER}, m AS (SELECT usr, sum(p * c) AS mu FROM p GROUP BY usr)
SELECT usr, round(any_value(mu), 6) AS mean, round(sum(p * ((c - mu) * (c - mu) + w * w / 12)), 5) AS var,
  round(sqrt(sum(p * ((c - mu) * (c - mu) + w * w / 12))), 6) AS std FROM p JOIN m USING (usr) GROUP BY usr""")
def h7(spark, sf):
    return users(spark, sf).select("usr", r(H.mean("p", I.GRID)).alias("mean"), r(H.var("p", I.GRID), 5).alias("var"), r(H.std("p", I.GRID)).alias("std"))


@query("h8_mode", f"{I.USER} SELECT usr, arg_max(c, p / w) AS mode FROM p GROUP BY usr")
def h8(spark, sf):
    return users(spark, sf).select("usr", H.mode("p", I.GRID).alias("mode"))


@query("h8_mode_point_mass", f"{I.ATOMS} SELECT sup, arg_max(c, [p / w, -bin]) AS mode FROM p WHERE w > 0 GROUP BY sup")
def h8_atoms(spark, sf):
    df = I.supplier_atoms(spark, sf).withColumn("p", H.probabilities("masses", I.ATOM_BINS))
    return df.select("sup", H.mode("p", I.ATOM_BINS).alias("mode"))


@query("h9_atoms", f"{I.ATOMS} SELECT sup, round(sum(p) FILTER (w = 0 AND lo = 25), 8) AS at25, 0.0::DOUBLE AS at30 FROM p GROUP BY sup")
def h9(spark, sf):
    df = I.supplier_atoms(spark, sf).withColumn("p", H.probabilities("masses", I.ATOM_BINS))
    a = H.atoms("p", I.ATOM_BINS, [25.0, 30.0])
    return df.select("sup", r(F.element_at(a, 1), 8).alias("at25"), F.element_at(a, 2).alias("at30"))


OTHER_SQL = I.grid_sql("o", 20.0, 420.0, 25)


@query("h10_histogramize", f"""{I.USER}, {OTHER_SQL}
SELECT usr, CAST(o.bin AS BIGINT) AS bin, round(sum(p * greatest(least(p.hi, o.hi) - greatest(p.lo, o.lo), 0) / p.w), 8) AS mass FROM p CROSS JOIN o GROUP BY usr, o.bin""")
def h10(spark, sf):
    out = users(spark, sf).select("usr", F.posexplode(H.regrid("p", I.GRID, OTHER)).alias("bin", "m"))
    return out.select("usr", F.col("bin").cast("long").alias("bin"), r("m", 8).alias("mass"))


@query("h10_outside", f"{I.USER} SELECT usr, round(sum(p * least(20 - lo, w) / w) FILTER (lo < 20) + sum(p * (hi - greatest(lo, 420)) / w) FILTER (hi > 420), 8) AS outside FROM p GROUP BY usr")
def h10_outside(spark, sf):
    return users(spark, sf).select("usr", r(H.outside("p", I.GRID, OTHER), 8).alias("outside"))


@query("h10_point_mass_on_edge", f"""{I.ATOMS}, t AS (SELECT * FROM (VALUES (0, 5.0, 25.0), (1, 25.0, 33.0), (2, 33.0, 50.0)) v(b, a, e))
SELECT sup, CAST(b AS BIGINT) AS bin, round(sum(p * CASE WHEN w = 0 THEN CAST(lo >= a AND lo < e AS INT) ELSE greatest(least(hi, e) - greatest(lo, a), 0) / w END), 8) AS mass FROM p CROSS JOIN t GROUP BY sup, b""")
def h10_atoms(spark, sf):
    df = I.supplier_atoms(spark, sf).withColumn("p", H.probabilities("masses", I.ATOM_BINS))
    out = df.select("sup", F.posexplode(H.regrid("p", I.ATOM_BINS, Bins((5.0, 25.0, 33.0, 50.0)))).alias("bin", "m"))
    return out.select("sup", F.col("bin").cast("long").alias("bin"), r("m", 8).alias("mass"))


@query("h11_on_grid", f"""{I.USER}, {OTHER_SQL}, m AS (SELECT usr, o.bin, sum(p * greatest(least(p.hi, o.hi) - greatest(p.lo, o.lo), 0) / p.w) / 16.0 AS d FROM p CROSS JOIN o GROUP BY usr, o.bin)
SELECT usr, CAST(bin AS BIGINT) AS bin, round(d / sum(d * 16.0 * CASE WHEN bin IN (0, 24) THEN 0.5 ELSE 1 END) OVER (PARTITION BY usr), 9) AS density FROM m""")
def h11(spark, sf):
    out = users(spark, sf).select("usr", F.posexplode(H.on_grid("p", I.GRID, Grid(OTHER.edges))).alias("bin", "d"))
    return out.select("usr", F.col("bin").cast("long").alias("bin"), r("d", 9).alias("density"))


@query("h11_own_edges", f"{I.USER} SELECT usr, CAST(bin AS BIGINT) AS bin, round(p / w, 9) AS density FROM p")
def h11_own(spark, sf):
    out = users(spark, sf).select("usr", F.posexplode(H.on_grid("p", I.GRID, I.GRID)).alias("bin", "d"))
    return out.select("usr", F.col("bin").cast("long").alias("bin"), r("d", 9).alias("density"))


@query("h12_softmax", f"""{I.USER}, z AS (SELECT usr, bin, ln(1 + m) / 0.9 AS z FROM h), e AS (SELECT usr, bin, exp(z - max(z) OVER (PARTITION BY usr)) AS e FROM z)
SELECT usr, CAST(bin AS BIGINT) AS bin, round(e / sum(e) OVER (PARTITION BY usr), 8) AS p FROM e""")
def h12(spark, sf):
    logits = I.user_histograms(spark, sf).select("usr", F.transform("masses", lambda m: F.log1p(m)).alias("z"))
    out = logits.select("usr", F.posexplode(H.softmax("z", 0.9)).alias("bin", "p"))
    return out.select("usr", F.col("bin").cast("long").alias("bin"), r("p", 8).alias("p"))


BORDERS = (-3.0, -1.0, -0.25, 0.0, 0.5, 1.5, 4.0)


@query("h13_scaled_borders", f"""WITH {I.EV}, s AS (SELECT key, avg(y) AS mu, stddev_samp(y) AS sd FROM ev GROUP BY key)
SELECT key, b AS border, round(b * sd + mu, 6) AS edge FROM s CROSS JOIN (SELECT unnest({list(BORDERS)})::DOUBLE AS b)""")
def h13(spark, sf):
    s = I.events(spark, sf).groupBy("key").agg(F.avg("y").alias("mu"), F.stddev_samp("y").alias("sd"))
    edges = F.arrays_zip(vector(BORDERS).alias("b"), H.scaled_borders(BORDERS, F.col("mu"), F.col("sd")).alias("e"))
    return s.select("key", F.explode(edges).alias("t")).select("key", F.col("t.b").alias("border"), r("t.e").alias("edge"))


@query("h14_point_mass", f"WITH {I.EV}, c AS (SELECT max(y) AS v FROM ev) SELECT id, round(v, 6) AS mean, 0.0::DOUBLE AS std, CAST(y >= v AS DOUBLE) AS pit FROM ev, c")
def h14(spark, sf):
    """A constant context (here its largest value): every row is a point mass on it."""
    ev = I.events(spark, sf)
    masses, bins = H.point_mass(target_range(ev, "y")[1])
    df = ev.withColumn("p", H.probabilities(masses, bins))
    return df.select("id", r(H.mean("p", bins)).alias("mean"), r(H.std("p", bins)).alias("std"), H.cdf_at("p", bins, F.col("y")).alias("pit"))


# -- quantile distributions -----------------------------------------------------------


def uq(spark, sf) -> DataFrame:
    return I.user_quantiles(spark, sf).withColumn("l", Q.monotone("locs")).withColumn("k", Q.knots("l", I.LEVELS))


def sq(spark, sf) -> DataFrame:
    return I.supplier_quantiles(spark, sf).withColumn("l", Q.monotone("locs")).withColumn("k", Q.knots("l", I.LEVELS))


@query("q1_monotone", f"{I.UQ} SELECT usr, i, round(max(v * CASE WHEN i % 4 = 0 THEN 0.5 ELSE 1 END) OVER (PARTITION BY usr ORDER BY i), 6) AS v FROM qq")
def q1(spark, sf):
    """Values with every fourth one halved, put back in order by the running maximum."""
    broken = F.transform("locs", lambda x, i: F.when((i + 1) % 4 == 0, x * 0.5).otherwise(x))
    out = I.user_quantiles(spark, sf).select("usr", F.posexplode(Q.monotone(broken)).alias("i", "v"))
    return out.select("usr", (F.col("i") + 1).cast("long").alias("i"), r("v").alias("v"))


@query("q2_tail_widths", f"{I.SQ} SELECT sup, round(below, 6) AS below, round(above, 6) AS above FROM tails")
def q2(spark, sf):
    return sq(spark, sf).withColumn("t", Q.tail_widths("l", I.LEVELS)).select("sup", r("t.below").alias("below"), r("t.above").alias("above"))


@query("q3_knots", f"{I.SQ} SELECT sup, CAST(i AS BIGINT) AS i, round(v, 6) AS v FROM k")
def q3(spark, sf):
    out = sq(spark, sf).select("sup", F.posexplode("k").alias("i", "v"))
    return out.select("sup", F.col("i").cast("long").alias("i"), r("v").alias("v"))


QCDF = "sum((l1 - l0) * CASE WHEN a = b THEN CAST(a <= x AS INT) ELSE least(greatest((x - a) / (b - a), 0), 1) END)"


@query("q4_pit", f"{I.UQ} SELECT e.id, round({QCDF.replace('x', 'e.y')}, 8) AS pit FROM ev e JOIN seg USING (usr) GROUP BY e.id")
def q4(spark, sf):
    df = I.events(spark, sf).join(uq(spark, sf), "usr")
    return df.select("id", r(Q.cdf_at("k", I.LEVELS, F.col("y")), 8).alias("pit"))


@query("q4_cdf_ties", f"{I.SQ}, v AS (SELECT unnest([0.0, 3.0, 10.5, 25.0, 40.0, 60.0])::DOUBLE AS x) SELECT sup, x, round({QCDF}, 8) AS cdf FROM seg CROSS JOIN v GROUP BY sup, x")
def q4_ties(spark, sf):
    xs = [0.0, 3.0, 10.5, 25.0, 40.0, 60.0]
    pairs = F.arrays_zip(vector(xs).alias("x"), Q.cdf_values("k", I.LEVELS, xs).alias("f"))
    return sq(spark, sf).select("sup", F.explode(pairs).alias("t")).select("sup", "t.x", r("t.f", 8).alias("cdf"))


@query("q5_pdf", f"""{I.UQ}, e AS (SELECT id, usr, y FROM ev)
SELECT id, round(sum(CASE WHEN b > a AND (CASE WHEN i = 0 THEN y >= a AND y < b WHEN i = 19 THEN y > a AND y <= b
  WHEN i = 18 THEN y >= a AND y <= b ELSE y >= a AND y < b END) THEN (l1 - l0) / (b - a) ELSE 0 END), 8) AS pdf FROM e JOIN seg USING (usr) GROUP BY id""")
def q5(spark, sf):
    df = I.events(spark, sf).join(uq(spark, sf), "usr")
    return df.select("id", r(Q.pdf_at("l", I.LEVELS, F.col("y")), 8).alias("pdf"))


@query("q6_ppf", f"""{I.UQ}, lv AS (SELECT unnest([0.0, 0.02, 0.33, 0.5, 0.97, 1.0])::DOUBLE AS level)
SELECT usr, level, round(min(a + (b - a) * (level - l0) / (l1 - l0)) FILTER (level >= l0 - 1e-12 AND level <= l1 + 1e-12), 6) AS q FROM seg CROSS JOIN lv GROUP BY usr, level""")
def q6(spark, sf):
    levels = [0.0, 0.02, 0.33, 0.5, 0.97, 1.0]
    pairs = F.arrays_zip(vector(levels).alias("level"), Q.ppf("k", I.LEVELS, levels).alias("q"))
    return uq(spark, sf).select("usr", F.explode(pairs).alias("t")).select("usr", "t.level", r("t.q").alias("q"))


@query("q7_moments", f"""{I.UQ}, m AS (SELECT usr, sum((l1 - l0) * (a + b) / 2) AS mu FROM seg GROUP BY usr)
SELECT usr, round(any_value(mu), 6) AS mean, round(sum((l1 - l0) * ((a-mu)*(a-mu) + (a-mu)*(b-mu) + (b-mu)*(b-mu)) / 3), 5) AS var FROM seg JOIN m USING (usr) GROUP BY usr""")
def q7(spark, sf):
    return uq(spark, sf).select("usr", r(Q.mean("k", I.LEVELS)).alias("mean"), r(Q.var("k", I.LEVELS), 5).alias("var"))


@query("q8_mode", f"{I.UQ} SELECT usr, round(arg_max((a + b) / 2, (l1 - l0) / (b - a)), 6) AS mode FROM seg WHERE b > a AND i BETWEEN 1 AND 18 GROUP BY usr")
def q8(spark, sf):
    """With even levels a tail borrows its neighbour's width, so it never wins."""
    return uq(spark, sf).select("usr", r(Q.mode("l", I.LEVELS)).alias("mode"))


@query("q9_atoms", f"{I.SQ}, v AS (SELECT unnest([10.0, 25.0, 26.0])::DOUBLE AS x) SELECT sup, x, round(sum(CASE WHEN a = b AND a = x THEN l1 - l0 ELSE 0 END), 8) AS atom FROM seg CROSS JOIN v GROUP BY sup, x")
def q9(spark, sf):
    xs = [10.0, 25.0, 26.0]
    cells = F.array(*[F.struct(F.lit(x).alias("x"), Q.atom_at("k", I.LEVELS, F.lit(x)).alias("a")) for x in xs])
    return sq(spark, sf).select("sup", F.explode(cells).alias("t")).select("sup", "t.x", r("t.a", 8).alias("atom"))


TEN = I.grid_sql("t", 0.0, 50.0, 10)
QMASS = """sum((l1 - l0) * CASE WHEN a = b THEN CAST(a >= lo AND (a < hi OR (bin = 9 AND a = hi)) AS INT)
  ELSE greatest(least(b, hi) - greatest(a, lo), 0) / (b - a) END)"""


@query("q10_histogramize", f"{I.SQ}, {TEN} SELECT sup, CAST(bin AS BIGINT) AS bin, round({QMASS}, 8) AS mass FROM seg CROSS JOIN t GROUP BY sup, bin")
def q10(spark, sf):
    out = sq(spark, sf).select("sup", F.posexplode(Q.regrid("k", I.LEVELS, Bins(tuple(np.linspace(0, 50, 11))))).alias("bin", "m"))
    return out.select("sup", F.col("bin").cast("long").alias("bin"), r("m", 8).alias("mass"))


@query("q10_on_grid", f"""{I.UQ}, {I.grid_sql()}, m AS (SELECT usr, bin, sum((l1 - l0) * CASE WHEN a = b THEN CAST(a >= lo AND a < hi AS INT) ELSE greatest(least(b, hi) - greatest(a, lo), 0) / (b - a) END) / 10.0 AS d FROM seg CROSS JOIN g GROUP BY usr, bin)
SELECT usr, CAST(bin AS BIGINT) AS bin, round(d / sum(d * 10.0) OVER (PARTITION BY usr), 8) AS density FROM m""")
def q10_grid(spark, sf):
    out = uq(spark, sf).select("usr", F.posexplode(Q.on_grid("k", I.LEVELS, I.GRID)).alias("bin", "d"))
    return out.select("usr", F.col("bin").cast("long").alias("bin"), r("d", 8).alias("density"))


@query("q10_without_tails", f"""{I.UQ}, {I.grid_sql()}, s2 AS (SELECT usr, l0, l1, a, b FROM seg WHERE i BETWEEN 1 AND 18
  UNION ALL SELECT usr, 0.0, 0.05, first, first FROM tails UNION ALL SELECT usr, 0.95, 1.0, last, last FROM tails),
m AS (SELECT usr, bin, sum((l1 - l0) * CASE WHEN a = b THEN CAST(a >= lo AND a < hi AS INT) ELSE greatest(least(b, hi) - greatest(a, lo), 0) / (b - a) END) AS d FROM s2 CROSS JOIN g GROUP BY usr, bin)
SELECT usr, CAST(bin AS BIGINT) AS bin, round(d, 8) AS mass FROM m""")
def q10_no_tails(spark, sf):
    out = uq(spark, sf).select("usr", F.posexplode(Q.regrid("l", I.LEVELS, I.GRID, tails=False)).alias("bin", "m"))
    return out.select("usr", F.col("bin").cast("long").alias("bin"), r("m", 8).alias("mass"))


def type_members(spark, sf) -> DataFrame:
    """Per user, one quantile row per event type: the user's members."""
    from tessella.operators.ranks import exact_quantiles
    return exact_quantiles(I.events(spark, sf), "y", I.LEVELS, ["usr", "key"]).select("usr", "key", F.col("q").alias("locs"))


MEMBERS = f"WITH {I.EV}, mq AS (SELECT usr, key, unnest(quantile_cont(y, {list(I.LEVELS)})) AS v, unnest(range(1, 20)) AS i FROM ev GROUP BY usr, key)"
KEYS = ("click", "error", "purchase", "signup", "view")
WEIGHTS = {k: float(i + 1) for i, k in enumerate(KEYS)}


@query("q11_average", f"""{MEMBERS} SELECT usr, CAST(i AS BIGINT) AS i, round(sum(v * CASE key WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END / 15.0), 6) AS v FROM mq GROUP BY usr, i""")
def q11(spark, sf):
    out = MX.quantile_average(type_members(spark, sf), "usr", "locs", 19, WEIGHTS, "key")
    return out.select("usr", F.posexplode("locs").alias("i", "v")).select("usr", (F.col("i") + 1).cast("long").alias("i"), r("v").alias("v"))


@query("q12_trimmed_average", f"""{MEMBERS}, o AS (SELECT *, row_number() OVER (PARTITION BY usr, i ORDER BY v) AS rn, count(*) OVER (PARTITION BY usr, i) AS n FROM mq)
SELECT usr, CAST(i AS BIGINT) AS i, round(avg(v) FILTER (rn > floor(n * 0.25) AND rn <= n - floor(n * 0.25)), 6) AS v FROM o GROUP BY usr, i""")
def q12(spark, sf):
    out = MX.trimmed_average(type_members(spark, sf), "usr", "locs", 19, 0.25)
    return out.select("usr", F.posexplode("locs").alias("i", "v")).select("usr", (F.col("i") + 1).cast("long").alias("i"), r("v").alias("v"))


@query("q14_rescale", f"""{I.UQ}, s AS (SELECT usr, avg(y) AS m, stddev_pop(y) AS s, min(y) AS lo, max(y) AS hi FROM ev GROUP BY usr)
SELECT usr, CAST(i AS BIGINT) AS i, round((v - m) / s, 6) AS z, round(v, 6) AS v FROM qq JOIN s USING (usr)""")
def q14(spark, sf):
    """Standardized per user, then brought back."""
    df = I.user_quantiles(spark, sf).join(FE.group_scaling(I.events(spark, sf), "usr", "y"), "usr")
    df = df.withColumn("z", F.transform("locs", lambda x: (x - F.col("offset")) / F.col("scale")))
    df = df.withColumn("v", Q.rescale("z", F.col("scale"), F.col("offset")))
    out = df.select("usr", F.posexplode(F.arrays_zip("z", "v")).alias("i", "t"))
    return out.select("usr", (F.col("i") + 1).cast("long").alias("i"), r("t.z").alias("z"), r("t.v").alias("v"))


@query("q15_outside_rows", f"""{I.UQ}, o AS (SELECT usr, 1 - sum((l1 - l0) * CASE WHEN a = b THEN CAST(a >= 5 AND a <= 120 AS INT) ELSE greatest(least(b, 120) - greatest(a, 5), 0) / (b - a) END) AS x FROM seg GROUP BY usr)
SELECT count(*) FILTER (x > 0.01) AS n_outside, count(*) AS n FROM o""")
def q15(spark, sf):
    grid = Grid.linear(5.0, 120.0, 23, normalization="histogram")
    out = Q.outside("k", I.LEVELS, grid)
    return uq(spark, sf).agg(F.count_if(out > Q.OUTSIDE_TOLERANCE).alias("n_outside"), F.count("*").alias("n"))


@query("q15_observed_outside", f"""{I.UQ}, o AS (SELECT usr, 1 - sum((l1 - l0) * CASE WHEN a = b THEN CAST(a >= 5 AND a <= 120 AS INT) ELSE greatest(least(b, 120) - greatest(a, 5), 0) / (b - a) END) AS x FROM seg GROUP BY usr)
SELECT count(*) FILTER (x > 0.01) AS n_outside, count(*) AS n FROM o""")
def q15_observed(spark, sf):
    """The same count, brought by the write of the densities."""
    grid, seen = Grid.linear(5.0, 120.0, 23, normalization="histogram"), Observation()
    Q.on_grid_counted(uq(spark, sf), "k", I.LEVELS, grid, "d", seen).select("usr", "d").write.parquet(scratch(spark))
    return spark.createDataFrame([(seen.get["n_outside"], seen.get["n"])], "n_outside long, n long")


# -- mixtures ------------------------------------------------------------------------


def mixture(spark, sf, same: bool = False) -> MX.Mixture:
    """Per user: a fine and a coarse histogram of the same values, weights 3 to 1."""
    second = I.GRID if same else I.COARSE
    a = I.user_histograms(spark, sf).select(F.col("usr").alias("id"), F.lit("fine").alias("component"), "masses")
    b = I.weighted_histograms(I.events(spark, sf), second, ["usr"]) if not same else I.user_histograms(spark, sf).withColumn("masses", F.transform("masses", lambda m: F.sqrt(m)))
    b = b.select(F.col("usr").alias("id"), F.lit("other").alias("component"), "masses")
    return MX.Mixture(a.unionByName(b), (MX.Part("fine", I.GRID, 3.0), MX.Part("other", second, 1.0)))


MIX = f"""{I.USER}, {I.grid_sql('g2', 0.0, 500.0, 35)}, {I.masses_sql('usr', 'sum(y)', name='h2', grid='g2', n=35)},
p2 AS (SELECT *, m / sum(m) OVER (PARTITION BY usr) AS p FROM h2),
mx AS (SELECT usr AS id, 0.75 AS wt, lo, hi, c, w, p FROM p UNION ALL SELECT usr, 0.25, lo, hi, c, w, p FROM p2)"""


@query("m1_component_check", f"""WITH {I.EV}, t AS (SELECT usr AS id, key FROM ev WHERE NOT (usr % 3 = 0 AND key = 'click') GROUP BY ALL)
SELECT id, count(*) AS n_components, count(*) AS n_rows FROM t GROUP BY id HAVING count(*) <> 5""")
def m1(spark, sf):
    """Users that do not have one histogram per event type, in a table with gaps."""
    ev = I.events(spark, sf).where(~((F.col("usr") % 3 == 0) & (F.col("key") == "click")))
    df = I.weighted_histograms(ev, I.GRID, ["usr", "key"]).select(F.col("usr").alias("id"), F.col("key").alias("component"), "masses")
    return MX.Mixture(df, tuple(MX.Part(k, I.GRID) for k in KEYS)).incomplete()


@query("m2_pdf", f"{MIX} SELECT id, round(sum(wt * CASE WHEN 42.0 >= lo AND 42.0 < hi THEN p / w ELSE 0 END), 9) AS pdf FROM mx GROUP BY id")
def m2_pdf(spark, sf):
    return mixture(spark, sf).pdf(F.lit(42.0)).select("id", r("pdf", 9).alias("pdf"))


@query("m2_cdf", f"{MIX} SELECT id, round(sum(wt * p * least(greatest((77.7 - lo) / w, 0), 1)), 8) AS cdf FROM mx GROUP BY id")
def m2_cdf(spark, sf):
    return mixture(spark, sf).cdf(F.lit(77.7)).select("id", r("cdf", 8).alias("cdf"))


@query("m2_pit", f"{MIX} SELECT e.id, round(sum(wt * p * least(greatest((y - lo) / w, 0), 1)), 8) AS pit FROM ev e JOIN mx ON mx.id = e.usr GROUP BY e.id")
def m2_pit(spark, sf):
    mix = mixture(spark, sf)
    rows = I.events(spark, sf).select(F.col("id").alias("event"), "usr", "y").join(mix.df.withColumnRenamed("id", "usr"), "usr")
    per_row = MX.Mixture(rows.withColumnRenamed("event", "id"), mix.parts)
    return per_row.cdf(F.col("y"), "pit").select("id", r("pit", 8).alias("pit"))


@query("m3_moments", f"""{MIX}, mm AS (SELECT id, wt, sum(p * c) AS m FROM mx GROUP BY id, wt), mu AS (SELECT id, sum(wt * m) AS mu FROM mm GROUP BY id)
SELECT id, round(any_value(mu), 6) AS mean, round(sum(wt * p * ((c - mu) * (c - mu) + w * w / 12)), 5) AS var FROM mx JOIN mu USING (id) GROUP BY id""")
def m3(spark, sf):
    return mixture(spark, sf).moments().select("id", r("mean").alias("mean"), r("var", 5).alias("var"))


UNION = f"""{MIX}, ue AS (SELECT DISTINCT round(lo, 9) AS e FROM mx UNION SELECT 500.0), ub AS (SELECT * FROM (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi, row_number() OVER (ORDER BY e) - 1 AS bin FROM ue) WHERE hi IS NOT NULL),
ut AS (SELECT id, ub.bin, ub.lo, ub.hi, sum(wt * p * greatest(least(mx.hi, ub.hi) - greatest(mx.lo, ub.lo), 0) / w) AS p FROM mx CROSS JOIN ub GROUP BY ALL),
un AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f0, sum(p) OVER (PARTITION BY id ORDER BY bin) AS f1 FROM ut)"""


@query("m4_to_histogram", f"{UNION} SELECT id, CAST(bin AS BIGINT) AS bin, round(p, 6) AS mass FROM un")
def m4(spark, sf):
    out = mixture(spark, sf).to_histogram().select("id", F.posexplode("masses").alias("bin", "m"))
    return out.select("id", F.col("bin").cast("long").alias("bin"), r("m", 6).alias("mass"))


def side_by_side(spark, sf) -> DataFrame:
    """The mixture's two members per user in one row: ``(id, fine, coarse)``."""
    fine = I.user_histograms(spark, sf).select(F.col("usr").alias("id"), H.probabilities("masses", I.GRID).alias("fine"))
    coarse = I.user_histograms(spark, sf, I.COARSE).select(F.col("usr").alias("id"), H.probabilities("masses", I.COARSE).alias("coarse"))
    return fine.join(coarse, "id")


PARTS = (MX.Part("fine", I.GRID, 3.0), MX.Part("coarse", I.COARSE, 1.0))


@query("m4_one_row", f"{UNION} SELECT id, CAST(bin AS BIGINT) AS bin, round(p, 6) AS mass FROM un")
def m4_row(spark, sf):
    """The same masses from members in one row, without a shuffle of arrays."""
    out = side_by_side(spark, sf).select("id", F.posexplode(MX.one_row([F.col("fine"), F.col("coarse")], PARTS)).alias("bin", "m"))
    return out.select("id", F.col("bin").cast("long").alias("bin"), r("m", 6).alias("mass"))


@query("m5_quantiles", f"{UNION}, {ppf_sql('un', 'id', (0.16, 0.5, 0.84))} SELECT id, level, round(q, 5) AS q FROM qv")
def m5(spark, sf):
    levels = (0.16, 0.5, 0.84)
    out = mixture(spark, sf).quantiles(levels)
    return out.select("id", F.explode(F.arrays_zip(vector(levels).alias("level"), "q")).alias("t")).select("id", "t.level", r("t.q", 5).alias("q"))


@query("m5_mode", f"{UNION} SELECT id, round(arg_max((lo + hi) / 2, p / (hi - lo)), 6) AS mode FROM un GROUP BY id")
def m5_mode(spark, sf):
    return mixture(spark, sf).mode().select("id", r("mode").alias("mode"))


@query("m6_on_grid", f"""{MIX}, {OTHER_SQL}, d AS (SELECT id, o.bin, sum(wt * p * greatest(least(mx.hi, o.hi) - greatest(mx.lo, o.lo), 0) / mx.w) / 16.0 AS d FROM mx CROSS JOIN o GROUP BY ALL)
SELECT id, CAST(bin AS BIGINT) AS bin, round(d / sum(d * 16.0) OVER (PARTITION BY id), 9) AS density FROM d""")
def m6(spark, sf):
    out = mixture(spark, sf).on_grid(Grid(OTHER.edges, "histogram")).select("id", F.posexplode("density").alias("bin", "d"))
    return out.select("id", F.col("bin").cast("long").alias("bin"), r("d", 9).alias("density"))


@query("m7_atoms", f"{I.ATOMS} SELECT sup AS id, round(0.4 * sum(p) FILTER (w = 0), 8) AS atom FROM p GROUP BY sup")
def m7(spark, sf):
    """A part with a point mass at 25 and a plain part."""
    plain = Bins((0.0, 25.0, 50.0))
    a = I.supplier_atoms(spark, sf).select(F.col("sup").alias("id"), F.lit("a").alias("component"), "masses")
    b = I.supplier_atoms(spark, sf).select(F.col("sup").alias("id"), F.lit("b").alias("component"), F.slice("masses", 1, 2).alias("masses"))
    mix = MX.Mixture(a.unionByName(b), (MX.Part("a", I.ATOM_BINS, 2.0), MX.Part("b", plain, 3.0)))
    return mix.atoms(F.lit(25.0)).select("id", r("atom", 8).alias("atom"))


@query("m8_same_buckets", f"""{I.USER}, s AS (SELECT usr AS id, bin, p, sqrt(m) / sum(sqrt(m)) OVER (PARTITION BY usr) AS p2 FROM p)
SELECT id, CAST(bin AS BIGINT) AS bin, round(0.75 * p + 0.25 * p2, 8) AS mass FROM s""")
def m8(spark, sf):
    """Parts on the same buckets collapse to one weighted sum; nothing is re-binned."""
    df, _ = MX.combine(mixture(spark, sf, same=True))
    out = df.select("id", F.posexplode("masses").alias("bin", "m"))
    return out.select("id", F.col("bin").cast("long").alias("bin"), r("m", 8).alias("mass"))


# -- every kind ------------------------------------------------------------------------


@query("d1_survival", f"{I.USER}, v AS (SELECT unnest({list(VALUES)})::DOUBLE AS x) SELECT usr, x, round(1 - {CDF}, 8) AS sf FROM p CROSS JOIN v GROUP BY usr, x")
def d1(spark, sf):
    sfv = F.transform(H.cdf_values("p", I.GRID, VALUES), lambda f: 1.0 - f)
    return users(spark, sf).select("usr", F.explode(F.arrays_zip(vector(VALUES).alias("x"), sfv.alias("s"))).alias("t")).select("usr", "t.x", r("t.s", 8).alias("sf"))


@query("d2_median", f"{I.USER}, {ppf_sql('p', 'usr', (0.5,))} SELECT usr, round(q, 6) AS median FROM qv")
def d2(spark, sf):
    return users(spark, sf).select("usr", r(H.median("p", I.GRID)).alias("median"))


@query("d3_interval", f"""{I.USER}, {ppf_sql('p', 'usr', (0.16, 0.84))} SELECT usr, round(min(q), 6) AS lo, round(max(q), 6) AS hi FROM qv GROUP BY usr""")
def d3(spark, sf):
    return users(spark, sf).withColumn("i", H.interval("p", I.GRID, 0.68)).select("usr", r("i.lo").alias("lo"), r("i.hi").alias("hi"))


@query("d4_draws", f"""{I.USER}, dr AS (SELECT usr, unnest(range(1, 9)) AS draw FROM (SELECT DISTINCT usr FROM ev)), du AS (SELECT usr, draw, {I.uniform_sql('7', 'usr', 'draw')} AS u FROM dr)
SELECT usr, draw, round(min(lo + least(greatest((u - f0) / p, 0), 1) * w) FILTER (p > 0 AND f1 >= u), 6) AS value FROM du JOIN p USING (usr) GROUP BY usr, draw""")
def d4(spark, sf):
    """Eight inverse-transform draws per user; a re-run draws the same values."""
    df = users(spark, sf).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("draw", F.col("draw").cast("long"))
    u = hash_uniform(7, F.col("usr"), F.col("draw"))
    return df.select("usr", "draw", r(H.ppf_at("p", I.GRID, u)).alias("value"))


@query("d5_concatenate", f"""{I.USER}, t AS (SELECT key, {I.bin_sql('y')} AS bin, sum(y) AS m FROM ev GROUP BY ALL), a AS (SELECT CAST(usr AS VARCHAR) AS name, sum(m) AS mass, max(bin) FILTER (m > 0) AS top FROM h GROUP BY usr
UNION ALL SELECT key, sum(m), max(bin) FROM t GROUP BY key) SELECT name, round(mass, 4) AS mass, CAST(top AS BIGINT) AS top FROM a""")
def d5(spark, sf):
    """Users' and types' histograms stacked; metadata that only one part has is dropped."""
    a = I.user_histograms(spark, sf).select(F.col("usr").cast("string").alias("name"), "masses", F.lit("u").alias("note"))
    b = I.weighted_histograms(I.events(spark, sf), I.GRID, ["key"]).select(F.col("key").alias("name"), "masses")
    df, _ = MX.concatenate([(a, I.GRID), (b, I.GRID)])
    mass = F.aggregate("masses", F.lit(0.0), lambda s, x: s + x)
    top = F.array_max(F.filter(F.transform("masses", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull()))
    return df.select("name", r(mass, 4).alias("mass"), top.cast("long").alias("top"))


# -- point estimates -------------------------------------------------------------------

DENS = f"""{I.USER}, d AS (SELECT usr, bin, c, w, p AS mass, p / w AS d, f0, f1, lo, hi, p FROM p)"""
TDENS = f"""{I.USER}, d AS (SELECT usr, bin, c, m / sum(m * tw) OVER (PARTITION BY usr) AS d, tw FROM (SELECT *, 10.0 * CASE WHEN bin IN (0, 49) THEN 0.5 ELSE 1 END AS tw FROM h))"""


@query("p1_mode", f"{TDENS} SELECT usr, arg_max(c, d) AS mode FROM d GROUP BY usr")
def p1(spark, sf):
    df = I.user_histograms(spark, sf).withColumn("d", I.TRAPEZOID.normalize("masses"))
    return df.select("usr", P.mode("d", I.TRAPEZOID).alias("mode"))


def run_sql(weight: str) -> str:
    """The contiguous run of bins around the peak above 5 % of it."""
    return f"""pk AS (SELECT usr, arg_max(bin, d) AS k, max(d) AS top FROM d GROUP BY usr),
ends AS (SELECT usr, any_value(k) AS k, coalesce(max(bin) FILTER (bin < k AND d < 0.05 * top), -1) AS a, coalesce(min(bin) FILTER (bin > k AND d < 0.05 * top), 50) AS b FROM d JOIN pk USING (usr) GROUP BY usr)
SELECT usr, round(sum(d * {weight} * c) / sum(d * {weight}), 6) AS peak_mean FROM d JOIN ends USING (usr) WHERE bin > a AND bin < b GROUP BY usr"""


@query("p2_peak_mean_trapezoid", f"{TDENS}, {run_sql('tw')}")
def p2_trapezoid(spark, sf):
    df = I.user_histograms(spark, sf).withColumn("d", I.TRAPEZOID.normalize("masses"))
    return df.select("usr", r(P.peak_mean("d", I.TRAPEZOID)).alias("peak_mean"))


@query("p2_peak_mean_histogram", f"{DENS}, {run_sql('w')}")
def p2_histogram(spark, sf):
    df = I.user_histograms(spark, sf).withColumn("d", I.GRID.normalize("masses"))
    return df.select("usr", r(P.peak_mean("d", I.GRID)).alias("peak_mean"))


@query("p3_mean", f"{TDENS} SELECT usr, round(sum(d * tw * c), 6) AS mean FROM d GROUP BY usr")
def p3(spark, sf):
    df = I.user_histograms(spark, sf).withColumn("d", I.TRAPEZOID.normalize("masses"))
    return df.select("usr", r(P.mean("d", I.TRAPEZOID)).alias("mean"))


@query("p4_median_trapezoid", f"""{TDENS}, s AS (SELECT * FROM (SELECT usr, bin, c AS lo, lead(c) OVER x AS hi, 5.0 * (d + lead(d) OVER x) AS p FROM d WINDOW x AS (PARTITION BY usr ORDER BY bin)) WHERE hi IS NOT NULL),
t AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY usr ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f0, sum(p) OVER (PARTITION BY usr ORDER BY bin) AS f1 FROM s), {ppf_sql('t', 'usr', (0.5,))}
SELECT usr, round(q, 6) AS median FROM qv""")
def p4_trapezoid(spark, sf):
    df = I.user_histograms(spark, sf).withColumn("d", I.TRAPEZOID.normalize("masses"))
    return df.select("usr", r(P.median("d", I.TRAPEZOID)).alias("median"))


@query("p5_all_estimates", f"""{DENS}, pk AS (SELECT usr, arg_max(bin, d) AS k, max(d) AS top FROM d GROUP BY usr),
ends AS (SELECT usr, coalesce(max(bin) FILTER (bin < k AND d < 0.05 * top), -1) AS a, coalesce(min(bin) FILTER (bin > k AND d < 0.05 * top), 50) AS b FROM d JOIN pk USING (usr) GROUP BY usr), {ppf_sql('d', 'usr', (0.5,))}
SELECT d.usr, arg_max(c, d) AS mode, round(sum(mass * c) FILTER (bin > a AND bin < b) / sum(mass) FILTER (bin > a AND bin < b), 6) AS peak_mean,
  round(sum(mass * c), 6) AS mean, round(any_value(q), 6) AS median FROM d JOIN ends USING (usr) JOIN qv USING (usr) GROUP BY d.usr""")
def p5(spark, sf):
    df = I.user_histograms(spark, sf).withColumn("d", I.GRID.normalize("masses")).select("usr", *P.all_estimates("d", I.GRID))
    return df.select("usr", "mode", r("peak_mean").alias("peak_mean"), r("mean").alias("mean"), r("median").alias("median"))
