"""Queries of the pools: three members' predictions of the same events, combined.

The members are the user's value-weighted histogram on 50 bins, the user's on
35 bins, and the density of the event's type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import histogram as H, quantile as Q
from tessella.functions.grids import Bins, Grid, target_range, union_bins
from tessella.operators import mixtures as MX, pooling as PO
from tessella.plans import inputs as I
from tessella.plans.distributions import MIX, PARTS, UNION, mixture, side_by_side
from tessella.plans.inputs import rounded as r
from tessella.plans.registry import query

POOL = Grid.linear(0.0, 500.0, 100, normalization="histogram")
WEIGHTS = (1.0, 1.0, 2.0)


def members(spark: SparkSession, sf: str) -> DataFrame:
    """``(usr, key, m1, m2, m3)``: masses of each member on the pool grid, per user and type."""
    ev = I.events(spark, sf)
    pairs = ev.select("usr", "key").distinct()
    # Each member is brought to the pool grid before the join: once per user or type, not per pair.
    a = I.user_histograms(spark, sf).withColumn("m1", H.regrid("masses", I.GRID, POOL, raw=True)).drop("masses")
    b = I.user_histograms(spark, sf, I.COARSE).withColumn("m2", H.regrid("masses", I.COARSE, POOL, raw=True)).drop("masses")
    c = I.weighted_histograms(ev, I.GRID, ["key"]).withColumn("m3", H.regrid("masses", I.GRID, POOL, raw=True)).drop("masses")
    return pairs.join(a, "usr").join(b, "usr").join(c, "key").select("usr", "key", "m1", "m2", "m3")


MEMBERS = f"""WITH {I.EV}, {I.grid_sql()}, {I.grid_sql('g2', n=35)}, {I.grid_sql('pg', n=100)},
{I.masses_sql('usr', 'sum(y)', name='ha')}, {I.masses_sql('usr', 'sum(y)', name='hb', grid='g2', n=35)}, {I.masses_sql('key', 'sum(y)', name='hc')},
ra AS (SELECT usr, pg.bin, sum(p * greatest(least(x.hi, pg.hi) - greatest(x.lo, pg.lo), 0) / x.w) AS m FROM (SELECT *, m / sum(m) OVER (PARTITION BY usr) AS p FROM ha) x CROSS JOIN pg GROUP BY ALL),
rb AS (SELECT usr, pg.bin, sum(p * greatest(least(x.hi, pg.hi) - greatest(x.lo, pg.lo), 0) / x.w) AS m FROM (SELECT *, m / sum(m) OVER (PARTITION BY usr) AS p FROM hb) x CROSS JOIN pg GROUP BY ALL),
rc AS (SELECT key, pg.bin, sum(p * greatest(least(x.hi, pg.hi) - greatest(x.lo, pg.lo), 0) / x.w) AS m FROM (SELECT *, m / sum(m) OVER (PARTITION BY key) AS p FROM hc) x CROSS JOIN pg GROUP BY ALL),
mm AS (SELECT k.usr, k.key, pg.lo, pg.c, pg.w, ra.bin, ra.m AS m1, rb.m AS m2, rc.m AS m3 FROM (SELECT DISTINCT usr, key FROM ev) k JOIN ra USING (usr) JOIN rb ON rb.usr = k.usr AND rb.bin = ra.bin JOIN rc ON rc.key = k.key AND rc.bin = ra.bin JOIN pg ON pg.bin = ra.bin)"""
SUMMARY_SQL = "SELECT usr, key, round(sum(m * c) / sum(m), 6) AS mean, round(arg_max(c, m), 6) AS mode FROM pool GROUP BY usr, key"


def summary(df: DataFrame, column) -> DataFrame:
    out = df.select("usr", "key", column.alias("m")).withColumn("p", H.probabilities("m", POOL))
    return out.select("usr", "key", r(H.mean("p", POOL)).alias("mean"), r(H.mode("p", POOL)).alias("mode"))


@query("k3_linear_pool", f"{MEMBERS}, pool AS (SELECT usr, key, c, 0.25 * m1 + 0.25 * m2 + 0.5 * m3 AS m FROM mm) SELECT usr, key, round(sum(m * c) / sum(m), 6) AS mean FROM pool GROUP BY usr, key")
def k3(spark, sf):
    return summary(members(spark, sf), PO.linear([F.col("m1"), F.col("m2"), F.col("m3")], POOL, WEIGHTS)).drop("mode")


@query("k4_geometric_pool", f"{MEMBERS}, lg AS (SELECT usr, key, c, w, 0.25 * ln(m1 / w + 2e-13) + 0.25 * ln(m2 / w + 2e-13) + 0.5 * ln(m3 / w + 2e-13) AS l FROM mm), pool AS (SELECT usr, key, c, exp(l - max(l) OVER (PARTITION BY usr, key)) * w AS m FROM lg) SELECT usr, key, round(sum(m * c) / sum(m), 6) AS mean FROM pool GROUP BY usr, key")
def k4(spark, sf):
    return summary(members(spark, sf), PO.geometric([F.col("m1"), F.col("m2"), F.col("m3")], POOL, WEIGHTS)).drop("mode")


def quantile_sql(source: str, key: str, lo: str, hi: str) -> str:
    """1,001 quantiles of a histogram with its CDF columns, cut to the pool grid."""
    return f"""(SELECT {key}, l, CASE WHEN l = 0 THEN min(lo) FILTER (p > 0) WHEN l = 1000 THEN max(hi) FILTER (p > 0)
  ELSE min(lo + least(greatest((l / 1000.0::DOUBLE - f0) / p, 0), 1) * (hi - lo)) FILTER (p > 0 AND f1 >= l / 1000.0::DOUBLE) END AS q FROM {source} CROSS JOIN lv GROUP BY {key}, l)"""


@query("k5_quantile_pool", f"""{I.USER}, {I.grid_sql('g2', n=35)}, {I.masses_sql('usr', 'sum(y)', name='hb', grid='g2', n=35)}, {I.probs_sql('usr', 'hb', 'pb')}, lv AS (SELECT unnest(range(1001)) AS l),
q1 AS {quantile_sql('p', 'usr', '', '')}, q2 AS {quantile_sql('pb', 'usr', '', '')}
SELECT usr, round(avg(0.5 * least(greatest(q1.q, 0), 500) + 0.5 * least(greatest(q2.q, 0), 500)), 3) AS mean_quantile FROM q1 JOIN q2 USING (usr, l) GROUP BY usr""")
def k5(spark, sf):
    """Two members' quantile functions averaged at 1,001 levels."""
    a = I.user_histograms(spark, sf).select("usr", H.probabilities("masses", I.GRID).alias("a"))
    b = I.user_histograms(spark, sf, I.COARSE).select("usr", H.probabilities("masses", I.COARSE).alias("b"))
    rows = a.join(b, "usr").withColumn("qa", PO.member_quantiles("a", I.GRID, POOL)).withColumn("qb", PO.member_quantiles("b", I.COARSE, POOL))
    pooled = rows.withColumn("q", PO.quantile([F.col("qa"), F.col("qb")]))
    mean = F.aggregate("q", F.lit(0.0), lambda s, x: s + x) / 1001.0
    return pooled.select("usr", r(mean, 3).alias("mean_quantile"))


@query("k5_mixed_members", f"""{UNION}, {I.quantile_knots_sql('ev', 'usr', 'y')}, lv AS (SELECT unnest(range(1001)) AS l),
uz AS (SELECT * REPLACE (CASE WHEN p < 1e-8 THEN 0 ELSE p END AS p) FROM un), q1 AS {quantile_sql('uz', 'id', '', '')},
q2 AS (SELECT usr AS id, l, max(CASE WHEN l0 <= l / 1000.0::DOUBLE AND (l1 > l / 1000.0::DOUBLE OR (l = 1000 AND l1 = 1)) THEN a + (b - a) * (l / 1000.0::DOUBLE - l0) / (l1 - l0) END) AS q FROM seg CROSS JOIN lv GROUP BY usr, l)
SELECT id AS usr, round(avg(0.5 * least(greatest(q1.q, 0), 500) + 0.5 * least(greatest(q2.q, 0), 500)), 2) AS mean_quantile FROM q1 JOIN q2 USING (id, l) GROUP BY id""")
def k5_mixed(spark, sf):
    """A quantile pool of a mixture, inverted on its own edges, and of a quantile distribution.

    The SQL rounds the union's edges, so slivers of mass below 1e-8 are none there.
    """
    bins = PO.exact_bins(union_bins([p.bins for p in PARTS]), POOL)
    mixed = side_by_side(spark, sf).select(F.col("id").alias("usr"), MX.one_row([F.col("fine"), F.col("coarse")], PARTS, bins).alias("m"))
    knots = I.user_quantiles(spark, sf).select("usr", Q.knots("locs", I.LEVELS).alias("k"))
    rows = mixed.join(knots, "usr").withColumn("qa", PO.member_quantiles("m", bins, POOL)).withColumn("qb", PO.quantile_member_quantiles("k", I.LEVELS, POOL))
    mean = F.aggregate(PO.quantile([F.col("qa"), F.col("qb")]), F.lit(0.0), lambda s, x: s + x) / 1001.0
    return rows.select("usr", r(mean, 2).alias("mean_quantile"))


@query("k6_pool_grid", f"""WITH {I.EV}, a AS (SELECT min(y) AS lo, max(y) AS hi FROM ev), b AS (SELECT greatest(lo - 0.25 * (hi - lo), 0.0) AS s, least(hi + 0.25 * (hi - lo), 500.0) AS e FROM a),
c AS (SELECT s, e, CAST(least(greatest(ceil((e - s) / 10.0), 200), 10000) AS BIGINT) AS n FROM b)
SELECT CAST(least(greatest(floor((y - s) / ((e - s) / n)), 0), n - 1) AS BIGINT) AS bin, count(*) AS k FROM ev, c GROUP BY 1""")
def k6(spark, sf):
    """The automatic pool grid of the two histogram members, with its occupancy."""
    ev = I.events(spark, sf)
    grid = PO.pool_grid(target_range(ev, "y"), [Bins(I.GRID.edges), I.COARSE])
    return ev.groupBy(grid.bin_index(F.col("y")).cast("long").alias("bin")).agg(F.count("*").alias("k"))


@query("k2_combine_members", f"{MIX} SELECT id, round(sum(wt * p * c), 6) AS mean FROM mx GROUP BY id")
def k2(spark, sf):
    """Members with other buckets stay a mixture, weighted by their counts."""
    mix = MX.combine(mixture(spark, sf))
    return mix.moments().select("id", r("mean").alias("mean"))


@query("k2_trimmed_members", f"""WITH {I.EV}, mq AS (SELECT usr, key, unnest(quantile_cont(y, {list(I.LEVELS)})) AS v, unnest(range(1, 20)) AS i FROM ev GROUP BY usr, key),
o AS (SELECT *, row_number() OVER (PARTITION BY usr, i ORDER BY v) AS rn, count(*) OVER (PARTITION BY usr, i) AS n FROM mq), t AS (SELECT usr, i, avg(v) FILTER (rn > floor(n * 0.2) AND rn <= n - floor(n * 0.2)) AS v FROM o GROUP BY usr, i)
SELECT usr, round(avg(v), 6) AS mean_of_quantiles FROM t GROUP BY usr""")
def k2_trimmed(spark, sf):
    from tessella.plans.distributions import type_members
    out = MX.trimmed_average(type_members(spark, sf), "usr", "locs", 19, 0.2)
    return out.select("usr", r(F.aggregate("locs", F.lit(0.0), lambda s, x: s + x) / 19.0).alias("mean_of_quantiles"))


