"""Queries of the aggregates behind calibration plots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.grids import Grid
from tessella.operators import diagnostics as X
from tessella.plans import inputs as I
from tessella.plans.inputs import bin_sql, rounded as r, uniform_sql
from tessella.plans.registry import query
from tessella.plans.scoring import scored

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query("x1_truth_estimate_2d", f"{I.SCORES}, x AS (SELECT {bin_sql('y', 0.0, 500.0, 20)} AS ix, {bin_sql('mean_pred', 0.0, 500.0, 20)} AS iy FROM s) SELECT CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, count(*) AS n FROM x GROUP BY ALL")
def x1(spark, sf):
    out = X.histogram_2d(scored(spark, sf), "y", "y_pred", 20, (0.0, 500.0))
    return out.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), "n")


def binned_sql(source: str, x: str, y: str, n: int, levels, edges: str | None = None) -> str:
    """Equal-count bins of x (distinct edges) with quantiles of y."""
    q = edges or f"(SELECT list_sort(list_distinct(quantile_cont({x}, {[i / n for i in range(n + 1)]}))) AS e FROM {source})"
    return f"""be AS (SELECT unnest(e) AS lo, unnest(range(len(e))) AS bin, len(e) AS k FROM {q}),
bb AS (SELECT * FROM (SELECT bin, lo, lead(lo) OVER (ORDER BY bin) AS hi, k FROM be) WHERE hi IS NOT NULL),
bx AS (SELECT {x} AS x, {y} AS y, bin FROM {source} JOIN bb ON {x} >= lo AND ({x} < hi OR (bin = k - 2 AND {x} <= hi))),
bq AS (SELECT bin, count(*) AS n, quantile_cont(y, {list(levels)}) AS q FROM bx GROUP BY bin)"""


@query("x2_residual_quantiles", f"{I.SCORES}, e AS (SELECT y AS t, mean_pred - y AS e FROM s), {binned_sql('e', 't', 'e', 8, X.RESIDUAL_LEVELS)} SELECT bb.bin, round(lo, 6) AS lo, n, round(q[1], 6) AS q16, round(q[2], 6) AS q50, round(q[3], 6) AS q84 FROM bb JOIN bq USING (bin)")
def x2(spark, sf):
    out = X.residual_quantiles(scored(spark, sf), "y", "y_pred", 8)
    return out.select(F.col("bin").cast("long").alias("bin"), r("lo").alias("lo"), "n", *[r(F.col("q")[i]).alias(c) for i, c in enumerate(("q16", "q50", "q84"))])


EDGES = [0.0, 2.0, 10.0, 40.0, 41.0, 100.0, 480.0]


@query("x3_binned_quantiles", f"{I.ORDERS}, {binned_sql('f', 'qty', 'price', 6, (0.25, 0.5, 0.75), f'(SELECT {EDGES}::DOUBLE[] AS e)')} SELECT CAST(bb.bin AS BIGINT) AS bin, lo, hi, coalesce(n, 0) AS n, coalesce(round(q[2], 4), 'NaN'::DOUBLE) AS median FROM bb LEFT JOIN bq USING (bin)")
def x3(spark, sf):
    """Explicit edges; the bins beyond the largest quantity are empty and NaN."""
    out = X.binned_quantiles(I.order_features(spark, sf), "qty", "price", edges=EDGES)
    return out.select(F.col("bin").cast("long").alias("bin"), "lo", "hi", "n", r(F.col("q")[1], 4).alias("median"))


@query("x4_pit_histogram", f"{I.SCORES}, h2 AS (SELECT key, CAST(least(floor(pit * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM s GROUP BY ALL) SELECT key, bin, n, n / sum(n) OVER (PARTITION BY key) * 20.0 AS density FROM h2")
def x4(spark, sf):
    out = X.pit_histogram(scored(spark, sf), by=["key"])
    return out.select("key", F.col("bin").cast("long").alias("bin"), "n", "density")


@query("x5_pit_quantile_points", f"{I.SCORES}, k AS (SELECT pit, row_number() OVER (ORDER BY pit) AS rank, count(*) OVER () AS n FROM s), w AS (SELECT DISTINCT CAST(floor((i + 0.5) * (SELECT count(*) FROM s) / 50.0::DOUBLE) + 1 AS BIGINT) AS rank FROM range(50) t(i)) SELECT rank, round((rank - 0.5) / n, 8) AS uniform, round(pit, 7) AS pit FROM k JOIN w USING (rank)")
def x5(spark, sf):
    return X.pit_quantile_points(scored(spark, sf), "pit", 50).select(F.col("rank").cast("long").alias("rank"), r("uniform", 8).alias("uniform"), r("pit", 7).alias("pit"))


@query("x6_coverage_curve", f"{I.SCORES}, n AS (SELECT i / 100.0::DOUBLE AS q FROM range(101) t(i)) SELECT key, round(q, 6) AS nominal, avg(CAST(abs(pit - 0.5) <= 0.5 * q AS INT)) AS empirical FROM s CROSS JOIN n GROUP BY key, q")
def x6(spark, sf):
    out = X.coverage_curve(scored(spark, sf), by=["key"])
    return out.select("key", r("nominal").alias("nominal"), "empirical")


@query("x7_stacked_density", f"{I.CROSS} SELECT CAST(bin AS BIGINT) AS bin, round(avg(p / w), 9) AS density FROM ev JOIN p USING (key, fold) GROUP BY bin")
def x7(spark, sf):
    out = X.stacked_density(I.cross_predictions(spark, sf), "masses", I.GRID)
    return out.select(F.col("bin").cast("long").alias("bin"), r("density", 9).alias("density"))


@query("x7_stacked_wide", f"""{I.ORDERS.split('l AS')[0].rstrip().rstrip(',')}, {I.grid_sql('g', 0.0, 500000.0, 125)}, {I.masses_sql('priority', 'count(*)', 'o', x='price', low=0.0, high=500000.0, n=125)}, {I.probs_sql('priority')}
SELECT CAST(bin AS BIGINT) AS bin, round(avg(p / w) * 1e5, 8) AS density FROM o JOIN p USING (priority) GROUP BY bin""")
def x7_wide(spark, sf):
    """More bins than plain aggregates: exploded and combined per bin."""
    from tessella.operators.estimators import bin_shares

    grid = Grid.linear(0.0, 500_000.0, 125, normalization="histogram")
    o = I.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("y"))
    out = X.stacked_density(o.join(bin_shares(o, "y", grid, ["priority"]), "priority"), "masses", grid)
    return out.select(F.col("bin").cast("long").alias("bin"), r(F.col("density") * 1e5, 8).alias("density"))


@query("x7_truth_histogram", f"WITH {I.EV}, a AS (SELECT min(y) AS lo, max(y) AS hi FROM ev), b AS (SELECT CAST(least(floor((y - lo) / ((hi - lo) / 40)), 39) AS BIGINT) AS bin, hi - lo AS span FROM ev, a) SELECT bin, count(*) AS n, round(count(*) / (SELECT count(*) FROM ev) / (any_value(span) / 40), 9) AS density FROM b GROUP BY bin")
def x7_truth(spark, sf):
    out = X.truth_histogram(I.events(spark, sf), "y", 40)
    return out.select(F.col("bin").cast("long").alias("bin"), "n", r("density", 9).alias("density"))


@query("x8_central_range", f"""{I.USER}, e AS (SELECT usr, min(y) AS tlo, max(y) AS thi FROM ev GROUP BY usr),
q AS (SELECT usr, max(lo + (0.001 - f0) / p * w) FILTER (p > 0 AND f0 <= 0.001 AND f1 > 0.001) AS a, max(lo + (0.999 - f0) / p * w) FILTER (p > 0 AND f0 <= 0.999 AND f1 > 0.999) AS b FROM p GROUP BY usr),
m AS (SELECT usr, least(a, tlo) AS a, greatest(b, thi) AS b FROM q JOIN e USING (usr))
SELECT usr, round(greatest(a - 0.05 * (b - a), 0), 5) AS lo, round(least(b + 0.05 * (b - a), 500), 5) AS hi FROM m""")
def x8(spark, sf):
    ends = I.events(spark, sf).groupBy("usr").agg(F.min("y").alias("tlo"), F.max("y").alias("thi"))
    df = I.user_histograms(spark, sf).withColumn("d", I.GRID.normalize("masses")).join(ends, "usr")
    df = df.withColumn("r", X.central_range(F.col("d"), I.GRID, F.col("tlo"), F.col("thi")))
    return df.select("usr", r("r.lo", 5).alias("lo"), r("r.hi", 5).alias("hi"))


@query("x9_rows_to_show", f"SELECT event_id AS id FROM events ORDER BY {uniform_sql('0', 'event_id')}, event_id LIMIT 6")
def x9(spark, sf):
    return X.rows_to_show(I.events(spark, sf), "id", 6).select("id")


@query("x11_sample_histograms", f"""WITH {I.EV}, a AS (SELECT min(y) AS lo, max(y) AS hi FROM ev)
SELECT key AS sample, CAST(least(floor((y - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, count(*) AS n FROM ev, a GROUP BY ALL""")
def x11(spark, sf):
    ev = I.events(spark, sf)
    out = X.sample_histograms({k: ev.where(F.col("key") == k) for k in EVENT_TYPES}, "y", 30)
    return out.select("sample", F.col("bin").cast("long").alias("bin"), "n")


@query("x12_running_median", f"{I.ORDERS}, {binned_sql('f', 'ext', 'price', 10, (0.25, 0.5, 0.75))} SELECT bb.bin, n, round(q[1], 4) AS p25, round(q[2], 4) AS median, round(q[3], 4) AS p75, round((SELECT median(price) FROM f), 4) AS global_median FROM bb JOIN bq USING (bin)")
def x12(spark, sf):
    out = X.running_median(I.order_features(spark, sf), "ext", "price", 10)
    return out.select(F.col("bin").cast("long").alias("bin"), "n", *[r(c, 4).alias(c) for c in ("p25", "median", "p75", "global_median")])


@query("x13_densities_to_show", f"{I.CROSS}, s AS (SELECT id, key, fold, y FROM ev ORDER BY {uniform_sql('0', 'id')}, id LIMIT 6) SELECT s.id, CAST(bin AS BIGINT) AS bin, round(p / w, 9) AS density FROM s JOIN p USING (key, fold)")
def x13(spark, sf):
    out = X.densities_to_show(I.cross_predictions(spark, sf), "masses", "y", "id", I.GRID)
    return out.select("id", F.posexplode("density").alias("bin", "d")).select("id", F.col("bin").cast("long").alias("bin"), r("d", 9).alias("density"))
