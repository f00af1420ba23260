"""Queries of biased selection, splits, bags and masking, on orders.

An order's mean quantity plays the magnitude, the difference of two line
averages the color, and its price the target.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions.uniform import hash_uniform, member_seed
from tessella.operators import selection as SE
from tessella.plans import inputs as I
from tessella.plans.inputs import rounded as r, uniform_sql
from tessella.plans.registry import query
from tessella.session import scratch

X_EDGES = (0.0, 15.0, 25.0, 35.0, 51.0)
Y_EDGES = (-10.0, 0.0, 3.0, 10.0)
RATIOS = ((0.5, 0.3, 0.1, 0.0), (0.8, 0.3, 0.2, 0.05), (0.9, 0.5, 0.2, 0.05))


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, mag, a, b, z)``; the color is ``a - b``, the target price per million."""
    return I.order_features(spark, sf).select(
        "id", F.col("qty").alias("mag"), (F.col("disc") * 100).alias("a"), (F.col("tax") * 100).alias("b"), (F.col("price") / 1e5).alias("z"))


def grid(spark: SparkSession, sf: str) -> SE.SelectionGrid:
    """Ceilings come from the finished orders."""
    done = I.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    sample = objects(spark, sf).join(done, "id", "left_semi").select("mag", (F.col("a") - F.col("b")).alias("color"), F.col("z").alias("y"))
    return SE.SelectionGrid.from_matrix(spark, RATIOS, X_EDGES, Y_EDGES, sample)


ARGS = dict(magnitude="mag", color=("a", "b"), y="z", percentile_cut=60.0)


def left_open(x: str, edges) -> str:
    """The pixel (e_k, e_k+1] of a value, -1 or n when off the edges."""
    inner = " ".join(f"WHEN {x} > {a} AND {x} <= {b} THEN {k}" for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])))
    return f"CASE {inner} WHEN {x} <= {edges[0]} THEN -1 ELSE {len(edges) - 1} END"


PIXELS = ", ".join(f"({px}, {py}, {v})" for py, row in enumerate(RATIOS) for px, v in enumerate(row))
OBJ = f"""{I.ORDERS}, o2 AS (SELECT id, status, qty AS mag, disc * 100 - tax * 100 AS color, price / 1e5 AS z FROM f),
px AS (SELECT *, {left_open('mag', X_EDGES)} AS px, {left_open('color', Y_EDGES)} AS py FROM o2),
rt AS (SELECT * FROM (VALUES {PIXELS}) t(px, py, ratio)),
cl AS (SELECT px, py, quantile_cont(z, 0.6) AS c FROM px WHERE status = 'F' GROUP BY px, py),
dg AS (SELECT px.*, coalesce(CAST(ratio AS DOUBLE), 0) AS ratio, CASE WHEN ratio IS NULL THEN 99.0 ELSE coalesce(c, 0) END AS z_ceiling FROM px LEFT JOIN rt USING (px, py) LEFT JOIN cl USING (px, py)),
sv AS (SELECT *, z > 0 AND z <= z_ceiling AND z <= 100 AS survives_z_cut FROM dg)"""


def keep_sql(source: str, seed: int = 12345, name: str = "kp", factor: float = 1.588) -> str:
    """Counts per ratio, quotas, and the kept rows in hash order."""
    return f"""{name}_n AS (SELECT ratio, count(*) AS n FROM {source} WHERE survives_z_cut AND ratio > 0 GROUP BY ratio),
{name}_k AS (SELECT ratio, n, CASE WHEN n * ratio * {factor} <= n THEN n * ratio * {factor} ELSE n END AS k FROM {name}_n),
{name}_q AS (SELECT ratio, n, CAST(least(floor(k) + CASE WHEN k <> floor(k) AND {uniform_sql(str(seed), 'CAST(round(ratio * 1e9) AS BIGINT)')} <= ratio THEN 1 ELSE 0 END, n) AS BIGINT) AS quota FROM {name}_k),
{name} AS (SELECT id FROM (SELECT id, ratio, row_number() OVER (PARTITION BY ratio ORDER BY {uniform_sql(str(seed), 'id')}, id) AS rn FROM {source} WHERE survives_z_cut) JOIN {name}_q USING (ratio) WHERE rn <= quota)"""


EVEN_X, EVEN_Y = np.linspace(0.0, 52.0, 5).tolist(), np.linspace(-10.0, 10.0, 4).tolist()


@query("s7_stored_grid", f"""{I.ORDERS}, px AS (SELECT price / 1e5 AS z, {left_open('qty', EVEN_X)} AS px, {left_open('(disc * 100 - tax * 100)', EVEN_Y)} AS py FROM f WHERE status = 'F'),
rt AS (SELECT * FROM (VALUES {PIXELS}) t(px, py, ratio)), cl AS (SELECT px, py, quantile_cont(z, 0.6) AS c FROM px GROUP BY ALL)
SELECT CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py, round(coalesce(c, 0), 6) AS z_ceiling FROM rt LEFT JOIN cl USING (px, py)""")
def s7_stored(spark, sf):
    """Ratios and sample written as tables and read back with evenly spaced edges."""
    g, ratios, sample = grid(spark, sf), scratch(spark), scratch(spark)
    g.ratios.write.parquet(ratios)
    g.sample.write.parquet(sample)
    stored = SE.SelectionGrid.read(spark, ratios, sample, (EVEN_X[0], EVEN_X[-1]), (EVEN_Y[0], EVEN_Y[-1]), (4, 3))
    return stored.ceilings(60.0).select(F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), r("z_ceiling").alias("z_ceiling"))


@query("s7_selection_grid", f"WITH rt AS (SELECT * FROM (VALUES {PIXELS}) t(px, py, ratio)), {OBJ.split('WITH ')[1].split('rt AS')[0].rstrip().rstrip(',')} SELECT CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py, CAST(ratio AS DOUBLE) AS ratio, count(id) AS n FROM rt LEFT JOIN px USING (px, py) GROUP BY ALL")
def s7(spark, sf):
    g = grid(spark, sf)
    px, py = g.pixel(F.col("mag"), F.col("a") - F.col("b"))
    counts = objects(spark, sf).groupBy(px.alias("px"), py.alias("py")).agg(F.count("*").alias("n"))
    return g.ratios.join(counts, ["px", "py"], "left").select(F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), "ratio", F.coalesce("n", F.lit(0)).alias("n"))


@query("r1_hash_uniform", f"SELECT o_orderkey AS id, {uniform_sql(str(member_seed(3, 1)), 'o_orderkey')} AS u FROM orders")
def r1(spark, sf):
    key = F.col("o_orderkey")
    return I.table(spark, sf, "orders").select(key.alias("id"), hash_uniform(member_seed(3, 1), key).alias("u"))


@query("r2_pixels", f"{OBJ} SELECT id, CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py, px BETWEEN 0 AND 3 AND py BETWEEN 0 AND 2 AS inside FROM px")
def r2(spark, sf):
    g = grid(spark, sf)
    px, py = g.pixel(F.col("mag"), F.col("a") - F.col("b"))
    df = objects(spark, sf).select("id", px.cast("long").alias("px"), py.cast("long").alias("py"))
    return df.withColumn("inside", g.inside(F.col("px"), F.col("py")))


@query("r3_ceilings", f"{OBJ} SELECT CAST(rt.px AS BIGINT) AS px, CAST(rt.py AS BIGINT) AS py, round(coalesce(c, 0), 8) AS z_ceiling FROM rt LEFT JOIN cl USING (px, py)")
def r3(spark, sf):
    return grid(spark, sf).ceilings(60.0).select(F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), r("z_ceiling", 8).alias("z_ceiling"))


@query("j2_pixel_lookup", f"{OBJ} SELECT id, ratio, round(z_ceiling, 8) AS z_ceiling, survives_z_cut FROM sv")
def j2(spark, sf):
    out = SE.diagnose(objects(spark, sf), grid(spark, sf), **ARGS)
    return out.select("id", "ratio", r("z_ceiling", 8).alias("z_ceiling"), "survives_z_cut")


@query("r4_grid_selection", f"{OBJ}, {keep_sql('sv')} SELECT id, ratio, survives_z_cut, kp.id IS NOT NULL AS keep FROM sv LEFT JOIN kp USING (id)")
def r4(spark, sf):
    out = SE.grid_selection(objects(spark, sf), grid(spark, sf), id_col="id", **ARGS)
    return out.select("id", "ratio", "survives_z_cut", "keep")


@query("r5_quotas", f"{OBJ}, {keep_sql('sv')} SELECT ratio, n, quota FROM kp_q")
def r5(spark, sf):
    seen = SE.diagnose(objects(spark, sf), grid(spark, sf), **ARGS)
    return SE.quotas(seen.where("survives_z_cut"), SE.SCALING_FACTOR, 12345)


MAG, TGT = (0.0, 15.0, 25.0, 35.0, 51.0), (0.0, 1.0, 2.0, 3.0, 5.0)


@query("r6_selection_summary", f"{OBJ}, {keep_sql('sv')}, x AS (SELECT mag, z, kp.id IS NOT NULL AS keep FROM sv LEFT JOIN kp USING (id)) " + " UNION ALL ".join(
    f"SELECT '{label} in [{a}, {b})' AS bin, count(*) AS n_all, count(*) FILTER (keep) AS n_selected, count(*) FILTER (keep) / greatest(count(*), 1)::DOUBLE AS fraction FROM x WHERE {col} >= {a} AND {col} < {b}"
    for label, col, edges in (("i", "mag", MAG), ("z", "z", TGT)) for a, b in zip(edges[:-1], edges[1:])))
def r6(spark, sf):
    out = SE.grid_selection(objects(spark, sf), grid(spark, sf), id_col="id", **ARGS)
    return SE.selection_summary(out, "mag", "z", "keep", MAG, TGT)


def split(spark: SparkSession, sf: str, share: float = 0.05, **options) -> SE.Split:
    """``share`` of the table as biased training rows."""
    df = objects(spark, sf)
    n = df.count()
    return SE.make_split(df, grid(spark, sf), id_col="id", n_train=max(20, int(share * n)), n_calibration=n // 50, tolerance=max(5, n // 100), **ARGS, **options)


@query("r7_holdout_solver")
def r7(spark, sf):
    """One row per pass of the solver; iterative, so there is no SQL twin."""
    return split(spark, sf).record(spark)


@query("r9_split")
def r9(spark, sf):
    """Biased, calibration and test rows with a size-matched control. The tests check sizes and disjointness."""
    return split(spark, sf, control=True).df.select("id", "mag", "z", "split", "control")


@query("r10_restricted_split")
def r10(spark, sf):
    """The hold-out may only come from finished orders."""
    done = I.table(spark, sf, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"))
    allowed = done.join(objects(spark, sf).select("id"), "id", "left_semi")
    return split(spark, sf, 0.14, holdout=allowed).df.select("id", "mag", "z", "split")


@query("r11_split_record")
def r11(spark, sf):
    """Rows and medians per subset of a split."""
    out = split(spark, sf)
    return SE.describe_subsets(out.df, "split", "mag", "z", 30.0)


@query("r13_bags", f"""WITH k AS (SELECT o_orderkey AS id, unnest(range(4)) AS member FROM orders), u AS (SELECT *, member || '/' || id AS key FROM k),
o AS (SELECT member, id, row_number() OVER (PARTITION BY member ORDER BY {uniform_sql('3', 'key')}, key) AS rn FROM u)
SELECT CAST(member AS BIGINT) AS member, id FROM o WHERE rn <= (SELECT CAST(round(count(*) * 0.4) AS BIGINT) FROM orders)""")
def r13(spark, sf):
    """Four bags of 40 %: without replacement within a bag, independent across bags."""
    o = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return SE.draw_bags(o, "id", 4, 0.4, 3).select(F.col("member").cast("long").alias("member"), "id")


@query("r14_permutation_split", f"SELECT id, CASE WHEN rn <= 200 THEN 'test' WHEN rn <= 500 THEN 'calibration' END AS split FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY {uniform_sql('9', 'o_orderkey')}, o_orderkey) AS rn FROM orders)")
def r14(spark, sf):
    o = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return SE.permutation_split(o, "id", {"test": 200, "calibration": 300}, 9)


@query("r15_masked_cells", f"""WITH {I.EV} SELECT id, CASE WHEN {uniform_sql('4', "'value'", 'id')} >= 0.25 THEN y END AS value,
CASE WHEN {uniform_sql('4', "'usr'", 'id')} >= 0.25 THEN usr END AS usr FROM ev""")
def r15(spark, sf):
    ev = I.events(spark, sf).select("id", F.col("y").alias("value"), "usr")
    return SE.mask_cells(ev, "id", ["value", "usr"], 0.25, 4)
