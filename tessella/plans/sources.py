"""Queries of the sources, sinks, input checks, streams and extension points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tessella.functions import histogram as H, quantile as Q
from tessella.functions.arrays import vector
from tessella.functions.grids import Bins, Grid
from tessella.operators import estimators as E, features as FE, metrics as M, validate as V
from tessella.plans import distributions as D, inputs as I
from tessella.plans.inputs import rounded as r
from tessella.plans.registry import query
from tessella.plans.scoring import scored
from tessella.session import scratch
from tessella.sources import catalog as S, ensembles as EN
from tessella.operators import states as SS
from tessella.streaming import scores as ST


@query("s1_catalog", "SELECT o_orderkey AS object_id, o_totalprice AS y, o_orderpriority, o_orderstatus FROM orders")
def s1(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return S.catalog(o, "o_totalprice", "o_orderkey")


@query("s1_catalog_row_counter", """SELECT row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount) - 1 AS object_id, l_quantity AS y, l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem""")
def s1_counter(spark, sf):
    """Line items have no unique key: a dense counter is made from their order."""
    li = I.table(spark, sf, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    return S.catalog(li, "l_quantity")


@query("s2_tagged_union", "SELECT CAST(source AS INTEGER) AS source, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT 0 AS source, o_totalprice AS v FROM orders UNION ALL SELECT 1, l_extendedprice FROM lineitem) GROUP BY source")
def s2(spark, sf):
    a = I.table(spark, sf, "orders").select(F.col("o_totalprice").alias("v"))
    b = I.table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("v"))
    return S.tagged_union(a, b).groupBy("source").agg(F.count("*").alias("n"), r(F.sum("v"), 2).alias("total")).select(F.col("source").cast("int").alias("source"), "n", "total")


@query("s3_typed_columns", "SELECT p_partkey AS object_id, p_retailprice AS y, CAST(CAST(p_size AS FLOAT) AS DOUBLE) AS size FROM part")
def s3(spark, sf):
    out = S.load(spark, f"{sf}/part.parquet", ["p_size"], "p_retailprice", "p_partkey")
    return out.select("object_id", "y", F.col("p_size").cast("double").alias("size"))


@query("s4_stored_probabilities", f"WITH {I.EV}, {I.grid_sql()}, n AS (SELECT {I.bin_sql('y')} AS bin, count(*) AS k FROM ev GROUP BY 1), d AS (SELECT g.bin, coalesce(k, 0) / sum(k) OVER () / w AS d FROM g LEFT JOIN n USING (bin)) SELECT id, round(d, 9) AS density FROM ev JOIN d ON d.bin = {I.bin_sql('y')}")
def s4(spark, sf):
    """One stored row of per-bin probabilities, repeated for every event and read at its truth."""
    ev = I.events(spark, sf)
    stored = I.GRID.table(spark).join(ev.groupBy(I.GRID.bin_index(F.col("y")).alias("bin")).agg(F.count("*").alias("p")), "bin", "left")
    out = E.stored_density(ev, stored.select("center", F.coalesce("p", F.lit(0)).alias("p")), "center", "p", I.GRID)
    return out.select("id", r(I.GRID.density_at(F.col("density"), F.col("y")), 9).alias("density"))


@query("s4_stored_samples", f"""WITH {I.EV}, s AS (SELECT i * 20.0::DOUBLE AS x, (SELECT count(*) FROM ev WHERE y >= i * 20.0 AND y < i * 20.0 + 20.0)::DOUBLE AS p FROM range(26) t(i)),
pc AS (SELECT * FROM (SELECT x AS a, lead(x) OVER (ORDER BY x) AS b, p, lead(p) OVER (ORDER BY x) AS q FROM s) WHERE b IS NOT NULL),
{I.grid_sql()}, m AS (SELECT bin, w, sum(0.5 * (p + q) * greatest(least(b, hi) - greatest(a, lo), 0)) AS m FROM g CROSS JOIN pc GROUP BY bin, w)
SELECT CAST(bin AS BIGINT) AS bin, round(m / sum(m) OVER () / w, 9) AS density, (SELECT count(*) FROM ev) AS n FROM m""")
def s4_samples(spark, sf):
    """A density sampled every 20 units, integrated exactly over the bins of 10."""
    ev = I.events(spark, sf)
    counts = ev.groupBy(F.floor(F.col("y") / 20.0).cast("int").alias("k")).agg(F.count("*").cast("double").alias("p"))
    samples = spark.range(26).select(F.col("id").cast("int").alias("k")).join(counts, "k", "left").select((F.col("k") * 20.0).alias("x"), F.coalesce("p", F.lit(0.0)).alias("p"))
    out = E.stored_density(ev, samples, "x", "p", I.GRID)
    one = out.groupBy("density").agg(F.count("*").alias("n")).select("n", F.posexplode("density").alias("bin", "d"))
    return one.select(F.col("bin").cast("long").alias("bin"), r("d", 9).alias("density"), "n")


PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")


@query("s6_ordered_codes", "SELECT o_orderkey AS id, CAST(5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS BIGINT) AS code FROM orders")
def s6(spark, sf):
    o = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    return FE.ordered_codes(o, "o_orderpriority", PRIORITIES, "code").select("id", F.col("code").cast("long").alias("code"))


@query("s8_histogram_export", f"""{I.ATOMS} SELECT sup, CAST(CASE WHEN bin > 2 THEN bin - 1 WHEN bin = 2 THEN 2 ELSE bin END AS BIGINT) AS bin, round(sum(p) / max(w), 9) AS pdf FROM p GROUP BY sup, CASE WHEN bin > 2 THEN bin - 1 WHEN bin = 2 THEN 2 ELSE bin END""")
def s8(spark, sf):
    """The zero-width bucket is merged into the one above it."""
    df = I.supplier_atoms(spark, sf).withColumn("p", H.probabilities("masses", I.ATOM_BINS))
    out = df.select("sup", F.posexplode(EN.histogram_pdfs("p", I.ATOM_BINS)).alias("bin", "d"))
    return out.select("sup", F.col("bin").cast("long").alias("bin"), r("d", 9).alias("pdf"))


@query("s9_histogram_round_trip", f"{I.USER} SELECT usr, CAST(bin AS BIGINT) AS bin, round(p, 9) AS mass FROM p")
def s9(spark, sf):
    """Written as a portable ensemble and read back."""
    path = scratch(spark)
    df = I.user_histograms(spark, sf).withColumn("p", H.probabilities("masses", I.GRID))
    EN.write_histograms(df, "p", I.GRID, path, ["usr"], {"source": "events"})
    back, _, _ = EN.read(spark, path)
    return back.select("usr", F.posexplode("masses").alias("bin", "m")).select("usr", F.col("bin").cast("long").alias("bin"), r("m", 9).alias("mass"))


@query("s9_quantile_round_trip", f"{I.UQ} SELECT usr, CAST(i AS BIGINT) AS i, round(lv, 6) AS level, round(v, 6) AS v FROM k")
def s9_quantiles(spark, sf):
    """Both tail ends are stored, at levels 0 and 1."""
    path = scratch(spark)
    df = I.user_quantiles(spark, sf).withColumn("l", Q.monotone("locs"))
    EN.write_quantiles(df, "l", I.LEVELS, path, ["usr"])
    back, _, axis = EN.read(spark, path)
    out = back.select("usr", F.posexplode(F.arrays_zip(vector(axis).alias("level"), "locs")).alias("i", "t"))
    return out.select("usr", F.col("i").cast("long").alias("i"), r("t.level").alias("level"), r("t.locs").alias("v"))


@query("s8_mixture_round_trip", f"{D.MIX} SELECT id, round(sum(wt * p * c), 6) AS mean FROM mx GROUP BY id")
def s8_mixture(spark, sf):
    """A mixture stored as its histogram on the union of edges, and read back."""
    path = scratch(spark)
    EN.write_mixture(D.mixture(spark, sf), path)
    back, _, axis = EN.read(spark, path)
    bins = Bins(tuple(axis))
    return back.withColumn("p", H.probabilities("masses", bins)).select("id", r(H.mean("p", bins)).alias("mean"))


# -- checks ---------------------------------------------------------------------------


@query("v1_feature_table", "SELECT event_id AS id, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, value FROM events")
def v1(spark, sf):
    """Strings that hold numbers are cast cell by cell; anything else would be refused."""
    ev = I.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.regexp_extract("props", "[0-9]+", 0).alias("k"), "value")
    return V.feature_table(ev, ["k", "value"], ["id"])


@query("v2_column_profile", """SELECT 'x' AS "column", count(*) AS n, count(*) FILTER (event_id % 9 = 1) AS n_missing, count(*) FILTER (event_id % 9 = 2) AS n_infinite FROM events UNION ALL SELECT 'value', count(*), 0, 0 FROM events""")
def v2(spark, sf):
    """Missing and infinite cells of every column in one pass; NaN and NULL both count as missing."""
    m = F.col("event_id") % 9
    x = F.when(m == 1, F.lit(float("nan"))).when(m == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    return V.column_profile(I.table(spark, sf, "events").select(x.alias("x"), "value"), ["x", "value"])


@query("v3_masked_cells", "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events")
def v3(spark, sf):
    ev = I.table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("id"), V.masked(F.col("value"), F.col("event_type") == "error").alias("value"))


@query("v4_target_check", f"WITH {I.EV} SELECT count(*) AS n, min(y) AS lo, max(y) AS hi FROM ev")
def v4(spark, sf):
    """A target that is finite everywhere passes; the aggregate is the check's by-product."""
    ev = I.events(spark, sf)
    n = V.check_target(ev, "y")
    return ev.agg(F.lit(n).cast("long").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))


@query("v5_aligned_columns", "SELECT value, event_id, user_id FROM events")
def v5(spark, sf):
    return V.align_columns(I.table(spark, sf, "events").select("user_id", "value", "event_id"), ["value", "event_id", "user_id"])


@query("v6_empty_result", f"WITH {I.EV} SELECT unnest(['density', 'fold', 'id', 'key', 'usr', 'y']) AS name, (SELECT count(*) FROM ev WHERE y < 0) AS n")
def v6(spark, sf):
    """No row in, no row out, with the columns that any rows would give: their names, and how many rows there are."""
    ev = I.events(spark, sf)
    out = E.DensityModel(["key"], grid=I.GRID).fit(ev).transform(ev.where("y < 0"), "density")
    names = F.lit(sorted(out.columns))
    return out.agg(F.count("*").alias("n")).select(F.explode(names).alias("name"), "n")


@query("v6_empty_fit", f"WITH {I.EV} SELECT count(*) AS n, true AS refused_empty, true AS refused_missing FROM ev")
def v6_fit(spark, sf):
    """Fitting refuses an empty table and one with missing targets."""
    ev = I.events(spark, sf)

    def refused(df) -> bool:
        try:
            E.DensityModel(["key"], grid=I.GRID).fit(df)
        except ValueError:
            return True
        return False

    empty, missing = refused(ev.where("y < 0")), refused(ev.withColumn("y", F.when(F.col("id") % 7 != 0, F.col("y"))))
    return ev.agg(F.count("*").alias("n"), F.lit(empty).alias("refused_empty"), F.lit(missing).alias("refused_missing"))


@query("v7_finite_pairs", "SELECT event_id AS id FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def v7(spark, sf):
    ev = I.events(spark, sf)
    a = F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("y"))
    b = F.when(F.col("id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("y"))
    return M.finite_pairs(ev.select("id", a.alias("a"), b.alias("b")), "a", "b").select("id")


@query("v8_finite_pits", f"{I.SCORES} SELECT key, count(*) AS n, round(avg(pit), 7) AS mean_pit FROM s WHERE id % 7 <> 0 AND id % 11 <> 0 GROUP BY key")
def v8(spark, sf):
    pit = F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 11 != 0, F.col("pit"))
    kept = M.finite_pairs(scored(spark, sf).withColumn("pit", pit), "pit")
    return kept.groupBy("key").agg(F.count("*").alias("n"), r(F.avg("pit"), 7).alias("mean_pit"))


@query("v9_take", f"WITH {I.EV} SELECT id, y FROM ev WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)")
def v9(spark, sf):
    rows = I.table(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("id"))
    return V.take(I.events(spark, sf), rows).select("id", "y")


@query("v11_duplicate_keys", 'SELECT l_orderkey, l_linenumber, count(*) AS "count" FROM lineitem GROUP BY ALL HAVING count(*) > 1')
def v11(spark, sf):
    return V.duplicate_keys(I.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("v12_clip_target", f"WITH {I.EV} SELECT id, least(greatest(y, 25.0), 150.0) AS y_clipped, y < 25 OR y > 150 AS outside FROM ev")
def v12(spark, sf):
    return V.clip_target(I.events(spark, sf), "y", 25.0, 150.0).select("id", "y_clipped", "outside")


@query("v12_outside_count", f"WITH {I.EV} SELECT count(*) FILTER (y < 25) AS below, count(*) FILTER (y > 150) AS above, count(*) AS n FROM ev")
def v12_count(spark, sf):
    """Targets outside a support, counted by the write that uses the clipped rows."""
    seen = Observation()
    V.clip_target(I.events(spark, sf), "y", 25.0, 150.0, seen=seen).write.parquet(scratch(spark))
    return spark.createDataFrame([(seen.get["below"], seen.get["above"], seen.get["n"])], "below long, above long, n long")


@query("v13_table_forms", "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS code, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def v13(spark, sf):
    """A table given as a path and one given as a DataFrame behave alike."""
    nation = V.as_table(spark, f"{sf}/nation.parquet")
    customers = V.as_table(spark, I.table(spark, sf, "customer"))
    counts = customers.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return nation.join(counts, "n_nationkey", "left").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("code"), F.coalesce("n", F.lit(0)).alias("n"))


@query("v14_bad_score_rows", f"WITH {I.EV} SELECT count(*) FILTER (y > 300) AS above_300, count(*) FILTER (y < 10) AS below_10, count(*) AS n FROM ev")
def v14(spark, sf):
    ev = I.events(spark, sf)
    found = V.bad_score_rows(ev, {"above_300": F.col("y") > 300, "below_10": F.col("y") < 10})
    return ev.agg(*[F.lit(n).cast("long").alias(name) for name, n in found.items()], F.count("*").alias("n"))


# -- streams ----------------------------------------------------------------------------


@query("l1_stream_scores", f"{I.SCORES} SELECT id, round(cde, 12) AS cde, round(pit, 8) AS pit, round(crps, 6) AS crps, round(nll, 7) AS nll FROM s")
def l1(spark, sf):
    """Predictions arrive as a stream of files; every score is the batch expression."""
    return spark.read.parquet(_streamed(spark, sf)).select("id", r("cde", 12).alias("cde"), r("pit", 8).alias("pit"), r("crps").alias("crps"), r("nll", 7).alias("nll"))


def _streamed(spark: SparkSession, sf: str) -> str:
    """The score table that a stream of prediction files has appended to."""
    source, scores, state = scratch(spark), scratch(spark), scratch(spark)
    batch = I.cross_predictions(spark, sf).select("id", "key", "y", "masses")
    batch.write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    out = ST.score_stream(stream, "masses", "y", I.GRID, ["id", "key"], point="mean")
    ST.append_scores(out, scores, state).awaitTermination()
    return scores


@query("l2_roll_up", f"{I.SCORES} SELECT key, count(*) AS n, round(avg(cde), 8) AS cde_loss, round(avg(crps), 6) AS crps, round(avg(nll), 6) AS nll FROM s GROUP BY key")
def l2(spark, sf):
    """The report over the appended score table."""
    out = ST.roll_up(spark, _streamed(spark, sf), ["key"], point="mean")
    return out.select("key", "n", r("cde_loss", 8).alias("cde_loss"), r("crps").alias("crps"), r("nll").alias("nll"))


def _stream_with_states(spark: SparkSession, sf: str) -> str:
    """The score table of two streamed batches, the second one replayed, with its states."""
    scores = scratch(spark)
    batch = score_table(spark, sf)
    for epoch in (0, 1, 1):
        ST.write_with_states(batch.where(F.col("id") % 2 == epoch), scores, epoch, ["key"])
    return scores


def score_table(spark: SparkSession, sf: str) -> DataFrame:
    out = ST.score_stream(I.cross_predictions(spark, sf), "masses", "y", I.GRID, ["id", "key"], point="mean")
    return out.withColumn("key", F.when(F.col("key") != "click", F.col("key")))


@query("l2_incremental_report", f"""{I.SCORES}, x AS (SELECT nullif(key, 'click') AS key, mean_pred - y AS e, * EXCLUDE (key) FROM s),
b AS (SELECT key, least(floor(pit * 20), 19) AS b, count(*)::DOUBLE AS c FROM x GROUP BY ALL), t AS (SELECT key, sum(c) AS n FROM b GROUP BY key),
kl AS (SELECT b.key, sum(c / n * ln(20 * c / n)) AS kl FROM b JOIN t ON b.key IS NOT DISTINCT FROM t.key GROUP BY b.key),
rep AS (SELECT key, count(*) AS n, avg(cde) AS cde_loss, avg(crps) AS crps, avg(nll) AS nll, quantile_cont(e, 0.5) AS bias, (quantile_cont(e, 0.75) - quantile_cont(e, 0.25)) / 1.349 AS sigma_iqr,
  avg(CAST(abs(e) > 0.15 AS INT)) AS outlier_rate_015, avg(CAST(pit < 1e-4 OR pit > 1 - 1e-4 AS INT)) AS pit_outlier_rate FROM x GROUP BY key)
SELECT rep.key, n, round(cde_loss, 8) AS cde_loss, round(crps, 6) AS crps, round(nll, 6) AS nll, round(bias, 6) AS bias, round(sigma_iqr, 6) AS sigma_iqr,
  round(outlier_rate_015, 8) AS outlier_rate_015, round(kl, 7) AS pit_kl, round(pit_outlier_rate, 8) AS pit_outlier_rate FROM rep JOIN kl ON rep.key IS NOT DISTINCT FROM kl.key""")
def l2_states(spark, sf):
    """The report from the batches' stored states, after one batch was replayed."""
    out = ST.incremental_report(spark, _stream_with_states(spark, sf), ["key"])
    digits = {"cde_loss": 8, "outlier_rate_015": 8, "pit_kl": 7, "pit_outlier_rate": 8}
    return out.select("key", "n", *[r(c, digits.get(c, 6)).alias(c) for c in out.columns if c not in ("key", "n")])


@query("a5_sketched_quantiles", f"WITH {I.EV}, l AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS level) SELECT key, CAST(level AS DOUBLE) AS level, true AS within FROM (SELECT DISTINCT key FROM ev), l")
def a5_sketches(spark, sf):
    """Sketches per type and fold, stored and merged per type: each answer's rank is within the stated error of the level."""
    levels = [0.05, 0.25, 0.5, 0.75, 0.95]
    ev = I.events(spark, sf)
    stored = scratch(spark)
    ev.groupBy("key", "fold").agg(SS.sketch("y").alias("sketch")).write.parquet(stored)
    merged = spark.read.parquet(stored).groupBy("key").agg(SS.merge_sketches("sketch").alias("sketch"))
    asked = merged.select("key", SS.sketched_quantiles("sketch", levels).alias("q"))
    rank = ev.join(asked, "key").groupBy("key").agg(*[F.avg((F.col("y") <= F.col("q")[i]).cast("double")).alias(f"r{i}") for i in range(len(levels))])
    rows = F.array(*[F.struct(F.lit(q).alias("level"), (F.abs(F.col(f"r{i}") - q) <= SS.SKETCH_ERROR).alias("within")) for i, q in enumerate(levels)])
    return rank.select("key", F.explode(rows).alias("x")).select("key", "x.level", "x.within")


# -- extension points ---------------------------------------------------------------------

TRIANGLE = Bins(tuple(np.linspace(0.0, 50.0, 6)))


def triangle(batch: pd.DataFrame) -> np.ndarray:
    """A stand-in for an external model: mass falls with a bin's distance from the price per part."""
    centers = TRIANGLE.centers
    return 1.0 / (1.0 + np.abs(centers[None, :] - batch[["qty"]].to_numpy()))


@query("u1_external_predictor", f"""{I.ORDERS}, m AS (SELECT id, i, 1.0 / (1.0 + abs(5.0 + 10.0 * i - qty)) AS m, 5.0 + 10.0 * i AS c FROM f, range(5) t(i))
SELECT id, round(sum(m * c) / sum(m), 7) AS mean FROM m GROUP BY id""")
def u1(spark, sf):
    df = I.order_features(spark, sf)
    out = E.apply_predictor(df, ["qty"], triangle, 5, id_col="id", bins=TRIANGLE)
    out = out.withColumn("p", H.probabilities("masses", TRIANGLE))
    return out.select("id", r(H.mean("p", TRIANGLE), 7).alias("mean"))


@query("u2_density_model", f"""WITH {I.EV}, a AS (SELECT min(y) AS lo, (max(y) - min(y)) / 50 AS w FROM ev), n AS (SELECT key, least(floor((y - lo) / w), 49) AS b, count(*) AS c FROM ev, a GROUP BY ALL)
SELECT e.id, round(sum(c * least(greatest((e.y - (lo + b * w)) / w, 0), 1)) / sum(c), 7) AS pit FROM ev e JOIN n USING (key), a GROUP BY e.id""")
def u2(spark, sf):
    """fit(df) is a Spark job, transform(df) a join with the small fitted table."""
    ev = I.events(spark, sf)
    return E.DensityModel(["key"]).fit(ev).transform(ev, "pit").select("id", r("pit", 7).alias("pit"))


@query("u2_unseen_key", f"""WITH {I.EV}, q AS (SELECT id, y, CASE WHEN key <> 'view' THEN key END AS key FROM ev), ctx AS (SELECT * FROM q WHERE key IS DISTINCT FROM 'click'),
a AS (SELECT min(y) AS lo, (max(y) - min(y)) / 50 AS w FROM ctx), n AS (SELECT key, least(floor((y - lo) / w), 49) AS b, count(*) AS c FROM ctx, a GROUP BY ALL),
t AS (SELECT b, sum(c) AS c FROM n GROUP BY b), r AS (SELECT id, y, b, c FROM q JOIN n ON q.key IS NOT DISTINCT FROM n.key UNION ALL SELECT id, y, b, c FROM q, t WHERE key = 'click')
SELECT id, round(sum(c * least(greatest((y - (lo + b * w)) / w, 0), 1)) / sum(c), 7) AS pit FROM r, a GROUP BY id""")
def u2_unseen(spark, sf):
    """Every row gets a prediction: NULL is a key, and a key the context lacks gets the context's marginal."""
    ev = I.events(spark, sf).withColumn("key", F.when(F.col("key") != "view", F.col("key")))
    model = E.DensityModel(["key"]).fit(ev.where(~F.col("key").eqNullSafe("click")))
    return model.transform(ev, "pit").select("id", r("pit", 7).alias("pit"))


@query("u3_custom_scorer", f"{I.UQ}, m AS (SELECT usr, v FROM qq WHERE i = 10) SELECT -round(avg(abs(y - v)), 6) AS score FROM ev JOIN m USING (usr)")
def u3(spark, sf):
    """Minus the mean absolute error of the predicted medians."""
    df = I.events(spark, sf).join(I.user_quantiles(spark, sf).select("usr", F.col("locs")[9].alias("m")), "usr")
    return df.agg((-r(F.avg(F.abs(F.col("y") - F.col("m"))))).alias("score"))


@query("u5_wide_scan", f"""WITH o AS (SELECT o_orderkey AS id, sqrt(o_totalprice) AS y, o_orderpriority AS priority FROM orders), {I.grid_sql('g', 0.0, 710.0, 1000)},
{I.masses_sql('priority', 'count(*)', 'o', low=0.0, high=710.0, n=1000)}, {I.probs_sql('priority')}
SELECT o.id, round(f0 + p * (y - lo) / w, 8) AS pit FROM o JOIN p ON p.priority = o.priority AND p.bin = {I.bin_sql('y', 0.0, 710.0, 1000)}""")
def u5(spark, sf):
    """A thousand buckets: the running sum is a vector kernel over Arrow batches."""
    grid = Grid.linear(0.0, 710.0, 1000, normalization="histogram")
    o = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.sqrt("o_totalprice").alias("y"))
    # One CDF per priority, then a narrow lookup per order.
    fitted = E.bin_shares(o, "y", grid, ["priority"]).withColumn("d", grid.normalize("masses")).withColumn("f", grid.cdf("d"))
    df = E.predict(o, fitted.select("priority", "d", "f"), ["priority"])
    k = grid.bin_index(F.col("y"))
    # The CDF at the bin's center moved to the truth inside the bin.
    own = F.element_at("d", k + 1) * (F.col("y") - (k + 0.5) * 0.71)
    return df.select("id", r(F.element_at("f", k + 1) + own, 8).alias("pit"))


class OnGrid(E.DensityModel):
    """Bin shares on the shared grid."""

    def _fit(self, df, low, high):
        self.bins = Bins(I.GRID.edges)
        self.table = E.bin_shares(df, self.y, self.bins, self.keys)
        self.marginal = E.overall(df, lambda rows, keys: E.bin_shares(rows, self.y, self.bins, keys))


SHARES = f"WITH {I.EV}, {I.grid_sql()}, {I.masses_sql('key', 'count(*)')}, {I.probs_sql('key')}"


@query("d7_model_outputs", f"""{I.CROSS.split('cf_n AS')[0].rstrip().rstrip(',')}, {I.masses_sql('key', 'count(*)')}, {I.probs_sql('key')}
SELECT e.id, round(p.p / p.w, 9) AS density, round(f0 + p.p * (e.y - lo) / w, 8) AS pit FROM ev e JOIN p ON p.key = e.key AND p.bin = {I.bin_sql('e.y')}""")
def d7(spark, sf):
    """Density and PIT of one fitted model through its wrapper."""
    ev = I.events(spark, sf)

    model = OnGrid(["key"], grid=I.GRID).fit(ev)
    both = model.transform(model.transform(ev, "density"), "pit")
    return both.select("id", r(I.GRID.density_at(F.col("density"), F.col("y")), 9).alias("density"), r("pit", 8).alias("pit"))


@query("d7_quantile_model", f"""WITH {I.EV}, {I.quantile_knots_sql('ev', 'key', 'y')},
pit AS (SELECT e.id, sum((l1 - l0) * CASE WHEN a = b THEN CAST(a <= e.y AS INT) ELSE least(greatest((e.y - a) / (b - a), 0), 1) END) AS pit FROM ev e JOIN seg USING (key) GROUP BY e.id),
o AS (SELECT key, sum((l1 - l0) * CASE WHEN a = b THEN CAST(a <= 42 AS INT) ELSE least(greatest((42.0 - a) / (b - a), 0), 1) END) AS cdf,
  max(CASE WHEN l0 <= 0.5 AND l1 > 0.5 THEN a + (b - a) * (0.5 - l0) / (l1 - l0) END) AS median, max(CASE WHEN l0 <= 0.16 AND l1 > 0.16 THEN a + (b - a) * (0.16 - l0) / (l1 - l0) END) AS low,
  max(CASE WHEN l0 <= 0.84 AND l1 > 0.84 THEN a + (b - a) * (0.84 - l0) / (l1 - l0) END) AS high FROM seg GROUP BY key)
SELECT e.id, round(pit, 7) AS pit, round(cdf, 7) AS cdf, round(median, 6) AS median, round(low, 6) AS low, round(high, 6) AS high FROM ev e JOIN pit USING (id) JOIN o USING (key)""")
def d7_quantiles(spark, sf):
    """A model that predicts quantiles, through the same wrapper; its feature comes under another name, by position."""
    ev = I.events(spark, sf)
    model = E.QuantileModel(["key"], grid=I.GRID, levels=I.LEVELS).fit(ev)
    rows = ev.select("id", F.col("key").alias("x0"), "y")
    for output, options in (("pit", {}), ("cdf", {"values": [42.0]}), ("quantiles", {"levels": [0.5]}), ("interval", {"confidence": 0.68})):
        rows = model.transform(rows, output, **options)
    return rows.select("id", r("pit", 7).alias("pit"), r(F.col("cdf")[0], 7).alias("cdf"), r(F.col("quantiles")[0]).alias("median"), r("interval.lo").alias("low"), r("interval.hi").alias("high"))


@query("d7_mixture_model", f"""WITH {I.EV}, a AS (SELECT min(y) AS lo, max(y) - min(y) AS w FROM ev),
n AS (SELECT key, least(floor((y - lo) / w * 50), 49) AS b, count(*) AS c FROM ev, a GROUP BY ALL), m AS (SELECT fold, least(floor((y - lo) / w * 20), 19) AS b, count(*) AS c FROM ev, a GROUP BY ALL),
p AS (SELECT e.id, sum(c * least(greatest((e.y - lo) / w * 50 - b, 0), 1)) / sum(c) AS pit FROM ev e JOIN n USING (key), a GROUP BY e.id),
q AS (SELECT e.id, sum(c * least(greatest((e.y - lo) / w * 20 - b, 0), 1)) / sum(c) AS pit FROM ev e JOIN m USING (fold), a GROUP BY e.id)
SELECT id, round(0.75 * p.pit + 0.25 * q.pit, 7) AS pit FROM p JOIN q USING (id)""")
def d7_mixture(spark, sf):
    """A mixture of two models with bins of their own, three to one, as one histogram per row."""
    ev = I.events(spark, sf)
    parts = [E.DensityModel(["key"], grid=I.GRID), E.DensityModel(["fold"], grid=I.GRID, n_bins=20)]
    model = E.MixtureModel(["key", "fold"], grid=I.GRID, members=parts, weights=[3.0, 1.0]).fit(ev)
    return model.transform(ev, "pit").select("id", r("pit", 7).alias("pit"))


@query("c20_evaluate", f"""{I.CROSS.split('cf_n AS')[0].rstrip().rstrip(',')}, {I.masses_sql('key', 'count(*)')}, {I.probs_sql('key')},
r AS (SELECT e.id, e.key, p.p, w, {I.bin_sql('e.y')} = p.bin AS own FROM ev e JOIN p USING (key)), s AS (SELECT id, key, sum(p*p/w) - 2 * sum(CASE WHEN own THEN p/w ELSE 0 END) AS cde FROM r GROUP BY ALL)
SELECT key, count(*) AS n, round(avg(cde), 8) AS cde_loss FROM s GROUP BY key""")
def c20(spark, sf):
    ev = I.events(spark, sf)
    return OnGrid(["key"], grid=I.GRID).fit(ev).evaluate(ev, "mean", ["key"]).select("key", "n", r("cde_loss", 8).alias("cde_loss"))


@query("c20_score", f"""{SHARES}, q AS (SELECT key, sum(p * p / w) AS square FROM p GROUP BY key)
SELECT count(*) AS n, round(-avg(square - 2 * p.p / p.w), 8) AS score FROM ev e JOIN q USING (key) JOIN p ON p.key = e.key AND p.bin = {I.bin_sql('e.y')}""")
def c20_score(spark, sf):
    ev = I.events(spark, sf)
    score = OnGrid(["key"], grid=I.GRID).fit(ev).score(ev)
    return ev.agg(F.count("*").alias("n"), F.round(F.lit(score), 8).alias("score"))


@query("d7_all_outputs", f"""{SHARES}, o AS (SELECT key,
  sum(CASE WHEN 42.0 >= lo AND 42.0 < hi THEN p / w END) AS pdf, sum(p * least(greatest((200.0 - lo) / w, 0), 1)) AS cdf,
  min(lo + least(greatest((0.5 - f0) / p, 0), 1) * w) FILTER (p > 0 AND f1 >= 0.5) AS median, min(lo + least(greatest((0.16 - f0) / p, 0), 1) * w) FILTER (p > 0 AND f1 >= 0.16) AS low,
  min(lo + least(greatest((0.84 - f0) / p, 0), 1) * w) FILTER (p > 0 AND f1 >= 0.84) AS high, sum(p * c) AS mean, arg_max(c, p) AS mode FROM p GROUP BY key)
SELECT e.id, round(pdf, 9) AS pdf, round(cdf, 8) AS cdf, round(median, 6) AS median, round(low, 6) AS low, round(high, 6) AS high, round(mean, 6) AS mean, round(mode, 6) AS mode FROM ev e JOIN o USING (key)""")
def d7_all(spark, sf):
    """The other outputs of the wrapper: density and CDF at shared values, quantiles, the central interval, point estimates."""
    ev = I.events(spark, sf)
    model = OnGrid(["key"], grid=I.GRID).fit(ev)
    rows = ev.select("id", "key", "y")
    for output, options in (("pdf", {"values": [42.0]}), ("cdf", {"values": [200.0]}), ("quantiles", {"levels": [0.5]}), ("interval", {"confidence": 0.68})):
        rows = model.transform(rows, output, **options)
    rows = model.transform(rows, "point", point="mean").withColumnRenamed("point", "mean")
    rows = model.transform(rows, "point", point="mode").withColumnRenamed("point", "mode")
    return rows.select("id", r(F.col("pdf")[0], 9).alias("pdf"), r(F.col("cdf")[0], 8).alias("cdf"), r(F.col("quantiles")[0]).alias("median"),
                       r("interval.lo").alias("low"), r("interval.hi").alias("high"), r("mean").alias("mean"), r("mode").alias("mode"))
