"""Queries of the analysis recipes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import histogram as H, points as P
from tessella.functions.grids import Bins, Grid
from tessella.operators import estimators as E, recipes as R, sweeps as SW
from tessella.plans import inputs as I, scoring as SC
from tessella.plans.inputs import rounded as r, uniform_sql
from tessella.plans.registry import query


def typed(spark, sf) -> DataFrame:
    return I.cross_predictions(spark, sf).withColumn("p", H.probabilities("masses", I.GRID))


@query("y1_region_probability", f"{I.CROSS}, x AS (SELECT e.key, e.id, sum(p * greatest(least(hi, 35.0) - lo, 0) / w) AS below, 1 - sum(p * greatest(least(hi, 120.0) - lo, 0) / w) AS above FROM ev e JOIN p USING (key, fold) GROUP BY ALL) SELECT key, round(avg(below), 8) AS below, round(avg(above), 8) AS above, count(*) FILTER (above > 0.08) AS n_likely FROM x GROUP BY key")
def y1(spark, sf):
    df = R.region_probability(R.region_probability(typed(spark, sf), "p", I.GRID, below=35.0, name="below"), "p", I.GRID, above=120.0, name="above")
    return df.groupBy("key").agg(r(F.avg("below"), 8).alias("below"), r(F.avg("above"), 8).alias("above"), F.count_if(F.col("above") > 0.08).alias("n_likely"))


# Whole-number quantities per supplier, smoothed by the supplier's own histogram of width 2.5.
QBINS = Bins(tuple(np.linspace(0.0, 50.0, 21)))
QLEVELS = list(range(1, 50))
QSQL = f"""WITH li AS (SELECT l_suppkey AS sup, l_quantity AS q FROM lineitem), {I.grid_sql('g', 0.0, 50.0, 20)}, {I.masses_sql('sup', 'count(*)', 'li', x='q', low=0.0, high=50.0, n=20)}, {I.probs_sql('sup')}"""


def quantities(spark, sf) -> DataFrame:
    li = I.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sup"), F.col("l_quantity").alias("y"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"))
    return li.join(E.bin_shares(li, "y", QBINS, ["sup"]), "sup").withColumn("p", H.probabilities("masses", QBINS))


@query("y2_level_probabilities", f"""{QSQL}, lv AS (SELECT unnest(range(1, 50)) AS k), pl AS (SELECT sup, k, sum(p * greatest(least(hi, k + 0.5) - greatest(lo, k - 0.5), 0) / w) AS pr FROM p CROSS JOIN lv GROUP BY ALL),
ns AS (SELECT sup, count(*) AS n FROM li GROUP BY sup) SELECT k AS level, round(sum(pr * n) / sum(n), 8) AS predicted, (SELECT count(*) FROM li WHERE q = k) / (SELECT count(*) FROM li)::DOUBLE AS observed FROM pl JOIN ns USING (sup) GROUP BY k""")
def y2(spark, sf):
    # Levels are read once per supplier, and equal quantities of a supplier are one row with their count.
    li = I.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sup"), F.col("l_quantity").alias("y"))
    shares = E.bin_shares(li, "y", QBINS, ["sup"]).withColumn("p", H.probabilities("masses", QBINS))
    prob = shares.select("sup", R.level_probabilities("p", QBINS, QLEVELS).alias("prob"))
    df = li.groupBy("sup", "y").agg(F.count("*").alias("n")).join(prob, "sup")
    out = R.predicted_and_observed(df, "prob", "y", QLEVELS, "n")
    return out.select(F.col("level").cast("long").alias("level"), r("predicted", 8).alias("predicted"), "observed")


@query("y2_most_probable_level", f"{QSQL}, lv AS (SELECT unnest(range(1, 50)) AS k), pl AS (SELECT sup, k, round(sum(p * greatest(least(hi, k + 0.5) - greatest(lo, k - 0.5), 0) / w), 9) AS pr FROM p CROSS JOIN lv GROUP BY ALL), b AS (SELECT sup, max(pr) AS top FROM pl GROUP BY sup) SELECT sup, round(top, 7) AS top FROM b")
def y2_mode(spark, sf):
    """The probability of the most probable level (which level it is may tie)."""
    df = quantities(spark, sf).select("sup", "p").dropDuplicates(["sup"])
    return df.select("sup", r(F.array_max(R.level_probabilities("p", QBINS, QLEVELS)), 7).alias("top"))


@query("y3_randomized_pit", f"""{QSQL}, x AS (SELECT l.l_suppkey AS sup, l_quantity AS y, {uniform_sql('2', "concat_ws('/', l_orderkey, l_linenumber, l_partkey)")} AS u FROM lineitem l),
z AS (SELECT x.sup, y, u, sum(p * least(greatest((y - 0.5 - lo) / w, 0), 1)) AS a, sum(p * least(greatest((y + 0.5 - lo) / w, 0), 1)) AS b FROM (SELECT *, row_number() OVER () AS rn FROM x) x JOIN p USING (sup) GROUP BY x.sup, y, u, rn)
SELECT sup, count(*) AS n, round(avg(a + u * (b - a)), 8) AS mean_pit FROM z GROUP BY sup""")
def y3(spark, sf):
    df = quantities(spark, sf)
    key = F.concat_ws("/", "ok", "ln", "pk")
    out = df.withColumn("pit", R.randomized_pit("p", QBINS, F.col("y"), 2, key))
    return out.groupBy("sup").agg(F.count("*").alias("n"), r(F.avg("pit"), 8).alias("mean_pit"))


PRICE = Grid(tuple(np.geomspace(1.0, 512.0, 28)), "histogram")
LOGP = Grid(tuple(np.log(np.geomspace(1.0, 512.0, 28))), "histogram")


@query("y4_change_of_variable", f"""WITH {I.EV}, x AS (SELECT key, CAST(least(greatest(floor(ln(greatest(y, 1.0)) / (ln(512.0) / 27)), 0), 26) AS INTEGER) AS bin, ln(1 + y) AS wt FROM ev), n AS (SELECT key, bin, sum(wt) AS m FROM x GROUP BY ALL)
SELECT key, CAST(bin AS BIGINT) AS bin, round(m / sum(m) OVER (PARTITION BY key) / (exp((bin + 1) * ln(512.0) / 27) - exp(bin * ln(512.0) / 27)), 8) AS density FROM n""")
def y4(spark, sf):
    """Densities learned on log y, brought back to y by mass over width."""
    ev = I.events(spark, sf).withColumn("logy", F.ln(F.greatest("y", F.lit(1.0))))
    sums = ev.groupBy("key", LOGP.locate(F.col("logy")).alias("bin")).agg(F.sum(F.log1p("y")).alias("m"))
    hist = E.pivot_counts(sums, ["key"], "bin", "m", LOGP.n).withColumn("d", LOGP.normalize("masses"))
    out = hist.select("key", F.posexplode(R.change_of_variable("d", LOGP, PRICE)).alias("bin", "v")).where("v > 0")
    return out.select("key", F.col("bin").cast("long").alias("bin"), r("v", 8).alias("density"))


@query("y5_conditional_coverage", f"""{I.UQ}, w AS (SELECT usr, max(v) FILTER (i = 3) AS lo, max(v) FILTER (i = 10) AS mid, max(v) FILTER (i = 17) AS hi, count(*) AS x FROM qq GROUP BY usr),
j AS (SELECT ev.usr, y, lo, mid, hi, CASE WHEN usr <= 40 AND usr > -1 THEN 0 WHEN usr <= 90 THEN 1 WHEN usr <= 200 THEN 2 END AS bin FROM ev JOIN w USING (usr))
SELECT bin, count(*) AS n, avg(CAST(y BETWEEN lo AND hi AS INT)) AS coverage, round(quantile_cont((hi - lo) / mid, 0.5), 6) AS relative_width FROM j WHERE bin IS NOT NULL GROUP BY bin""")
def y5(spark, sf):
    q = I.user_quantiles(spark, sf).select("usr", F.col("locs")[2].alias("lo"), F.col("locs")[9].alias("mid"), F.col("locs")[16].alias("hi"))
    df = I.events(spark, sf).join(q, "usr")
    out = R.conditional_coverage(df, "y", "lo", "mid", "hi", "usr", [-1.0, 40.0, 90.0, 200.0])
    return out.select(F.col("bin").cast("int").alias("bin"), "n", "coverage", r("relative_width").alias("relative_width"))


@query("y6_peaks", f"""{I.USER}, t AS (SELECT usr, max(m) AS top FROM h GROUP BY usr),
c AS (SELECT * FROM (SELECT h.usr, bin, m, top, lag(m) OVER x AS a, lead(m) OVER x AS b FROM h JOIN t USING (usr) WINDOW x AS (PARTITION BY h.usr ORDER BY bin)) WHERE m > a AND m > b AND m >= 0.1 * top),
l AS (SELECT c.usr, c.bin, coalesce(max(h.bin) FILTER (h.m > c.m AND h.bin < c.bin), -1) AS pl, coalesce(min(h.bin) FILTER (h.m > c.m AND h.bin > c.bin), 50) AS pr FROM c JOIN h ON h.usr = c.usr GROUP BY ALL),
q AS (SELECT c.usr, c.bin, any_value(c.m) AS m, any_value(c.top) AS top, min(h.m) FILTER (h.bin < c.bin AND h.bin > pl) AS ml, min(h.m) FILTER (h.bin > c.bin AND h.bin < pr) AS mr FROM c JOIN l ON l.usr = c.usr AND l.bin = c.bin JOIN h ON h.usr = c.usr GROUP BY c.usr, c.bin)
SELECT u.usr, count(q.bin) FILTER (q.m - greatest(coalesce(ml, q.m), coalesce(mr, q.m)) >= 0.1 * q.top) AS n_peaks FROM (SELECT DISTINCT usr FROM ev) u LEFT JOIN q ON q.usr = u.usr GROUP BY u.usr""")
def y6(spark, sf):
    return I.user_histograms(spark, sf).select("usr", P.peaks("masses").cast("long").alias("n_peaks"))


@query("y7_estimate_spread", f"""{I.USER}, d AS (SELECT usr, bin, c, p / w AS d, p AS mass FROM p), pk AS (SELECT usr, arg_max(bin, d) AS k, max(d) AS top, arg_max(c, d) AS mode, sum(mass * c) AS mean FROM d GROUP BY usr)
SELECT pk.usr, round(pk.mean, 6) AS mean, mode, round(d.d / top, 8) AS mean_over_mode FROM pk JOIN d ON d.usr = pk.usr AND d.bin = {I.bin_sql('pk.mean')}""")
def y7(spark, sf):
    df = I.user_histograms(spark, sf).withColumn("d", I.GRID.normalize("masses"))
    return R.estimate_spread(df, "d", I.GRID).select("usr", r("mean").alias("mean"), "mode", r("mean_over_mode", 8).alias("mean_over_mode"))


def priced(spark, sf) -> DataFrame:
    """``(id, key, status, y)`` of every order; the target is the price per thousand."""
    return I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") / 1000.0).alias("y"))


PRICES = Grid.linear(0.0, 500.0, 50, normalization="histogram")
PRICED = "o AS (SELECT o_orderkey AS id, o_orderpriority AS key, o_orderstatus AS status, o_totalprice / 1000.0 AS y FROM orders)"


def steps_sql(labels: list[str], test: str, key: str = "key", of: str = "step") -> str:
    """The report of ``test(report, step, id, key, y)`` under the densities of ``cx(step, key, y)``; keys that a context lacks take all of it."""
    names = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels))
    return f"""{I.grid_sql()},
nk AS (SELECT step, {key} AS key, {I.bin_sql('y')} AS bin, count(*)::DOUBLE AS m FROM cx GROUP BY ALL),
na AS (SELECT step, bin, sum(m) AS m FROM nk GROUP BY ALL),
sk AS (SELECT DISTINCT step, key FROM {test}),
h AS (SELECT sk.step, sk.key, g.bin, lo, hi, c, w, coalesce(CASE WHEN EXISTS (SELECT 1 FROM nk x WHERE x.step = sk.step AND x.key = sk.key) THEN nk.m ELSE na.m END, 0.0) AS m
  FROM sk CROSS JOIN g LEFT JOIN nk ON nk.step = sk.step AND nk.key = sk.key AND nk.bin = g.bin LEFT JOIN na ON na.step = sk.step AND na.bin = g.bin),
{I.probs_sql('step, key')},
r AS (SELECT e.id, e.report, e.y, p.bin, lo, hi, c, w, p.p, f0, f1, f0 + p.p * (least(greatest(e.y, lo), hi) - lo) / w AS fc,
  {I.bin_sql('e.y')} = p.bin AS own FROM {test} e JOIN p ON p.step = e.step AND p.key IS NOT DISTINCT FROM e.key),
s AS (SELECT id, report, any_value(y) AS y, sum(p*p/w) - 2*sum(CASE WHEN own THEN p/w ELSE 0 END) AS cde, least(sum(CASE WHEN own THEN fc ELSE 0 END), 1) AS pit,
  sum({I.CRPS_SQL}) AS crps, -ln(greatest(sum(CASE WHEN own THEN p/w ELSE 0 END), 1e-12)) AS nll, sum(p*c) AS mean_pred FROM r GROUP BY id, report),
names AS (SELECT * FROM (VALUES {names}) t(g, model)),
""" + SC.REPORT_SQL.format(
        points=SC.points_sql("none", "report"), pits=SC.pit_sql("report"), by="report", lead="model,", point_out=SC.POINT_OUT, pit_out=SC.PIT_OUT) + " JOIN names USING (g)"


def step_rows(out: DataFrame, *lead: str) -> DataFrame:
    return out.select("model", *lead, "n", *SC.neat(out, *[c for c in SC.SUMMARY[1:] if c != "pit_ks_pvalue"]))


@query("y8_bias_repair", f"""WITH {PRICED}, rk AS (SELECT *, row_number() OVER (ORDER BY {uniform_sql('0', 'id')}, id) AS rank FROM o WHERE status = 'P'),
st AS (SELECT * FROM (VALUES (0, 0), (1, 50), (2, 200)) t(step, size)),
cx AS (SELECT step, key, y FROM o CROSS JOIN st WHERE status = 'F' AND y < 200 UNION ALL SELECT step, key, y FROM rk JOIN st ON rank <= size),
te AS (SELECT step AS report, step, id, key, y FROM o CROSS JOIN st), {steps_sql(['biased + 0', 'biased + 50', 'biased + 200'], 'te')}""")
def y8(spark, sf):
    """Finished orders with low prices as a biased context, repaired by ever more pending ones;
    every order is scored. One report row per size, all from one fit."""
    orders = priced(spark, sf)
    biased, calibration = orders.where("status = 'F' AND y < 200"), orders.where("status = 'P'")
    return step_rows(SW.bias_repair(biased, calibration, orders.drop("status"), "y", ["key"], PRICES, PRICES, [0, 50, 200], point="mean"))


@query("y9_learning_curve", f"""WITH {PRICED}, rk AS (SELECT *, row_number() OVER (ORDER BY {uniform_sql('0', 'id')}, id) AS rank FROM o),
st AS (SELECT * FROM (VALUES (0, 100), (1, 400), (2, 1000)) t(step, size)), cx AS (SELECT step, key, y FROM rk JOIN st ON rank <= size),
te AS (SELECT step AS report, step, id, key, y FROM o CROSS JOIN st), {steps_sql(['100', '400', '1000'], 'te')}""")
def y9(spark, sf):
    orders = priced(spark, sf).drop("status")
    return step_rows(SW.learning_curve(orders, orders, "y", ["key"], PRICES, PRICES, [100, 400, 1000], point="mean"))


def importance_score(df: DataFrame) -> float:
    """Minus the mean distance of the value from a simple prediction."""
    guess = F.col("a") * 0.8 + F.col("b") * 0.1
    return -df.agg(F.avg(F.abs(F.col("y") - guess))).first()[0]


def shuffled_sql(feature: str, repeat: int) -> str:
    """Each row's loss with one feature dealt to other rows by random ranks."""
    key = f"1/{feature}/{repeat}"
    loss = f"abs(y - (0.8 * {'v.x' if feature == 'a' else 'd.a'} + 0.1 * {'v.x' if feature == 'b' else 'd.b'}))"
    return f"""SELECT '{feature}' AS feature, {repeat} AS repeat, avg({loss}) AS loss FROM d
  JOIN (SELECT id, row_number() OVER (ORDER BY {uniform_sql(key + '/rows', 'id')}, id) AS rk FROM d) r USING (id)
  JOIN (SELECT {feature} AS x, row_number() OVER (ORDER BY {uniform_sql(key + '/values', 'id')}, id) AS rk FROM d) v USING (rk)"""


@query("y10_permutation_importance", f"""{I.ORDERS}, d AS (SELECT id, ext AS a, qty AS b, ext AS y FROM f), base AS (SELECT avg(abs(y - (0.8 * a + 0.1 * b))) AS loss FROM d),
s AS ({' UNION ALL '.join(shuffled_sql(x, k) for x in 'ab' for k in range(3))})
SELECT feature, round(avg(s.loss - base.loss), 3) AS mean, round(stddev_pop(s.loss - base.loss), 3) AS std FROM s, base GROUP BY feature""")
def y10(spark, sf):
    """Three repeats per feature; values are dealt to other rows by their random ranks."""
    df = I.order_features(spark, sf).select("id", F.col("ext").alias("a"), F.col("qty").alias("b"), F.col("ext").alias("y"))
    out = R.permutation_importance(df, ["a", "b"], importance_score, repeats=3, seed=1)
    return out.select("feature", r("mean", 3).alias("mean"), r("std", 3).alias("std"))


@query("y11_temperature_sweep", f"""{I.USER}, t AS (SELECT unnest([0.7, 0.9, 1.1, 1.3])::DOUBLE AS t), z AS (SELECT usr, bin, lo, w, t, exp(ln(1 + m) / t) AS e FROM h CROSS JOIN t),
s AS (SELECT usr, bin, lo, w, t, e / sum(e) OVER (PARTITION BY usr, t) AS p FROM z), x AS (SELECT ev.id, t, sum(p * least(greatest((y - lo) / w, 0), 1)) AS pit FROM ev JOIN s USING (usr) GROUP BY ALL)
SELECT t AS temperature, avg(CAST(abs(pit - 0.5) <= 0.34 AS INT)) AS coverage FROM x GROUP BY t""")
def y11(spark, sf):
    logits = I.user_histograms(spark, sf).select("usr", F.transform("masses", lambda m: F.log1p(m)).alias("z"))
    df = I.events(spark, sf).join(logits, "usr")
    return R.temperature_sweep(df, "z", I.GRID, "y", [0.7, 0.9, 1.1, 1.3])


@query("y12_k_fold_score", f"{I.SCORES.replace('CAST(floor(' + uniform_sql('fold', 'event_id') + ' * 5) AS INTEGER) AS fold', 'CAST(floor(' + uniform_sql('6', 'event_id') + ' * 4) AS INTEGER) AS fold')} SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n, round(-avg(cde), 8) AS score FROM s GROUP BY fold")
def y12(spark, sf):
    """Four hashed folds, each scored by the other three, in one pass over the table."""
    from tessella.functions import scores as C

    ev = R.folds(I.events(spark, sf).drop("fold"), "id", 4, 6)
    pred = ev.join(E.cross_fitted(ev, "y", I.GRID, ["key"], "fold"), ["key", "fold"]).withColumn("d", I.GRID.normalize("masses"))
    pred = pred.withColumn("cde", C.cde("d", I.GRID, F.col("y")))
    out = pred.groupBy("fold").agg(F.count("*").alias("n"), r(-F.avg("cde"), 8).alias("score"))
    return out.select(F.col("fold").cast("long").alias("fold"), "n", "score")


def hidden_sql(tag: str, share: str) -> str:
    return f"CASE WHEN {uniform_sql('0/' + tag, chr(39) + 'key' + chr(39), 'id')} >= {share} THEN key END"


@query("y13_missing_data_stress", f"""WITH {I.EV}, cv AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 0.0), (2, 0.5)) t(step, f)),
cx AS (SELECT step, {hidden_sql('context', 'f')} AS key, y FROM ev CROSS JOIN cv),
tv AS (SELECT * FROM (VALUES (0, 0, 0.0::DOUBLE), (1, 1, 0.0), (2, 0, 0.5), (3, 2, 0.5)) t(report, step, f)),
te AS (SELECT report, step, id, {hidden_sql('test', 'f')} AS key, y FROM ev CROSS JOIN tv),
{steps_sql(['test', 'both', 'test', 'both'], 'te').replace('SELECT model,', "SELECT model, CASE WHEN g < 2 THEN 0.0::DOUBLE ELSE 0.5 END AS fraction,")}""")
def y13(spark, sf):
    """Cells masked in the test rows only, and in both tables; all from one fit."""
    ev = I.events(spark, sf).select("id", "key", "y")
    return step_rows(SW.missing_data_stress(ev, ev, "y", ["key"], I.GRID, I.GRID, [0.0, 0.5], point="mean"), "fraction")
