"""Queries of the per-row scores and the statistics built from them.

Every event is scored by a density of its type learned on the other folds, so
each row is out of sample and the whole table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import histogram as H, points as P, scores as C
from tessella.operators import metrics as M
from tessella.operators.mixtures import align
from tessella.plans import inputs as I
from tessella.plans.inputs import rounded as r
from tessella.plans.registry import query

SUMMARY = M.SUMMARY_COLUMNS


def dense(spark: SparkSession, sf: str, grid=I.GRID) -> DataFrame:
    return I.cross_predictions(spark, sf).withColumn("d", grid.normalize("masses"))


def scored(spark: SparkSession, sf: str, point: str = "mean") -> DataFrame:
    """``(id, key, fold, usr, y, y_pred, cde, pit, crps, nll)``."""
    out = C.object_scores(I.cross_predictions(spark, sf), "masses", "y", I.GRID, point)
    return out.select("id", "key", "fold", "usr", "y", "y_pred", "cde", "pit", "crps", "nll")


# Trapezoid twin: normalized densities on centers and pieces between them.
TRAP = f"""{I.CROSS},
td AS (SELECT key, fold, bin, c, m / sum(m * 10.0 * CASE WHEN bin IN (0, 49) THEN 0.5 ELSE 1 END) OVER (PARTITION BY key, fold) AS d FROM h),
tp AS (SELECT * FROM (SELECT key, fold, bin, c AS lo, lead(c) OVER x AS hi, 5.0 * (d + lead(d) OVER x) AS p, d, lead(d) OVER x AS d1 FROM td WINDOW x AS (PARTITION BY key, fold ORDER BY bin)) WHERE hi IS NOT NULL),
tf AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY key, fold ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f0, sum(p) OVER (PARTITION BY key, fold ORDER BY bin) AS f1 FROM tp)"""
NEAR = "CAST(least(greatest(floor(y / 10.0), 0), 49) AS INTEGER)"  # nearest center: bins are centered on them


@query("c1_truth_on_trapezoid", f"""{TRAP},
s AS (SELECT e.id, any_value(e.y) AS y, sum(p * least(greatest((e.y - lo) / 10.0, 0), 1)) AS pit FROM ev e JOIN tf USING (key, fold) GROUP BY e.id)
SELECT s.id, round(td.d, 9) AS pdf, round(least(s.pit, 1), 8) AS pit FROM s JOIN ev e ON e.id = s.id JOIN td ON td.key = e.key AND td.fold = e.fold AND td.bin = {NEAR.replace('y', 'e.y')}""")
def c1(spark, sf):
    y = F.col("y")
    return dense(spark, sf, I.TRAPEZOID).select("id", r(I.TRAPEZOID.density_at(F.col("d"), y), 9).alias("pdf"), r(C.pit("d", I.TRAPEZOID, y), 8).alias("pit"))


@query("c2_truth_on_histogram", f"{I.CROSS} SELECT e.id, round(p.p / p.w, 9) AS pdf, round(f0 + p.p * (e.y - lo) / w, 8) AS pit FROM ev e JOIN p ON p.key = e.key AND p.fold = e.fold AND p.bin = {I.bin_sql('e.y')}")
def c2(spark, sf):
    y = F.col("y")
    return dense(spark, sf).select("id", r(I.GRID.density_at(F.col("d"), y), 9).alias("pdf"), r(C.pit("d", I.GRID, y), 8).alias("pit"))


@query("c3_cde_terms", f"{I.SCORES} SELECT id, round(cde, 12) AS cde FROM s")
def c3(spark, sf):
    return dense(spark, sf).select("id", r(C.cde("d", I.GRID, F.col("y")), 12).alias("cde"))


@query("c3_cde_loss", f"{I.SCORES} SELECT key, round(avg(cde), 8) AS cde_loss FROM s GROUP BY key")
def c3_loss(spark, sf):
    out = dense(spark, sf).withColumn("cde", C.cde("d", I.GRID, F.col("y")))
    return out.groupBy("key").agg(r(F.avg("cde"), 8).alias("cde_loss"))


@query("c4_crps", f"{I.SCORES} SELECT id, round(crps, 6) AS crps FROM s")
def c4(spark, sf):
    return dense(spark, sf).select("id", r(C.crps("d", I.GRID, F.col("y"))).alias("crps"))


@query("c4_crps_jvm", f"{I.SCORES} SELECT id, round(crps, 6) AS crps FROM s")
def c4_jvm(spark, sf):
    """The same score without a Python worker."""
    return dense(spark, sf).select("id", r(C.crps_jvm(I.GRID.masses(F.col("d")), F.col("y"), I.GRID.nodes)).alias("crps"))


@query("c4_crps_trapezoid", f"""{TRAP}, x AS (SELECT e.id, e.y, lo, hi, f0, f1, f0 + p * (least(greatest(e.y, lo), hi) - lo) / (hi - lo) AS fc FROM ev e JOIN tf USING (key, fold))
SELECT id, round(sum({I.CRPS_SQL}) + greatest(5.0 - any_value(y), 0) + greatest(any_value(y) - 495.0, 0), 6) AS crps FROM x GROUP BY id""")
def c4_trapezoid(spark, sf):
    return dense(spark, sf, I.TRAPEZOID).select("id", r(C.crps("d", I.TRAPEZOID, F.col("y"))).alias("crps"))


@query("c5_nll", f"{I.SCORES} SELECT id, round(nll, 7) AS nll FROM s")
def c5(spark, sf):
    return dense(spark, sf).select("id", r(C.nll("d", I.GRID, F.col("y")), 7).alias("nll"))


@query("c6_object_scores", f"{I.SCORES} SELECT id, round(mean_pred, 6) AS y_pred, round(cde, 12) AS cde, round(pit, 8) AS pit, round(crps, 6) AS crps, round(nll, 7) AS nll FROM s")
def c6(spark, sf):
    return scored(spark, sf).select("id", r("y_pred").alias("y_pred"), r("cde", 12).alias("cde"), r("pit", 8).alias("pit"), r("crps").alias("crps"), r("nll", 7).alias("nll"))


SCORE_OUT = "round(cde, 12) AS cde, round(pit, 8) AS pit, round(crps, 6) AS crps, round(nll, 7) AS nll"


def neat_scores(df: DataFrame) -> DataFrame:
    return df.select("id", r("cde", 12).alias("cde"), r("pit", 8).alias("pit"), r("crps").alias("crps"), r("nll", 7).alias("nll"))


@query("c6_missing_truth", f"{I.SCORES} SELECT id, {SCORE_OUT} FROM s WHERE id % 7 <> 0 AND id % 11 <> 0")
def c6_missing(spark, sf):
    """Rows without a finite truth are not scored."""
    y = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("y"))
    return neat_scores(C.object_scores(I.cross_predictions(spark, sf).withColumn("y", y), "masses", "y", I.GRID))


@query("c6_ragged_rows", f"""{I.SCORES} SELECT id, CASE WHEN id % 5 < 2 THEN NULL ELSE round(cde, 12) END AS cde, CASE WHEN id % 5 < 2 THEN NULL ELSE round(pit, 8) END AS pit,
  CASE WHEN id % 5 < 2 THEN NULL ELSE round(crps, 6) END AS crps, CASE WHEN id % 5 < 2 THEN NULL ELSE round(nll, 7) END AS nll FROM s""")
def c6_ragged(spark, sf):
    """Densities one bin short or one too long, which together would fill two rows, get no scores and touch no other row."""
    m = F.col("masses")
    ragged = F.when(F.col("id") % 5 == 0, F.slice(m, F.lit(1), I.GRID.n - 1)).when(F.col("id") % 5 == 1, F.concat(m, F.array(F.lit(0.5)))).otherwise(m)
    df = I.cross_predictions(spark, sf).withColumn("masses", ragged)
    return neat_scores(C.object_scores(df, "masses", "y", I.GRID, invalid="null"))


@query("v14_checked_scores", f"""WITH {I.EV} SELECT count(*) AS n, count(*) FILTER (id % 7 = 0) AS missing_truth, count(*) FILTER (id % 13 = 0) AS missing_density,
  count(*) FILTER (id % 5 = 0 AND id % 13 <> 0) AS wrong_length FROM ev""")
def v14_scores(spark, sf):
    """What keeps rows from being scored, counted by the scoring entry's own check."""
    m = F.col("masses")
    df = I.cross_predictions(spark, sf).withColumns({
        "masses": F.when(F.col("id") % 13 == 0, F.lit(None)).when(F.col("id") % 5 == 0, F.slice(m, F.lit(1), I.GRID.n - 1)).otherwise(m),
        "y": F.when(F.col("id") % 7 != 0, F.col("y"))})
    return C.problems(df, "masses", "y", I.GRID)


@query("c7_pinball", f"{I.UQ} SELECT key, round(avg(greatest(i * 0.05 * (y - v), (i * 0.05 - 1) * (y - v))), 6) AS pinball FROM ev JOIN qq USING (usr) GROUP BY key")
def c7(spark, sf):
    df = I.events(spark, sf).join(I.user_quantiles(spark, sf), "usr").withColumn("s", C.pinball(F.col("y"), "locs", I.LEVELS))
    return df.groupBy("key").agg(r(F.avg("s")).alias("pinball"))


@query("c8_residuals", f"{I.SCORES} SELECT id, round(mean_pred - y, 6) AS plain, round((mean_pred - y) / (1 + y), 7) AS scaled FROM s")
def c8(spark, sf):
    y = F.col("y")
    df = dense(spark, sf).withColumn("m", P.mean("d", I.GRID))
    return df.select("id", r(C.residual(y, F.col("m"))).alias("plain"), r(C.residual(y, F.col("m"), "1+y"), 7).alias("scaled"))


def points_sql(scale: str, by: str | None) -> str:
    e = "(mean_pred - y)" if scale == "none" else "((mean_pred - y) / (1 + y))"
    key = by or "0"
    return f"""e AS (SELECT {key} AS g, {e} AS e FROM s),
q AS (SELECT g, quantile_cont(e, 0.5) AS bias, (quantile_cont(e, 0.75) - quantile_cont(e, 0.25)) / 1.349 AS iqr, quantile_cont(abs(e), 0.5) AS mae, count(*) AS n FROM e GROUP BY g),
pm AS (SELECT e.g, any_value(n) AS n, any_value(bias) AS bias, 1.4826 * quantile_cont(abs(e - bias), 0.5) AS sigma_mad, any_value(iqr) AS sigma_iqr,
  avg(CAST(abs(e) > greatest(0.06, 3 * iqr) AS INT)) AS outlier_rate, any_value(greatest(0.06, 3 * iqr)) AS outlier_threshold,
  avg(CAST(abs(e) > 0.15 AS INT)) AS outlier_rate_015, any_value(mae) AS median_abs_error FROM e JOIN q USING (g) GROUP BY e.g)"""


POINT_OUT = """round(bias, 6) AS bias, round(sigma_mad, 6) AS sigma_mad, round(sigma_iqr, 6) AS sigma_iqr, round(outlier_rate, 8) AS outlier_rate,
round(outlier_threshold, 6) AS outlier_threshold, round(outlier_rate_015, 8) AS outlier_rate_015, round(median_abs_error, 6) AS median_abs_error"""
DIGITS = {"outlier_rate": 8, "outlier_rate_015": 8, "cde_loss": 8, "pit_ks": 7, "pit_cvm": 5, "pit_ad1": 4, "pit_ad2": 4, "pit_rmse": 7, "pit_kl": 7, "pit_outlier_rate": 8, "nll": 6}


def neat(df: DataFrame, *names: str) -> list:
    return [r(n, DIGITS.get(n, 6)).alias(n) for n in names]


@query("c9_point_metrics", f"{I.SCORES}, {points_sql('none', 'key')} SELECT g AS key, n, {POINT_OUT} FROM pm")
def c9(spark, sf):
    df = dense(spark, sf).withColumn("m", P.mean("d", I.GRID))
    out = M.point_metrics(df, "y", "m", ["key"])
    return out.select("key", "n", *neat(out, *SUMMARY[1:8]))


@query("c9_point_metrics_scaled", f"{I.SCORES}, {points_sql('1+y', None)} SELECT n, {POINT_OUT} FROM pm")
def c9_scaled(spark, sf):
    df = dense(spark, sf).withColumn("m", P.mean("d", I.GRID))
    out = M.point_metrics(df, "y", "m", scale="1+y")
    return out.select("n", *neat(out, *SUMMARY[1:8]))


def pit_sql(by: str) -> str:
    """PIT statistics per group from plain ranks."""
    return f"""k AS (SELECT {by} AS g, pit AS u, row_number() OVER (PARTITION BY {by} ORDER BY pit) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM s),
k1 AS (SELECT g, count(*) AS n, -count(*) - avg((2*i-1) * ln(v) + (2*n+1-2*i) * ln(1-v)) AS ad FROM (SELECT g, least(greatest((u - 0.05) / 0.9, 1e-15), 1 - 1e-15) AS v,
  row_number() OVER (PARTITION BY g ORDER BY u) AS i, count(*) OVER (PARTITION BY g) AS n FROM k WHERE u > 0.05 AND u < 0.95) GROUP BY g),
k2 AS (SELECT g, -count(*) - avg((2*i-1) * ln(v) + (2*n+1-2*i) * ln(1-v)) AS ad FROM (SELECT g, least(greatest((u - 0.01) / 0.98, 1e-15), 1 - 1e-15) AS v,
  row_number() OVER (PARTITION BY g ORDER BY u) AS i, count(*) OVER (PARTITION BY g) AS n FROM k WHERE u > 0.01 AND u < 0.99) GROUP BY g),
kb AS (SELECT g, sum(c / n * ln(20 * c / n)) AS kl FROM (SELECT g, least(floor(u * 20), 19) AS b, count(*)::DOUBLE AS c, any_value(n)::DOUBLE AS n FROM k GROUP BY g, b) GROUP BY g),
ps AS (SELECT g, count(*) AS n, max(greatest(i / n::DOUBLE - u, u - (i - 1) / n::DOUBLE)) AS pit_ks, 1.0 / (12 * count(*)) + sum(pow((2*i-1) / (2.0*n) - u, 2)) AS pit_cvm,
  sqrt(avg(pow((i - 0.5) / n - u, 2))) AS pit_rmse, avg(CAST(u < 1e-4 OR u > 1 - 1e-4 AS INT)) AS pit_outlier_rate FROM k GROUP BY g)"""


PIT_OUT = """round(pit_ks, 7) AS pit_ks, round(pit_cvm, 5) AS pit_cvm, round(k1.ad, 4) AS pit_ad1, round(k2.ad, 4) AS pit_ad2, round(pit_rmse, 7) AS pit_rmse,
round(kl, 7) AS pit_kl, round(pit_outlier_rate, 8) AS pit_outlier_rate"""
PIT_FROM = "FROM ps JOIN k1 USING (g) JOIN k2 USING (g) JOIN kb USING (g)"
PIT_NAMES = ("pit_ks", "pit_cvm", "pit_ad1", "pit_ad2", "pit_rmse", "pit_kl", "pit_outlier_rate")


@query("c10_anderson_darling", f"{I.SCORES}, {pit_sql('key')} SELECT g AS key, round(k1.ad, 4) AS ad FROM k1")
def c10(spark, sf):
    out = M.anderson_darling(scored(spark, sf), "pit", 0.05, 0.95, ["key"])
    return out.select("key", r("ad", 4).alias("ad"))


for _name, _column, _digits in (("c11_pit_ks", "pit_ks", 7), ("c12_pit_cvm", "pit_cvm", 5), ("c13_pit_rmse", "pit_rmse", 7), ("c14_pit_kl", "pit_kl", 7), ("c15_pit_extremes", "pit_outlier_rate", 8)):
    _from = "(SELECT g, kl AS pit_kl FROM kb)" if _column == "pit_kl" else "ps"

    @query(_name, f"{I.SCORES}, {pit_sql('key')} SELECT g AS key, round({_column}, {_digits}) AS {_column} FROM {_from}")
    def _one(spark, sf, _column=_column, _digits=_digits):
        return M.pit_statistics(scored(spark, sf), "pit", ["key"]).select("key", r(_column, _digits).alias(_column))


@query("c16_pit_statistics", f"{I.SCORES}, {pit_sql('0')} SELECT ps.n, {PIT_OUT} {PIT_FROM}")
def c16(spark, sf):
    out = M.pit_statistics(scored(spark, sf))
    return out.select("n", *neat(out, *PIT_NAMES))


@query("c17_pdf_metrics", f"""{I.SCORES}, {pit_sql('fold')}, m AS (SELECT fold AS g, avg(cde) AS cde_loss, avg(crps) AS crps, avg(nll) AS nll FROM s GROUP BY fold)
SELECT g AS fold, ps.n, round(cde_loss, 8) AS cde_loss, {PIT_OUT}, round(crps, 6) AS crps, round(nll, 6) AS nll {PIT_FROM} JOIN m USING (g)""")
def c17(spark, sf):
    out = M.pdf_metrics(scored(spark, sf), ["fold"])
    return out.select("fold", "n", *neat(out, "cde_loss", *PIT_NAMES, "crps", "nll"))


def report_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return M.summarize(scored(spark, sf), "y", "y_pred", ["key"], point="mean", label="by type")


REPORT_SQL = """{points}, {pits}, m AS (SELECT {by} AS g, avg(cde) AS cde_loss, avg(crps) AS crps, avg(nll) AS nll FROM s GROUP BY {by})
SELECT {lead} pm.n, {point_out}, round(cde_loss, 8) AS cde_loss, {pit_out}, round(crps, 6) AS crps, round(nll, 6) AS nll
FROM pm JOIN ps USING (g) JOIN k1 USING (g) JOIN k2 USING (g) JOIN kb USING (g) JOIN m USING (g)"""


@query("c18_summarize", f"{I.SCORES}, " + REPORT_SQL.format(points=points_sql("none", "key"), pits=pit_sql("key"), by="key", lead="'by type' AS model, g AS key, 'mean' AS point_estimate, 'none' AS scale,", point_out=POINT_OUT, pit_out=PIT_OUT))
def c18(spark, sf):
    out = report_by_type(spark, sf)
    return out.select("model", "key", "point_estimate", "scale", "n", *neat(out, *[c for c in SUMMARY[1:] if c != "pit_ks_pvalue"]))


NO_TYPE = "coalesce(nullif(key, 'click'), '-')"


@query("c18_null_groups", f"{I.SCORES}, " + REPORT_SQL.format(points=points_sql("none", NO_TYPE), pits=pit_sql(NO_TYPE), by=NO_TYPE, lead="nullif(g, '-') AS key,", point_out=POINT_OUT, pit_out=PIT_OUT))
def c18_nulls(spark, sf):
    """The rows without a type are one of the report's groups."""
    out = M.summarize(scored(spark, sf).withColumn("key", F.when(F.col("key") != "click", F.col("key"))), "y", "y_pred", ["key"], point="mean")
    return out.select("key", "n", *neat(out, *[c for c in SUMMARY[1:] if c != "pit_ks_pvalue"]))


@query("c19_summarize_scores", f"{I.SCORES}, " + REPORT_SQL.format(points=points_sql("none", "fold * 0"), pits=pit_sql("fold * 0"), by="fold * 0", lead="", point_out=POINT_OUT, pit_out=PIT_OUT).replace(", round(nll, 6) AS nll", ", 'NaN'::DOUBLE AS nll"))
def c19(spark, sf):
    """From precomputed pieces without the NLL, which becomes NaN."""
    out = M.summarize(scored(spark, sf).drop("nll"), point="mean")
    return out.select("n", *neat(out, *[c for c in SUMMARY[1:-1] if c != "pit_ks_pvalue"]), "nll")


@query("c21_coverage", f"""{I.SCORES}, iv AS (SELECT key, fold, lo + (0.16 - f0) / p * w AS a, NULL AS b FROM p WHERE p > 0 AND f1 >= 0.16 AND f0 < 0.16 UNION ALL SELECT key, fold, NULL, lo + (0.84 - f0) / p * w FROM p WHERE p > 0 AND f1 >= 0.84 AND f0 < 0.84),
i AS (SELECT key, fold, max(a) AS a, max(b) AS b FROM iv GROUP BY ALL)
SELECT s.key, avg(CAST(abs(pit - 0.5) <= 0.34 AS INT)) AS from_pit, avg(CAST(y BETWEEN a AND b AS INT)) AS from_bounds FROM s JOIN i USING (key, fold) GROUP BY s.key""")
def c21(spark, sf):
    df = I.cross_predictions(spark, sf).withColumn("p", H.probabilities("masses", I.GRID)).withColumn("i", H.interval("p", I.GRID, 0.68))
    df = df.withColumn("pit", H.cdf_at("p", I.GRID, F.col("y")))
    a = M.coverage(df, 0.68, "pit", ["key"]).withColumnRenamed("coverage", "from_pit")
    b = M.interval_coverage(df, "y", F.col("i.lo"), F.col("i.hi"), ["key"]).withColumnRenamed("coverage", "from_bounds")
    return a.join(b, "key")


# A second model on the same rows: the user's own histogram.
SECOND = f"""{I.SCORES}, {I.masses_sql('usr', 'count(*)', name='uh')}, {I.probs_sql('usr', 'uh', 'up')},
r2 AS (SELECT e.id, e.y, lo, hi, f0, f1, up.p, w, f0 + up.p * (least(greatest(e.y, lo), hi) - lo) / w AS fc FROM ev e JOIN up USING (usr)),
s2 AS (SELECT id, sum({I.CRPS_SQL}) AS crps2 FROM r2 GROUP BY id)"""


def second_scores(spark, sf) -> DataFrame:
    from tessella.operators.estimators import bin_shares

    ev = I.events(spark, sf)
    df = ev.join(bin_shares(ev, "y", I.GRID, ["usr"]), "usr").withColumn("d", I.GRID.normalize("masses"))
    return df.select("id", "y", C.crps("d", I.GRID, F.col("y")).alias("crps"))


@query("c22_paired_difference", f"{SECOND} SELECT count(*) AS n, round(avg(crps - crps2), 6) AS mean_difference, round(stddev_samp(crps - crps2) / sqrt(count(*)), 7) AS standard_error FROM s JOIN s2 USING (id)")
def c22(spark, sf):
    out = M.paired_difference(scored(spark, sf), second_scores(spark, sf), "crps")
    return out.select("n", r("mean_difference").alias("mean_difference"), r("standard_error", 7).alias("standard_error"))


@query("c23_absolute_errors", f"""{I.SCORES}, mo AS (SELECT key, fold, arg_max(c, [m, -bin]) AS mo FROM h GROUP BY ALL), e AS (SELECT mean_pred, mo, y FROM s JOIN mo USING (key, fold))
SELECT 'mean' AS estimate, round(avg(abs(mean_pred - y)), 6) AS mae, round(sqrt(avg((mean_pred - y) * (mean_pred - y))), 6) AS rmse FROM e
UNION ALL SELECT 'mode', round(avg(abs(mo - y)), 6), round(sqrt(avg((mo - y) * (mo - y))), 6) FROM e""")
def c23(spark, sf):
    df = dense(spark, sf).withColumn("mean", P.mean("d", I.GRID)).withColumn("mode", P.mode("d", I.GRID))
    return M.absolute_errors(df, "y", ["mean", "mode"]).select("estimate", r("mae").alias("mae"), r("rmse").alias("rmse"))


@query("c11_pit_ks_pvalue", f"""{I.SCORES}, {pit_sql('key')},
x AS (SELECT g, n, pit_ks, sqrt(n) * pit_ks AS x, least(greatest(sqrt(n) * pit_ks, 0.08), 6.0) AS s FROM ps),
t AS (SELECT g, any_value(n) AS n, any_value(pit_ks) AS pit_ks, any_value(x) AS x, any_value(s) AS s, sum(exp(-h / (2 * s * s))) AS zero, sum((h - s * s) * exp(-h / (2 * s * s))) AS one
  FROM x CROSS JOIN (SELECT 9.869604401089358 * (i + 0.5) * (i + 0.5) AS h FROM range(25) r(i)) GROUP BY g)
SELECT g AS key, round(pit_ks, 7) AS pit_ks, round(CASE WHEN x > 6 THEN 0 ELSE least(greatest(1 - (2 * 1.2533141373155001 / s * zero
  + 1.2533141373155001 / (3 * pow(s, 4)) * one / sqrt(n)), 0), 1) END, 6) AS pit_ks_pvalue FROM t""")
def c11_p(spark, sf):
    """The asymptotic p-value with its first size correction."""
    return M.pit_statistics(scored(spark, sf), "pit", ["key"]).select("key", r("pit_ks", 7).alias("pit_ks"), r("pit_ks_pvalue", 6).alias("pit_ks_pvalue"))


@query("c11_exact_pvalue")
def c11_exact(spark, sf):
    """Per user, of whom each has few events: the exact distribution is a matrix power, which SQL has not."""
    out = M.with_exact_pvalue(M.pit_statistics(scored(spark, sf), "pit", ["usr"]))
    return out.select("usr", "n", r("pit_ks", 7).alias("pit_ks"), r("pit_ks_pvalue", 8).alias("pit_ks_pvalue"))


def two_models(spark, sf) -> DataFrame:
    """J1: two prediction tables of the same rows side by side."""
    return align([scored(spark, sf).select("id", F.col("crps").alias("crps_type")), second_scores(spark, sf).select("id", F.col("crps").alias("crps_user"))])


@query("j1_aligned_predictions", f"{SECOND} SELECT id, round(crps, 6) AS crps_type, round(crps2, 6) AS crps_user FROM s JOIN s2 USING (id)")
def j1(spark, sf):
    return two_models(spark, sf).select("id", r("crps_type").alias("crps_type"), r("crps_user").alias("crps_user"))

