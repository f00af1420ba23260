"""Operators on small fixtures with known answers, and the large-table paths against direct ones."""

import math
import re

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation, Window, functions as F

from tessella.functions import histogram as H, kernels
from tessella.functions.grids import Bins, Grid
from tessella.functions.uniform import hash_uniform, member_seed, normal_ppf
from tessella.operators import (
    diagnostics as X, estimators as E, features as FE, metrics as M, mixtures as MX, neighbours as NB, pooling as PO, ranks as RK,
    recipes as R, selection as SE, states as SS, sweeps as SW, validate as V,
)
from tessella.operators.logistic import LogisticHierarchy
from tessella.sources import catalog as S, ensembles as EN
from tessella.streaming import scores as ST


def values(spark, x, name="x", **extra):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), name: np.asarray(x, float), **extra})).repartition(5)


# -- no row vanishes ------------------------------------------------------------


@pytest.mark.parametrize("small", [5, 10_000])
def test_null_is_a_group_and_infinities_are_values(spark, monkeypatch, small):
    monkeypatch.setattr(RK, "SMALL_GROUP", small)
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    x[::4], x[1::8] = np.inf, -np.inf
    keys = [None if i % 3 == 0 else "a" if i % 3 == 1 else "b" for i in range(400)]
    df = spark.createDataFrame([(i, k, None if i % 5 else 1, float(v)) for i, (k, v) in enumerate(zip(keys, x))], "id long, k string, m int, x double")
    groups = {}
    for i, (k, v) in enumerate(zip(keys, x)):
        groups.setdefault((k, None if i % 5 else 1), []).append(v)
    got = {(r["k"], r["m"]): r for r in RK.exact_quantiles(df, "x", [0.0, 0.45, 0.6, 1.0], ["k", "m"]).collect()}
    assert got.keys() == groups.keys()
    for g, own in groups.items():
        own = np.sort(own)
        assert got[g]["n"] == len(own) and got[g]["q"][0] == own[0] and got[g]["q"][3] == own[-1]
        for level, q in zip((0.45, 0.6), got[g]["q"][1:3]):
            h = (len(own) - 1) * level
            a, b = own[int(h)], own[int(np.ceil(h))]
            assert q == pytest.approx(a if a == b else a + (b - a) * (h - int(h)))
    runs = RK.running_counts(df, "x", ["k"]).collect()
    for k in (None, "a", "b"):
        own = np.sort([v for g, v in zip(keys, x) if g == k])
        assert {(r["x"], r["before"], r["c"], r["n"]) for r in runs if r["k"] == k} == {(v, int((own < v).sum()), int((own == v).sum()), len(own)) for v in own}
    ranked = RK.hash_ranks(df, 3, "id", ["k"]).collect()
    assert sorted((str(r["k"]), r["rank"]) for r in ranked) == sorted((str(k), i + 1) for k in (None, "a", "b") for i in range(keys.count(k)))
    quota = spark.createDataFrame([(None, 7), ("a", 3)], "k string, quota long")
    kept = RK.first_by_hash(df, 3, "id", quota, ["k"]).groupBy("k").count().collect()
    assert {(r["k"], r["count"]) for r in kept} == {(None, 7), ("a", 3)}


def test_reports_hold_null_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(None if i % 2 else "a", float(i % 17), float(i % 17 + rng.normal()), float(rng.uniform()), 1.0, 2.0, 3.0) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, y double, y_pred double, pit double, cde double, crps double, nll double")
    both = {r["k"]: r for r in M.summarize(df, by=["k"]).collect()}
    alone = M.summarize(df.where("k IS NULL")).first()
    assert both.keys() == {None, "a"}
    for c in M.SUMMARY_COLUMNS:
        assert both[None][c] == pytest.approx(alone[c], nan_ok=True)


def test_every_row_is_predicted(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0), (None, 5.0), (None, 5.0)], "k string, y double")
    model = E.DensityModel(["k"], grid=Grid.linear(0.0, 6.0, 6, normalization="histogram"), n_bins=4).fit(df)
    asked = spark.createDataFrame([(0, "a"), (1, "b"), (2, None), (3, "b")], "id long, k string")
    got = {r["id"]: r["p"] for r in model.distribution(asked).collect()}
    assert got[0] == [0.5, 0.5, 0.0, 0.0] and got[2] == pytest.approx([0, 0, 1 / 3, 2 / 3]) and got[1] == got[3] == pytest.approx([0.2, 0.2, 0.2, 0.4])
    bare = E.predict(asked, model.table, ["k"]).collect()
    assert len(bare) == 4 and [r["id"] for r in bare if r["masses"] is None] == [1, 3]


def test_misaligned_tables_are_refused(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.6), (None, 0.1)], "id long, a double")
    b = spark.createDataFrame([(1, 0.5), (3, 0.6)], "id long, b double")
    assert MX.align([a.where("id < 2"), b.where("id < 2")]).collect() == [(1, 0.5, 0.5)]
    for left, right in ((a.where("id <= 2"), b.where("id < 2")), (a.where("id < 2"), b), (a, b)):
        with pytest.raises(Exception, match="lacks the row id = "):
            MX.align([left, right]).collect()
        with pytest.raises(Exception, match="lacks the row id = "):
            M.paired_difference(left.withColumnRenamed("a", "s"), right.withColumnRenamed("b", "s"), "s").collect()


# -- exact p-values, states, observed counts ------------------------------------


@pytest.mark.parametrize(("n", "d", "want"), [(10, 0.274, 0.6284796154565), (1, 0.7, 0.4), (2, 0.3, 0.02), (2, 0.8, 0.92), (3, 1 / 6, 0.0), (3, 1.0, 1.0)])
def test_kolmogorov_at_known_values(n, d, want):
    assert M.kolmogorov(n, d) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize(("n", "level", "d"), [(5, 0.95, 0.56328), (20, 0.90, 0.26473), (20, 0.99, 0.35241), (40, 0.95, 0.21012)])
def test_kolmogorov_at_published_critical_values(n, level, d):
    """Published to five digits: the level lies between those of the neighbouring digits."""
    assert M.kolmogorov(n, d - 6e-6) < level < M.kolmogorov(n, d + 6e-6)


def test_kolmogorov_against_lattice_paths():
    """The probability that n ordered values stay in their bands, by summing over cells: for d = c / n it is a count of paths."""
    for n, c in ((5, 2), (20, 6), (20, 4), (100, 12)):
        # Cells of width 1 / n: after j cells the number of values lies in (j - c, j + c).
        state = np.zeros(n + 1)
        state[0] = 1.0
        poisson = np.exp([-math.lgamma(i + 1) for i in range(n + 1)])
        for j in range(1, n + 1):
            state = np.array([sum(state[a] * poisson[b - a] for a in range(b + 1)) if j - c < b < j + c else 0.0 for b in range(n + 1)])
        want = state[n] * math.exp(math.lgamma(n + 1) - n * math.log(n))
        assert M.kolmogorov(n, c / n) == pytest.approx(want, abs=1e-10)


def test_exact_pvalues_of_small_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(u)) for g, n in (("a", 4), ("b", 60), ("c", 2500)) for u in rng.uniform(size=n)]
    out = {r["g"]: r for r in M.with_exact_pvalue(M.pit_statistics(spark.createDataFrame(rows, "g string, pit double"), by=["g"])).collect()}
    plain = {r["g"]: r for r in M.pit_statistics(spark.createDataFrame(rows, "g string, pit double"), by=["g"]).collect()}
    for g in "ab":
        assert out[g]["pit_ks_pvalue"] == pytest.approx(1 - M.kolmogorov(out[g]["n"], out[g]["pit_ks"]), abs=1e-12)
    assert out["c"]["pit_ks_pvalue"] == plain["c"]["pit_ks_pvalue"]
    assert 1 - M.kolmogorov(2500, plain["c"]["pit_ks"]) == pytest.approx(plain["c"]["pit_ks_pvalue"], abs=2e-3)


def score_rows(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, None if i % 3 == 0 else "a", float(y), float(y + e), float(u), float(c), None if i % 7 == 0 else float(c), 1.0)
            for i, (y, e, u, c) in enumerate(zip(rng.normal(size=n), rng.standard_t(2, n), rng.uniform(size=n), rng.gamma(2, size=n)))]
    return spark.createDataFrame(rows, "id long, key string, y double, y_pred double, pit double, cde double, crps double, nll double")


@pytest.mark.parametrize("width", [2.0 ** -6, 1.0, 1024.0])
def test_report_from_states_equals_the_batch_report(spark, tmp_path, width):
    scores = score_rows(spark, 900, 1)
    for epoch in (0, 1, 2, 1):
        ST.write_with_states(scores.where(F.col("id") % 3 == epoch), str(tmp_path), epoch, ["key"], SS.Resolution(width))
    got = {r["key"]: r for r in ST.incremental_report(spark, str(tmp_path), ["key"]).collect()}
    want = {r["key"]: r for r in M.summarize(scores, by=["key"], point="mean").collect()}
    assert got.keys() == want.keys() == {None, "a"}
    for k in got:
        for c in ("n", "cde_loss", "crps", "nll", "bias", "sigma_iqr", "outlier_rate_015", "pit_kl", "pit_outlier_rate"):
            assert got[k][c] == pytest.approx(want[k][c], rel=1e-9), c


def test_report_from_states_reads_few_rows(spark, tmp_path):
    """The scan of the score table is filtered to the intervals that hold the quartiles."""
    ST.write_with_states(score_rows(spark, 900, 2), str(tmp_path), 0, [])
    plan = ST.incremental_report(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert " In(_interval, [" in plan


def test_stream_with_states(spark, tmp_path):
    score_rows(spark, 300, 4).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(score_rows(spark, 1, 4).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ST.append_with_states(stream, str(tmp_path / "out"), str(tmp_path / "state"), ["key"]).awaitTermination()
    assert ST.incremental_report(spark, str(tmp_path / "out"), ["key"]).agg(F.sum("n")).first()[0] == 300


def test_counts_come_with_the_action(spark):
    """No job is run to count: the counts arrive with the one action, which takes as many jobs as without them."""
    df = values(spark, np.linspace(0, 10, 101))
    seen, jobs = Observation(), {}
    for name, option in (("bare", None), ("seen", seen)):
        spark.sparkContext.setJobGroup(name, name)
        V.clip_target(df, "x", 2.0, 9.0, seen=option).write.format("noop").mode("overwrite").save()
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    assert jobs["bare"] == jobs["seen"] > 0
    assert seen.get == {"below": 20, "above": 10, "n": 101}


def test_bags_explode_few_rows(spark):
    df = values(spark, np.arange(4000.0))
    out = SE.draw_bags(df, "id", 5, 40, 7)
    assert {r["member"]: r["count"] for r in out.groupBy("member").count().collect()} == dict.fromkeys(range(5), 40)
    every = df.select("id").crossJoin(spark.range(5).select(F.col("id").cast("int").alias("member")))
    every = every.withColumn("_key", F.concat_ws("/", "member", "id")).withColumn("u", hash_uniform(7, F.col("_key")))
    direct = every.withColumn("r", F.row_number().over(Window.partitionBy("member").orderBy("u", "_key"))).where("r <= 40")
    assert out.exceptAll(direct.select("member", "id")).count() == 0


def test_mixed_masses_by_hand(spark):
    rng = np.random.default_rng(2)
    edges = [np.array([0.0, 1.0, 1.0, 4.0]), np.linspace(-1, 5, 8), np.array([2.0, 2.5])]
    union = np.unique(np.concatenate(edges))
    rows = [tuple(rng.dirichlet(np.ones(len(e) - 1)).tolist() for e in edges) for _ in range(20)]
    df = spark.createDataFrame([*rows, (rows[0][0], None, rows[0][2]), (rows[0][0][:2], rows[0][1], rows[0][2])], "a array<double>, b array<double>, c array<double>")
    got = [r["m"] for r in df.select(kernels.mixed_masses([F.col(c) for c in "abc"], edges, [0.5, 0.3, 0.2], union).alias("m")).collect()]
    assert got[20:] == [None, None]
    for row, m in zip(rows, got):
        cdf = lambda x: sum(w * sum(p * (np.clip((x - a) / (b - a), 0, 1) if b > a else float(x >= a)) for p, a, b in zip(ps, e[:-1], e[1:]))  # noqa: B023
                            for w, ps, e in zip((0.5, 0.3, 0.2), row, edges))
        np.testing.assert_allclose(m, np.diff([cdf(x) for x in union]), atol=1e-12)


def test_models_of_three_kinds_agree_on_columns(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, "ab"[i % 2], i % 3, float(v)) for i, v in enumerate(rng.gamma(3, size=300))], "id long, k string, f int, y double")
    grid = Grid.linear(0.0, 12.0, 60, normalization="histogram")
    parts = [E.DensityModel(["k"], grid=grid), E.DensityModel(["f"], grid=grid, n_bins=7)]
    for model in (E.DensityModel(["k", "f"], grid=grid), E.QuantileModel(["k", "f"], grid=grid), E.MixtureModel(["k", "f"], grid=grid, members=parts)):
        model.fit(df)
        shuffled = df.select("y", "f", "id", "k")
        got = model.transform(model.transform(model.transform(shuffled, "pit"), "quantiles", levels=[0.1, 0.5, 0.9]), "point", point="mean").toPandas()
        assert len(got) == 300 and got.pit.between(0, 1).all() and 0.4 < got.pit.mean() < 0.6
        assert all(a <= b <= c for a, b, c in got.quantiles)
        assert abs(got.point.mean() - got.y.mean()) < 0.3
        mass = model.transform(df, "density").select(F.aggregate("density", F.lit(0.0), lambda s, x: s + x * 0.2).alias("m")).toPandas()
        np.testing.assert_allclose(mass.m, 1.0)
    model = E.DensityModel(["k"], grid=grid).fit(df)
    assert model.transform(df.withColumnRenamed("k", "x0"), "pit").agg(F.avg("pit")).first()[0] == pytest.approx(model.transform(df, "pit").agg(F.avg("pit")).first()[0])
    with pytest.raises(ValueError, match="missing \\['k'\\]"):
        model.transform(df.drop("k"), "pit")


# -- order statistics -----------------------------------------------------------


def skewed(n=4000, seed=0):
    """A third of the rows share one value, another third sits in a sliver."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([np.full(n // 3, 0.25), 0.5 + 1e-9 * rng.uniform(size=n // 3), rng.normal(size=n - 2 * (n // 3))])
    return rng.permutation(x)


@pytest.mark.parametrize("small", [10, 1_500, 10_000])
def test_quantiles_by_intervals_are_exact(spark, monkeypatch, small):
    monkeypatch.setattr(RK, "SMALL_GROUP", small)
    x, g = skewed(), np.random.default_rng(1).integers(0, 3, 4000)
    g[:1500] = 0
    df = values(spark, x, g=g)
    levels = [0.0, 0.013, 0.25, 0.5, 0.731, 0.999, 1.0]
    for row in RK.exact_quantiles(df, "x", levels, ["g"]).collect():
        np.testing.assert_allclose(row["q"], np.percentile(x[g == row["g"]], np.array(levels) * 100), rtol=1e-12)
        assert row["n"] == (g == row["g"]).sum()
    both = [RK.exact_quantiles(df, "x", levels, cuts=c).first()["q"] for c in (None, [])]
    np.testing.assert_allclose(both[0], both[1], rtol=1e-12)


def test_running_counts_by_intervals(spark):
    x = skewed(2000, 3)
    out = RK.running_counts(values(spark, x), "x").toPandas().sort_values("x")
    v, c = np.unique(x, return_counts=True)
    np.testing.assert_array_equal(out.x, v)
    np.testing.assert_array_equal(out.c, c)
    np.testing.assert_array_equal(out.before, np.cumsum(c) - c)
    assert (out.n == 2000).all()


def test_hash_ranks_and_quotas_agree(spark):
    df = spark.range(900).withColumn("g", F.when(F.col("id") < 300, 1).otherwise(2))
    ranks = RK.hash_ranks(df, 7, "id", ["g"])
    assert ranks.groupBy("g").agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).orderBy("g").collect() == [(1, 1, 300, 300), (2, 1, 600, 600)]
    quota = spark.createDataFrame([(1, 0), (2, 123)], "g int, quota long")
    kept = {r[0] for r in RK.first_by_hash(df, 7, "id", quota, ["g"]).select("id").collect()}
    assert kept == {r["id"] for r in ranks.where("g = 2 AND rank <= 123").collect()}


def test_dense_ids(spark):
    out = RK.dense_ids(spark.range(500).withColumn("v", F.col("id") * 7 % 501), "row", ["v"]).orderBy("v").collect()
    assert [r["row"] for r in out] == list(range(500))


# -- statistics -------------------------------------------------------------------


def pit_reference(u):
    n, u = len(u), np.sort(u)
    i = np.arange(1, n + 1)
    out = {"pit_ks": max((i / n - u).max(), (u - (i - 1) / n).max()), "pit_cvm": 1 / (12 * n) + (((2 * i - 1) / (2 * n) - u) ** 2).sum(),
           "pit_rmse": np.sqrt(np.mean(((i - 0.5) / n - u) ** 2)), "pit_outlier_rate": np.mean((u < 1e-4) | (u > 1 - 1e-4))}
    for name, (a, b) in zip(("pit_ad1", "pit_ad2"), M.AD_CUTS):
        k = u[(u > a) & (u < b)]
        v, j = np.clip((k - a) / (b - a), 1e-15, 1 - 1e-15), np.arange(1, len(k) + 1)
        out[name] = -len(k) - np.mean((2 * j - 1) * (np.log(v) + np.log1p(-v[::-1])))
    p = np.histogram(u, 20, (0, 1))[0] / n
    out["pit_kl"] = sum(q * np.log(20 * q) for q in p if q > 0)
    return out


def test_pit_statistics(spark):
    rng = np.random.default_rng(2)
    u = np.concatenate([rng.beta(1.2, 0.9, 1500), np.zeros(40), np.ones(30), np.full(300, 0.5)])
    got = M.pit_statistics(values(spark, u, "pit")).first()
    for name, want in pit_reference(u).items():
        assert got[name] == pytest.approx(want, rel=1e-9), name
    assert got["pit_cvm"] == pytest.approx(1 / (12 * len(u)) + len(u) * got["pit_rmse"] ** 2)


def test_anderson_darling_without_survivors_is_nan(spark):
    assert math.isnan(M.anderson_darling(values(spark, [0.0, 1.0], "pit"), "pit", 0.05, 0.95).first()[0])


def test_ks_pvalue_against_simulation(spark):
    n, rng = 200, np.random.default_rng(0)
    u, i = np.sort(rng.uniform(size=(20000, n)), axis=1), np.arange(1, n + 1)
    d = np.maximum((i / n - u).max(1), (u - (i - 1) / n).max(1))
    ds = [0.04, 0.06, 0.09, 0.12]
    got = spark.createDataFrame([(x,) for x in ds], "d double").select("d", M.ks_pvalue(F.col("d"), F.lit(float(n))).alias("p")).collect()
    for row in got:
        assert row["p"] == pytest.approx(np.mean(d >= row["d"]), abs=0.012)


@pytest.mark.parametrize("scale", ["none", "1+y"])
def test_point_metrics(spark, scale):
    rng = np.random.default_rng(21)
    y = rng.gamma(2.0, 1.5, 2700)
    # A tenth of the estimates are swapped with another row's; the rest err to one side.
    pred = y * rng.beta(40, 3, 2700)
    pred[::10] = pred[::10][::-1]
    e = (pred - y) / (1 + y) if scale == "1+y" else pred - y
    got = M.point_metrics(values(spark, y, "y", p=pred), "y", "p", scale=scale).first()
    q25, q75 = np.percentile(e, [25, 75])
    thr = max(0.06, 3 * (q75 - q25) / 1.349)
    want = {"n": 2700, "bias": np.median(e), "sigma_mad": 1.4826 * np.median(np.abs(e - np.median(e))), "sigma_iqr": (q75 - q25) / 1.349,
            "outlier_rate": np.mean(np.abs(e) > thr), "outlier_threshold": thr, "outlier_rate_015": np.mean(np.abs(e) > 0.15), "median_abs_error": np.median(np.abs(e))}
    for name, v in want.items():
        assert got[name] == pytest.approx(v, rel=1e-9), name


def test_summarize_without_a_score_gives_nan(spark):
    df = values(spark, np.linspace(0, 1, 50), "pit", y=np.linspace(0, 1, 50), y_pred=np.linspace(0, 1.1, 50), cde=np.ones(50))
    out = M.summarize(df, label="m")
    assert out.columns == ["model", "point_estimate", "scale", *M.SUMMARY_COLUMNS]
    row = out.first()
    assert math.isnan(row["crps"]) and row["cde_loss"] == 1.0 and row["n"] == 50


def test_gaussian_cde_loss(spark):
    """The loss of the true density is -1 / (2 sqrt(pi) sigma)."""
    grid, sigma, rng = Grid.linear(0, 2, 200), 0.1, np.random.default_rng(0)
    center = rng.uniform(0.7, 1.3, 400)
    pdf = [np.exp(-0.5 * ((grid.centers - c) / sigma) ** 2).tolist() for c in center]
    df = spark.createDataFrame([(i, p, float(c + sigma * z)) for i, (p, c, z) in enumerate(zip(pdf, center, rng.normal(size=400)))], "id long, pdf array<double>, y double")
    from tessella.functions.scores import object_scores
    assert object_scores(df, "pdf", "y", grid).agg(F.avg("cde")).first()[0] == pytest.approx(-1 / (2 * math.sqrt(math.pi) * sigma), rel=0.1)


# -- mixtures and pools --------------------------------------------------------------


def gaussian(grid, mu, sd):
    from math import erf
    cdf = np.array([0.5 * (1 + erf((e - mu) / (sd * math.sqrt(2)))) for e in grid.array])
    return np.diff(cdf).tolist()


def test_pools_of_gaussians(spark):
    """The geometric pool of two normals is a normal, the quantile pool averages means and spreads."""
    grid = Grid.linear(-5, 5, 2000, normalization="histogram")
    df = spark.createDataFrame([(0, gaussian(grid, -0.5, 0.4), gaussian(grid, 0.7, 0.8))], "id long, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    df = df.withColumn("lin", PO.linear([a, b], grid)).withColumn("geo", H.probabilities(PO.geometric([a, b], grid), grid))
    df = df.withColumn("qa", PO.member_quantiles("a", grid, grid)).withColumn("qb", PO.member_quantiles("b", grid, grid))
    row = df.select(H.mean("lin", grid), H.std("lin", grid), H.mean("geo", grid), H.std("geo", grid), PO.quantile([F.col("qa"), F.col("qb")]).alias("q")).first()
    assert row[0] == pytest.approx(0.1, abs=1e-4)
    assert row[1] == pytest.approx(math.sqrt((0.16 + 0.64) / 2 + 0.36), abs=1e-3)
    pa, pb = 1 / 0.16, 1 / 0.64
    assert row[2] == pytest.approx((-0.5 * pa + 0.7 * pb) / (pa + pb), abs=1e-3)
    assert row[3] == pytest.approx(math.sqrt(2 / (pa + pb)), abs=1e-3)
    assert row[4][500] == pytest.approx(0.1, abs=1e-3) and row[4][841] - row[4][500] == pytest.approx(0.6, abs=5e-3)


def test_pools_in_slices(spark, monkeypatch):
    """A batch is pooled slice by slice; a row that lacks a member is NULL, its neighbours keep their values."""
    monkeypatch.setattr(kernels, "SLICE", 12)
    rng = np.random.default_rng(1)
    m = rng.random((30, 2, 4))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist() if i != 5 else None) for i, (a, b) in enumerate(m)], "id long, a array<double>, b array<double>").coalesce(1)
    grid = Grid.linear(0, 4, 4, normalization="histogram")
    for pool in (kernels.linear_pool, kernels.geometric_pool):
        args = (np.array([0.25, 0.75]), grid.n) if pool is kernels.linear_pool else (np.array([0.25, 0.75]), grid.widths, 1e-10)
        got = {r["id"]: r["m"] for r in df.select("id", pool([F.col("a"), F.col("b")], *args).alias("m")).collect()}
        assert got.pop(5) is None and len(got) == 29
        for i, row in got.items():
            logs = 0.25 * np.log(m[i, 0] + 1e-10) + 0.75 * np.log(m[i, 1] + 1e-10)
            np.testing.assert_allclose(row, 0.25 * m[i, 0] + 0.75 * m[i, 1] if pool is kernels.linear_pool else np.exp(logs - logs.max()))


def test_members_of_a_pool_are_regridded_before_they_meet(spark, sf_dir):
    """Once per user and once per type: no kernel that re-grids runs above the join of the pairs."""
    from tessella.plans import pools
    plan = pools.members(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:+-]*", line).group()) for line in plan]
    joins = [d for d, line in zip(depth, plan) if "Join" in line]
    assert len(joins) == 3 and all(d > min(joins) for d, line in zip(depth, plan) if "ArrowEvalPython" in line)


def test_pool_grid():
    fine, coarse = Bins(tuple(np.linspace(0, 10, 1001))), Bins(tuple(np.linspace(-50, 50, 11)))
    grid = PO.pool_grid((2.0, 8.0), [fine, coarse])
    assert (grid.edges[0], grid.edges[-1]) == (0.5, 9.5) and grid.n in (900, 901)
    assert PO.pool_grid((2.0, 8.0), [coarse]).n == 200
    assert PO.pool_grid((0.0, 4.0), [Bins((0.0, 1.0, 4.0))]).edges[0] == 0.0


def test_quantile_averages(spark):
    df = spark.createDataFrame([(0, m, [v, v + 1.0]) for m, v in (("a", 0.0), ("b", 1.0), ("c", 9.0))], "id long, m string, locs array<double>")
    assert MX.trimmed_average(df, "id", "locs", 2, 0.34).first()["locs"] == [1.0, 2.0]
    got = MX.quantile_average(df, "id", "locs", 2, {"a": 1.0, "b": 1.0, "c": 2.0}, "m").first()["locs"]
    np.testing.assert_allclose(got, [4.75, 5.75])
    with pytest.raises(ValueError):
        MX.trimmed_average(df, "id", "locs", 2, 0.5)


def test_regrid_rows_match_the_shared_plan(spark):
    rng, grid = np.random.default_rng(4), Grid.linear(0, 10, 7, normalization="histogram")
    rows = [(i, np.sort(np.append(rng.uniform(-2, 12, 5), 3.0)).tolist(), rng.gamma(1, size=5).tolist()) for i in range(20)]
    rows.append((20, [1.0, 10 / 7, 10 / 7, 10.0, 10.0], [1.0, 2.0, 1.0, 3.0]))
    df = spark.createDataFrame(rows, "id long, bins array<double>, masses array<double>")
    got = {(r["id"], r["bin"]): r["mass"] for r in MX.regrid_rows(df, "id", "bins", "masses", grid).collect()}
    for i, e, m in rows:
        want, _ = brute.hist_masses(np.array(m) / sum(m), np.array(e), grid.array)
        np.testing.assert_allclose([got.get((i, b), 0.0) for b in range(7)], want, atol=1e-12)


def test_concatenate_refuses_other_kinds(spark):
    a = spark.createDataFrame([(0, [1.0])], "id long, masses array<double>")
    with pytest.raises(ValueError):
        MX.concatenate([(a, Bins((0.0, 1.0))), (a, Bins((0.0, 2.0)))])
    with pytest.raises(TypeError):
        MX.concatenate([(a, Bins((0.0, 1.0))), (a, (0.5,))])
    assert [p.weight for p in MX.flatten([(0.5, [MX.Part("a", Bins((0.0, 1.0)), 2.0)]), (0.5, [MX.Part("b", Bins((0.0, 1.0)), 1.0), MX.Part("c", Bins((0.0, 1.0)), 3.0)])])] == [0.5, 0.125, 0.375]


# -- selection ---------------------------------------------------------------------


def small_grid(spark):
    """Three magnitude bins by two color bins; one pixel has no sample row."""
    sample = spark.createDataFrame([(11.0, 0.0, 0.7), (11.5, -0.5, 0.3), (13.0, 0.0, 0.9), (14.0, 1.0, 0.6), (18.0, 2.0, 0.2), (11.0, 2.9, 0.45)], "mag double, color double, y double")
    return SE.SelectionGrid.from_matrix(spark, [[0.4, 0.25, 0.0], [0.2, 0.8, 0.05]], [10.0, 12.0, 15.0, 19.0], [-1.0, 0.5, 3.0], sample)


SMALL = dict(magnitude="I", color=("G", "Z"), y="y")


def test_selection_keeps_the_ratio_of_each_pixel(spark):
    raw = values(spark, [11.0] * 30 + [14.0] * 40 + [17.0] * 20, "I", G=18.25, Z=18.0, y=0.1)
    kept = SE.grid_selection(raw, small_grid(spark), id_col="id", color_cut=False, **SMALL).where("keep")
    assert [kept.where(f"id >= {a} AND id < {b}").count() for a, b in ((0, 30), (30, 70), (70, 90))] == [12, 10, 0]


def test_ceilings_and_edges(spark):
    grid = small_grid(spark)
    got = {(r["px"], r["py"]): r["z_ceiling"] for r in grid.ceilings(100.0).collect()}
    assert got == {(0, 0): 0.7, (1, 0): 0.9, (2, 0): 0.0, (0, 1): 0.45, (1, 1): 0.6, (2, 1): 0.2}
    # Pixels are open on the left: the first edge is off the grid.
    raw = values(spark, [10.0, 12.0, 15.0, 19.0, 19.5], "I", G=2.0, Z=0.0, y=[0.4, 0.4, 0.7, 0.2, 0.4])
    out = SE.diagnose(raw, grid, percentile_cut=100.0, **SMALL).orderBy("id").collect()
    assert [r["px"] for r in out] == [-1, 0, 1, 2, 3] and [r["ratio"] for r in out] == [0.0, 0.2, 0.8, 0.05, 0.0]
    assert [r["survives_z_cut"] for r in out] == [True, True, False, True, True]
    with pytest.raises(KeyError):
        SE.diagnose(raw.drop("Z"), grid, **SMALL)


def mixed_catalog(spark, n=1500):
    """Objects over all six pixels."""
    rng = np.random.default_rng(8)
    g = rng.uniform(-0.9, 2.9, n)
    return values(spark, rng.uniform(10.1, 18.9, n), "I", G=g, Z=np.zeros(n), y=rng.uniform(0.02, 0.8, n))


def test_split_sizes_and_disjointness(spark):
    options = dict(id_col="id", n_train=90, n_calibration=70, tolerance=6, percentile_cut=100.0, **SMALL)
    split = SE.make_split(mixed_catalog(spark), small_grid(spark), control=True, **options)
    n = {r["split"]: r["count"] for r in split.df.groupBy("split").count().collect()}
    assert abs(n["biased"] - 90) <= 6 and n["calibration"] == 70
    assert split.sizes["n_holdout"] == n["calibration"] + n["test"] and split.sizes["n_biased"] == n["biased"]
    assert split.df.where("control").count() == n["biased"]
    assert split.df.where("control AND split IN ('test', 'calibration')").isEmpty()
    assert split.df.count() == 1500 and split.record(spark).count() == len(split.history)
    plain = SE.make_split(mixed_catalog(spark), small_grid(spark), **options)
    key = lambda s: sorted((r["id"], r["split"] or "") for r in s.df.select("id", "split").collect())
    assert key(plain) == key(split)


def test_solver_counts_equal_a_direct_count(spark):
    rng = np.random.default_rng(4)
    rows = [(float(rng.choice([0.2, 0.4, 0.8])), int(k)) for k in rng.permutation(900) + 1] + [(0.4, 2**62)] * 5
    df = spark.createDataFrame(rows, "ratio double, holdout_rank long")
    counts = SE._PoolCounts(df, 900)
    for rank in (1, 4, 5, 333, 899, 900):
        got = {r["ratio"]: r["n"] for r in counts.beyond(rank).collect()}
        expected = {}
        for ratio, k in rows:
            if k > rank:
                expected[ratio] = expected.get(ratio, 0) + 1
        assert got == expected


def test_split_reports_what_is_reachable(spark):
    with pytest.raises(RuntimeError, match="largest selection"):
        SE.make_split(mixed_catalog(spark, 350), small_grid(spark), id_col="id", n_train=340, tolerance=1, percentile_cut=100.0, **SMALL)
    rows = spark.createDataFrame([(2,), (2,)], "id long")
    with pytest.raises(ValueError):
        SE.make_split(mixed_catalog(spark, 350), small_grid(spark), id_col="id", n_train=20, holdout=rows, **SMALL)


def test_bags(spark):
    bags = SE.draw_bags(spark.range(90), "id", 5, 31, 11).toPandas()
    assert (bags.groupby("member").id.nunique() == 31).all() and len(bags) == 155
    assert len({tuple(sorted(g)) for _, g in bags.groupby("member").id}) == 5
    assert [SE.bag_rows(b, 10) for b in (None, 3, 0.25, 1.0, 99)] == [10, 3, 2, 10, 10]
    for bad in (0, 1.5, True, "a"):
        with pytest.raises(ValueError):
            SE.bag_rows(bad, 10)
    orders = SE.permutations(6, 3, 1)
    assert len({tuple(o) for o in orders}) == 6 and all(sorted(o) == [0, 1, 2] for o in SE.permutations(9, 3, 1))
    assert member_seed(0, 1) != member_seed(1, 0)


# -- features ------------------------------------------------------------------------


def test_feature_counts(spark):
    bands = FE.BANDS
    df = spark.range(3).select("id", *[F.lit(20.0 + i).alias(b) for i, b in enumerate(bands)], *[F.lit(0.1).alias(f"{b}ERR") for b in bands])
    assert [len(FE.build_features(df, m).columns) for m in FE.FEATURE_MODES] == [12, 12, 42]
    out = FE.build_features(df)
    assert out.columns[:6] == ["I", "U-G", "G-R", "R-I", "I-Z", "Z-Y"] and out.columns[6] == "IERR"
    assert out.first()["G-RERR"] == pytest.approx(math.hypot(0.1, 0.1)) and dict(out.dtypes)["I"] == "float"
    with pytest.raises(KeyError):
        FE.build_features(df.drop("UERR"))


def test_power_finds_the_likelihood_maximum(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.gamma(2, 2, 700), -rng.gamma(1, 0.5, 100)])

    def transform(lam):
        up = np.log1p(np.abs(x)) if lam == 0 else ((np.abs(x) + 1) ** lam - 1) / lam
        down = -np.log1p(np.abs(x)) if lam == 2 else -((np.abs(x) + 1) ** (2 - lam) - 1) / (2 - lam)
        return np.where(x >= 0, up, down)

    scan = np.linspace(-1, 2, 3001)
    score = [-0.5 * len(x) * np.log(transform(l).var()) + (l - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum() for l in scan]
    fitted = FE.Power.fit(values(spark, x).withColumn("c", F.lit(1.0)), ["x", "c"])
    assert set(fitted.params) == {"x"} and fitted.params["x"][0] == pytest.approx(scan[np.argmax(score)], abs=2e-3)
    out = fitted.transform(values(spark, x)).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(out[0]) < 1e-9 and out[1] == pytest.approx(1.0)


def test_quantile_map_is_normal_and_keeps_gaps(spark):
    x = np.random.default_rng(1).exponential(size=2000)
    df = values(spark, x)
    out = FE.QuantileMap.fit(df, ["x"]).transform(df).toPandas().x
    assert abs(out.mean()) < 0.02 and abs(out.std() - 1) < 0.03
    noisy = FE.QuantileMap.fit(df, ["x"], rule="noisy", seed=1).transform(df).toPandas().x
    assert np.corrcoef(out, noisy)[0, 1] > 0.99
    holes = values(spark, [0.5, float("nan"), -9.0, 1e9])
    got = [r["x"] for r in FE.QuantileMap.fit(df, ["x"]).transform(holes).orderBy("id").collect()]
    assert got[1] is None and got[2] == pytest.approx(-5.199, abs=1e-3) and got[3] == pytest.approx(5.199, abs=1e-3)


def test_inverse_normal(spark):
    p = [1e-9, 0.001, 0.025, 0.5, 0.84134474606854, 0.975, 0.999]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in p], "p double").select(normal_ppf(F.col("p"))).collect()]
    np.testing.assert_allclose(got, [-5.9978070150, -3.0902323062, -1.9599639845, 0.0, 1.0, 1.9599639845, 3.0902323062], atol=1e-7)


def test_soft_clip_passes_columns_without_spread(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, 2.0, 5.0), (2, 1.5, None), (3, 900.0, None)], "id long, a double, b double")
    out = FE.SoftClip.fit(df, ["a", "b"], 1.0).transform(df).orderBy("id").collect()
    assert out[3]["a"] < 900 and [r["b"] for r in out] == [None, 5.0, None, None]


def test_target_scaling_and_ordered_codes(spark):
    assert FE.target_scaling(values(spark, [0.1] * 5), "x") == (0.1, 1.0)
    df = spark.createDataFrame([("low",), ("high",)], "c string")
    assert [r["k"] for r in FE.ordered_codes(df, "c", ["low", "high"], "k").collect()] == [0, 1]
    with pytest.raises(ValueError):
        FE.ordered_codes(df, "c", ["low"], "k")


# -- estimators -----------------------------------------------------------------------


def test_bin_counts_and_layouts(spark):
    assert [E.auto_bin_count(n) for n in (0, 5, 44, 46, 150, 246, 330, 2_000)] == [2, 2, 2, 3, 5, 7, 8, 10]
    assert E.grid_layout(Bins(tuple(np.linspace(0, 1, 26)))).coarse.n == 3
    assert [f.n for f in E.grid_layout(Bins(tuple(np.linspace(0, 1, 26)))).fine] == [9, 8, 8]
    with pytest.raises(ValueError):
        E.choose_layout(values(spark, [1.0, 2.0]), "x", n_coarse=3, n_fine=3, low=0.0, high=3.0)
    tied = values(spark, [0.0] * 50 + list(np.linspace(0, 1, 50)))
    layout = E.equal_mass_layout(tied, "x", 4, 3, 0.0, 1.0)
    assert layout.bins.n == 12 and layout.coarse.edges[:2] == (0.0, 0.0)
    shares = E.hierarchy_shares(tied.withColumn("k", F.lit(1)), "x", layout, ["k"]).first()["masses"]
    assert sum(shares) == pytest.approx(1.0) and shares[0] == 0.0


@pytest.mark.parametrize("part_rows", [7, 4096])
def test_neighbours_in_parts(spark, monkeypatch, part_rows):
    monkeypatch.setattr(NB, "CELL_ROWS", 10)
    monkeypatch.setattr(NB, "TASK_QUERIES", 40)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(150, 6)), 1)
    x[40:80] = x[40]
    df = spark.createDataFrame([(i, v.tolist(), float(i % 7)) for i, v in enumerate(x)] + [(999, None, 1.0)], "id long, v array<double>, y double")
    args = dict(id_col="id", vector_col="v", context_id="id", value="y")
    got = {r["id"]: [t["id"] for t in r["neighbours"]] for r in NB.nearest(df, df, 9, part_rows=part_rows, **args).collect()}
    assert got.pop(999) == [] and len(got) == 150
    for i in range(150):
        assert got[i] == np.lexsort((np.arange(150), ((x - x[i]) ** 2).sum(1)))[:9].tolist()
    few = NB.nearest(df.limit(3), df.limit(2), 9, **args).collect()
    assert [len(r["neighbours"]) for r in few] == [2, 2, 2]
    assert [r["neighbours"] for r in NB.nearest(df.limit(3), df.limit(0), 9, **args).collect()] == [[], [], []]


def test_neighbours_visit_few_cells(spark, sf_dir):
    """Embeddings tiled tenfold: the triangle inequality leaves under three tenths of the pairs."""
    e = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/embeddings.parquet")
    tiled = e.crossJoin(spark.range(10)).select((F.col("vec_id") * 10 + F.col("id")).alias("id"), "embedding", "label")
    index = NB.metric_index(tiled, id_col="id", vector_col="embedding", value="label")
    done = NB.search(tiled.select(F.col("id").alias("qid"), F.col("embedding").cast("array<double>").alias("v")), index, 8)
    sizes = F.lit(index.sizes)
    pairs = done.visits.select(F.explode("cells").alias("c")).agg(F.sum(F.element_at(sizes, F.col("c") + 1))).first()[0]
    n = tiled.count()
    assert pairs < 0.3 * n * n
    found = done.found.groupBy("qid").agg(F.count("*").alias("k"), F.max("d").alias("d"), F.min(F.floor(F.col("cid") / 10) == F.floor(F.col("qid") / 10)).alias("own"))
    assert found.where("k = 8 AND d = 0 AND own").count() == n


def test_neighbours_of_clusters_are_pruned(spark):
    """Rows in separate clusters are only compared with their own."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 5)) * 100
    x = centers[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 5))
    df = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in enumerate(x)], "id long, v array<double>, y double")
    index = NB.metric_index(df, id_col="id", vector_col="v", value="y")
    done = NB.search(df.select(F.col("id").alias("qid"), "v"), index, 5)
    pairs = done.visits.select(F.explode("cells").alias("c")).agg(F.sum(F.element_at(F.lit(index.sizes), F.col("c") + 1))).first()[0]
    assert pairs < 0.1 * 4000 * 4000
    got = {r["qid"]: r["ids"] for r in done.found.where("qid < 200").groupBy("qid").agg(F.array_sort(F.collect_list("cid")).alias("ids")).collect()}
    for i in range(200):
        assert got[i] == sorted(np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:5].tolist())


def test_neighbours_meet_in_slabs(spark, monkeypatch):
    """A query is sent once per slab, not once per cell, and of a vector's copies only the first ids are searched."""
    monkeypatch.setattr(NB, "CELL_ROWS", 5)
    monkeypatch.setattr(NB, "SLAB_LEAST", 64)
    monkeypatch.setattr(NB, "BLOCK_ROWS", 16)
    seen = []
    monkeypatch.setattr(NB, "metric_index", lambda c, f=NB.metric_index, **options: seen.append((c.count(), f(c, **options))) or seen[-1][1])
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(700, 4)), 2)
    x[200:500] = x[7]
    df = spark.createDataFrame([(i, v.tolist(), float(i % 3)) for i, v in enumerate(x)], "id long, v array<double>, y double")
    got = {r["id"]: r["neighbours"] for r in NB.nearest(df, df, 4, id_col="id", vector_col="v", context_id="id", value="y").collect()}
    for i in range(700):
        d = ((x - x[i]) ** 2).sum(1)
        best = np.lexsort((np.arange(700), d))[:4]
        assert [(t["id"], t["y"]) for t in got[i]] == [(j, float(j % 3)) for j in best.tolist()]
        np.testing.assert_allclose([t["d"] for t in got[i]], d[best])
    (rows, index), = seen
    assert rows == 403
    slabs = NB._slabs(index, 64)
    assert 1 < slabs.n < len(index.sizes) / 4 and slabs.first[0] == 0 and slabs.last[-1] == len(index.sizes) - 1


def test_nearest_of_asks_and_bounds(monkeypatch):
    monkeypatch.setattr(NB, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(3)
    z, x = np.round(rng.normal(size=(60, 3)), 1), np.round(rng.normal(size=(20, 3)), 1)
    cell, cid = np.sort(rng.integers(0, 6, 60)), rng.permutation(60)
    ask = rng.random((20, 6)) < 0.5
    bound = np.where(rng.random(20) < 0.5, np.inf, 1.5)
    row, place, d = NB._nearest_of(x, z, (z * z).sum(1), cid, cell, ask, bound, 5)
    for i in range(20):
        own = ((z - x[i]) ** 2).sum(1)
        open_ = np.flatnonzero(ask[i][cell] & (own <= bound[i] ** 2))
        assert place[row == i].tolist() == open_[np.lexsort((cid[open_], own[open_]))[:5]].tolist()


@pytest.mark.parametrize("intervals", [1, 4, 64])
def test_brackets_by_hand(spark, monkeypatch, intervals):
    monkeypatch.setattr(RK, "_intervals", lambda df: intervals)
    rng = np.random.default_rng(intervals)
    knots = [(str(g), float(q), int(i)) for g in "ab" for i, q in enumerate(np.unique(np.round(rng.normal(size=60), 1)))] + [(None, 0.5, 7)]
    asked = [(str(g), float(v)) for g in "abc" for v in np.round(rng.normal(size=300), 2)] + [(None, 0.0), (None, 0.5), ("a", float("inf")), ("a", float("-inf")), ("a", float("nan")), ("b", None)]
    got = RK.bracket(spark.createDataFrame(asked, "g string, v double"), "v", spark.createDataFrame(knots, "g string, q double, i int"), "q", ["g"]).collect()
    want = {(g, v) for g, v in asked if v is not None and v == v}
    assert len(got) == len(want) == len({(r["g"], r["v"]) for r in got})
    for r in got:
        own = [(q, i) for g, q, i in knots if g == r["g"]]
        assert r["below"] == max((k for k in own if k[0] <= r["v"]), default=None)
        assert r["above"] == min((k for k in own if k[0] >= r["v"]), default=None)


def test_brackets_take_no_frame_to_the_last_row(spark):
    """Such a frame is computed anew for every row, so its time grows with the square of an interval's rows."""
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    for out in (RK.bracket(df, "v", df.withColumnRenamed("v", "q")), RK.spread_knots(df, "v", F.lit(20))):
        assert not re.search(r"(?<!unboundedpreceding\$\(\)), unboundedfollowing", out._jdf.queryExecution().toString())


def test_spread_knots_by_hand(spark, monkeypatch):
    monkeypatch.setattr(RK, "_intervals", lambda df: 5)
    rng = np.random.default_rng(3)
    columns = {"a": rng.normal(size=501), "b": np.round(rng.normal(size=333)), "c": np.array([1.0, 2.0]), "d": np.zeros(50), "e": np.r_[np.zeros(300), rng.normal(size=90)]}
    df = spark.createDataFrame([(c, float(v)) for c, x in columns.items() for v in x] + [("a", None), ("a", float("nan"))], "c string, v double")
    for per in (1, 5, 7):
        got = {}
        for r in RK.spread_knots(df, "v", F.greatest(F.floor(F.col("n") / per), F.lit(2)), ["c"]).collect():
            got.setdefault(r["c"], {}).update({i: r["q"] for i in range(r["first"], r["last"] + 1)})
            assert r["top"] == max(len(columns[r["c"]]) // per, 2) - 1
        for c, x in columns.items():
            want = np.quantile(x, np.linspace(0, 1, max(len(x) // per, 2)))
            np.testing.assert_allclose([got[c][i] for i in range(len(want))], want, atol=1e-12)
            assert len(got[c]) == len(want)


def test_spread_map_equals_the_map_of_as_many_knots(spark):
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(size=300), np.zeros(80), np.round(rng.normal(size=120), 1)]
    df = spark.createDataFrame([(i, float(v), float(v) ** 3) for i, v in enumerate(x)], "id long, a double, b double")
    new = spark.createDataFrame([(i, float(v), None if i % 9 == 0 else float(v)) for i, v in enumerate(np.r_[x[::3], rng.normal(size=100) * 2, [-99.0, 99.0]])], "id long, a double, b double")
    for output in ("uniform", "normal"):
        one = FE.QuantileMap.fit(df, ["a", "b"], output=output, rule="uniform").transform(new).orderBy("id").toPandas()
        two = FE.SpreadMap.fit(df, ["a", "b"], output=output).transform(new).orderBy("id").toPandas()
        np.testing.assert_allclose(two[["a", "b"]].to_numpy(float), one[["a", "b"]].to_numpy(float), atol=1e-9)
    plans = [len(FE.SpreadMap.fit(df.limit(k), ["a"]).knots._jdf.queryExecution().toString()) for k in (50, 500)]
    assert abs(plans[0] - plans[1]) < 200


def test_classifier_hierarchy_learns(spark):
    rng = np.random.default_rng(0)
    a = rng.uniform(-1, 1, 600)
    df = values(spark, a, "a", y=3 * a + rng.normal(0, 0.2, 600))
    layout = E.equal_mass_layout(df, "y", 3, 2, -4.0, 4.0)
    out = E.classifier_hierarchy(df, df, ["a"], "y", layout)
    rows = out.select(F.aggregate("masses", F.lit(0.0), lambda s, x: s + x).alias("t"), "y", H.mean("masses", layout.bins).alias("m")).toPandas()
    np.testing.assert_allclose(rows.t, 1.0)
    assert np.corrcoef(rows.y, rows.m)[0, 1] > 0.85


def _chain_by_hand(x, y, ridge=1e-3):
    """One logistic regression by plain Newton steps."""
    x = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    w, penalty = np.zeros(x.shape[1]), ridge * len(x) * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
    return w


def test_logistic_hierarchy_fits_every_split(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 1, 900), rng.normal(5, 3, 900)
    y = 2 * a - 0.3 * b + rng.normal(0, 0.7, 900)
    df = values(spark, a, "a", b=b, y=y)
    layout = E.equal_mass_layout(df, "y", 2, 2, -15.0, 15.0)
    model = LogisticHierarchy.fit(df, ["a", "b"], "y", layout)
    whole, x = model.weights[0], np.column_stack([a, b])
    # The scale is that of all rows, also in the splits of some.
    np.testing.assert_allclose(whole, _chain_by_hand(x, (y >= layout.coarse.edges[1]) * 1.0), atol=1e-7)
    out = model.predict(df).select(F.aggregate("masses", F.lit(0.0), lambda s, m: s + m).alias("t"), "y", H.mean("masses", layout.bins).alias("m")).toPandas()
    np.testing.assert_allclose(out.t, 1.0)
    assert np.corrcoef(out.y, out.m)[0, 1] > 0.8


def test_logistic_hierarchy_with_bins_that_no_row_reaches(spark):
    df = values(spark, [0.0, 1.0, 2.0, 3.0, float("nan")], "a", y=[0.5, 0.6, 2.5, 2.6, 0.7])
    fine = E.Bins((0.0, 0.25, 1.0)), E.Bins((1.0, 2.0)), E.Bins((2.0, 2.55, 3.0)), E.Bins((3.0, 4.0))
    layout = E.Layout(E.Bins((0.0, 1.0, 2.0, 3.0, 4.0)), fine)
    model = LogisticHierarchy.fit(df, ["a"], "y", layout)
    rows = model.predict(df).orderBy("id").collect()
    assert rows[4]["masses"] is None  # a missing feature
    for r in rows[:4]:
        m = r["masses"]
        assert len(m) == 6 and abs(sum(m) - 1.0) < 1e-12
        assert m[0] == m[2] == m[5] == 0.0  # context rows never fall there
        assert (m[1] > 0.5) == (r["a"] < 1.5)
    with pytest.raises(ValueError, match="no context row"):
        LogisticHierarchy.fit(df.where("id < 0"), ["a"], "y", layout)


class _FixedBins(E.DensityModel):
    """Bin shares in bins that do not depend on the context."""

    def _fit(self, df, low, high):
        self.bins = self.grid
        self.table = E.bin_shares(df, self.y, self.bins, self.keys)
        self.marginal = E.overall(df, lambda rows, keys: E.bin_shares(rows, self.y, self.bins, keys))


def test_sweeps_equal_one_fit_per_step(spark):
    rng = np.random.default_rng(8)
    key = [None if i % 9 == 0 else "abc"[i % 3] for i in range(240)]
    df = values(spark, rng.gamma(2.0, 1.0, 240).clip(0, 9.9), "y", key=key)
    grid = Grid.linear(0.0, 10.0, 12, normalization="histogram")
    names = ["model", "n", "cde_loss", "crps", "nll", "bias", "pit_ks"]

    def rows(report, *more):
        return sorted(tuple(r) for r in report.select(*names, *more).collect())

    def same(a, b):
        assert len(a) == len(b) > 0
        for x, y in zip(a, b, strict=True):
            assert x[0] == y[0]
            np.testing.assert_allclose(x[1:], y[1:], rtol=1e-9)

    # One row of context leaves most keys unknown; rows without a key take the whole context's density in the sweep, so they are left out here.
    known = df.where("key IS NOT NULL")
    make = lambda: _FixedBins(["key"], grid=grid)
    same(rows(SW.learning_curve(known, known, "y", ["key"], grid, grid, [2, 100], point="mean")),
         rows(R.learning_curve(make, known, known, [2, 100], point="mean")))
    low, rest = known.where("y < 2"), known.where("y >= 2")
    same(rows(SW.bias_repair(low, rest, known, "y", ["key"], grid, grid, [0, 1000], point="mean")),
         rows(R.bias_repair(make, low, rest, known, [0, 1000], point="mean")))
    out = SW.missing_data_stress(df, df, "y", ["key"], grid, grid, [0.0, 1.0], point="mean")
    found = {(r["model"], r["fraction"]): r["cde_loss"] for r in out.collect()}
    assert abs(found["test", 0.0] - found["both", 0.0]) < 1e-12
    # With every key masked, both tell the whole context's density.
    flat = make().fit(df.withColumn("key", F.lit("one"))).evaluate(df.withColumn("key", F.lit("one")), point="mean").first()["cde_loss"]
    assert abs(found["test", 1.0] - flat) < 1e-12 and abs(found["both", 1.0] - flat) < 1e-12
    with pytest.raises(ValueError, match="must not fall"):
        SW.first_step(df, [5, 2])


def test_external_predictor_is_checked(spark):
    df = values(spark, [1.0, 2.0])
    with pytest.raises(Exception, match="the predictor returned"):
        E.apply_predictor(df, ["x"], lambda b: np.zeros((len(b), 3)), 2).collect()


def test_constant_target(spark):
    model = E.DensityModel(["x"], "y").fit(values(spark, [1.0, 2.0], y=5.0))
    out = model.transform(values(spark, [3.0], y=5.0), "interval").first()["interval"]
    assert (out["lo"], out["hi"]) == (5.0, 5.0)


# -- diagnostics and recipes ------------------------------------------------------------


def test_coverage_curve_matches_a_scan_per_level(spark):
    u = np.round(np.random.default_rng(3).uniform(size=700), 3)
    got = X.coverage_curve(values(spark, u, "pit")).orderBy("nominal").collect()
    np.testing.assert_allclose([r["empirical"] for r in got], [np.mean(np.abs(u - 0.5) <= 0.5 * q) for q in np.linspace(0, 1, 101)])


def test_binned_quantiles_with_empty_bins(spark):
    out = X.binned_quantiles(values(spark, [1.0, 2.0, 9.0], y=[10.0, 20.0, 30.0]), "x", "y", edges=[0, 3, 5, 9]).orderBy("bin").collect()
    assert [r["n"] for r in out] == [2, 0, 1] and out[0]["q"][1] == 15.0 and math.isnan(out[1]["q"][0]) and out[2]["q"][0] == 30.0


def test_four_panels(spark):
    grid = Grid.linear(0, 1, 20)
    rows = [(i, [1.0] * 20, i / 50, i / 60, i / 50) for i in range(50)]
    out = X.four_panels(spark.createDataFrame(rows, "id long, pdf array<double>, y double, y_pred double, pit double"), "pdf", grid, 5)
    assert out["truth_estimate"].agg(F.sum("n")).first()[0] == 50 and out["stacked"].count() == 20
    assert out["residuals"].count() == 20 and out["pit_points"].count() == 50


def test_shuffled_column_keeps_its_values(spark):
    df = values(spark, np.arange(200.0))
    out = R.shuffled_column(df, "x", "id", 4).toPandas()
    assert sorted(out.x) == list(range(200)) and (out.x != out.id).mean() > 0.9


def test_shuffled_column_meets_by_rank_after_one_shuffle(spark, monkeypatch):
    """Equal to a join of the ranks, NULLs and texts included; rows and values are shuffled once, besides the counts and cuts."""
    monkeypatch.setattr(R, "hash_blocks", lambda *a, f=RK.hash_blocks: f(*a, 40))
    rng = np.random.default_rng(6)
    x = [None if i % 7 == 0 else float(v) for i, v in enumerate(rng.normal(size=1500))]
    df = spark.createDataFrame([(i, v, f"t{i % 5}" if i % 3 else None) for i, v in enumerate(x)], "id long, x double, t string")
    for column in ("x", "t"):
        rows = RK.hash_ranks(df.drop(column), "9/rows", "id")
        dealt = RK.hash_ranks(df.select("id", column), "9/values", "id").select("rank", column)
        want = {(r["id"], r["x"], r["t"]) for r in rows.join(dealt, "rank").collect()}
        out = R.shuffled_column(df, column, "id", 9)
        assert out.columns == [*[c for c in df.columns if c != column], column]
        assert {(r["id"], r["x"], r["t"]) for r in out.collect()} == want and len(want) == 1500
    sizes = [r["count"] for r in RK.hash_blocks(df, "9/rows", "id", 40).groupBy("_block").count().orderBy("_block").collect()]
    assert len(sizes) > 4 and len(set(sizes[:-1])) == 1 and sum(sizes) == 1500


def test_permutation_importance_computes_its_rows_once(spark):
    df = spark.range(200).select("id", (F.rand(1) + F.col("id")).alias("a"), F.rand(2).alias("b"))
    score = lambda d: -d.agg(F.avg(F.abs(F.col("a") - F.col("b")))).first()[0]
    assert computed(spark, df, lambda d: R.permutation_importance(d, ["a", "b"], score, repeats=2).collect()) == 1


def test_a_written_score_table_is_not_written_again(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, "ab"[i % 2], float(y), float(y + e), float(c), float(u), float(s), float(g)) for i, (y, e, c, u, s, g) in enumerate(rng.random((400, 6)))]
    spark.createDataFrame(rows, "id long, key string, y double, y_pred double, cde double, pit double, crps double, nll double").write.parquet(str(tmp_path / "s"))
    want = {r["key"]: r for r in M.summarize(spark.read.parquet(str(tmp_path / "s")), by=["key"], point="mean").collect()}
    kept = []
    monkeypatch.setattr(M, "materialize", lambda df, f=M.materialize: kept.append(f(df)) or kept[-1])
    got = {r["key"]: r for r in ST.roll_up(spark, str(tmp_path / "s"), ["key"], point="mean").collect()}
    assert got == want and all(df.count() == 2 for df in kept)


def test_cross_fitted_rows_stay_where_they_are(spark, sf_dir):
    """The densities go to the events, and no filter hashes the ids once more."""
    from tessella.plans import inputs
    plan = inputs.cross_predictions(spark, sf_dir)._jdf.queryExecution()
    assert "BroadcastHashJoin [key" in plan.executedPlan().toString()
    assert not [line for line in plan.optimizedPlan().toString().splitlines() if "Filter" in line and "md5" in line]


def test_scores_in_slices(spark, monkeypatch):
    """A batch is scored slice by slice; rows that cannot be scored are NULL among their neighbours."""
    grid = Grid.linear(0, 4, 4, normalization="histogram")
    rng = np.random.default_rng(2)
    rows = [(i, None if i == 3 else d.tolist() if i != 4 else d[:3].tolist(), None if i == 5 else float(y)) for i, (d, y) in enumerate(zip(rng.random((50, 4)), rng.random(50) * 4))]
    df = spark.createDataFrame(rows, "id long, d array<double>, y double").coalesce(1)
    score = lambda: {r["id"]: r["s"] for r in df.select("id", kernels.object_scores(F.col("d"), F.col("y"), grid, 1e-12).alias("s")).collect()}
    whole = score()
    monkeypatch.setattr(kernels, "SLICE", 12)
    assert score() == whole and [i for i, s in whole.items() if s["cde"] is None] == [3, 4, 5]


# -- sources and checks --------------------------------------------------------------------


def test_catalog_makes_a_dense_id(spark):
    out = S.catalog(spark.createDataFrame([(float(i % 5), i * 2.0) for i in range(40)], "a double, z double"), "z")
    assert sorted(r["object_id"] for r in out.collect()) == list(range(40)) and out.columns == ["object_id", "y", "a"]


def test_ensemble_keeps_a_point_mass(spark, tmp_path):
    bins = Bins((0.0, 1.0, 1.0, 3.0, 3.0))
    df = spark.createDataFrame([(7, [0.1, 0.2, 0.3, 0.4])], "id long, p array<double>")
    EN.write_histograms(df, "p", bins, str(tmp_path / "e"), ["id"])
    back, kind, axis = EN.read(spark, str(tmp_path / "e"))
    assert kind == "hist" and axis == [0.0, 1.0, 3.0]
    np.testing.assert_allclose(back.first()["masses"], [0.1, 0.9])


def test_stored_densities_compute_their_masses_once_per_row(spark):
    """A draw that were repeated per bucket would differ between buckets."""
    bins = Bins((0.0, 1.0, 2.0, 3.0, 4.0))
    rows = spark.range(20).select(EN.histogram_pdfs(F.array_repeat(F.rand(3), 4), bins).alias("d")).collect()
    assert all(len(set(r["d"])) == 1 for r in rows) and len({r["d"][0] for r in rows}) == 20


def test_input_checks(spark):
    df = spark.createDataFrame([(1.0, "a", 2), (float("inf"), "3", None)], "x double, s string, k int")
    assert V.not_numeric(df, ["x", "s", "k"]) == ["s"] and V.infinite_columns(df, ["x", "k"]) == ["x"]
    with pytest.raises(ValueError):
        V.check_target(df, "x")
    assert V.align_columns(df.select("k", "x"), ["x", "k"]).columns == ["x", "k"]
    with pytest.raises(ValueError):
        V.align_columns(df.select("k", "x"), ["x", "z"])
    table = V.as_table(spark, [[1, 2], [3, 4]])
    assert table.columns == ["x0", "x1"] and V.as_table(spark, pd.DataFrame({0: [1.0]})).columns == ["x0"]


def test_levels_are_counted_with_weights(spark):
    rows = [(0.2, 1, 3), (0.7, 2, 1), (None, 1, 4), (0.4, None, 2)]
    some = spark.createDataFrame(rows, "p double, y int, n int").withColumn("prob", F.array("p"))
    each = some.withColumn("_", F.explode(F.sequence(F.lit(1), "n")))
    one, all_rows = (R.predicted_and_observed(d, "prob", "y", [1], w).first() for d, w in ((some, "n"), (each, None)))
    assert one["predicted"] == pytest.approx(all_rows["predicted"]) == pytest.approx((0.6 + 0.7 + 0.8) / 6)
    assert one["observed"] == pytest.approx(all_rows["observed"]) == pytest.approx(7 / 8)


def computed(spark, df, run):
    """How many times ``run`` computes each row of ``df``, which must hold a column ``a`` of doubles."""
    seen, n = spark.sparkContext.accumulator(0), df.count()

    def note(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    run(df.mapInArrow(note, df.schema))
    return seen.value / n


def test_fits_of_many_passes_compute_their_rows_once(spark):
    df = spark.range(200).select("id", (F.rand(1) + F.col("id")).alias("a"), F.rand(2).alias("b"))
    assert computed(spark, df, lambda d: FE.Power.fit(d, ["a", "b"])) == 1
    assert computed(spark, df, lambda d: FE.column_quantiles(d, ["a", "b"], [0.5])) == 1
    assert computed(spark, df, lambda d: X.residual_quantiles(d, "a", "b", 4).collect()) == 1
    assert computed(spark, df.withColumn("s", F.lit("x")), lambda d: SE.describe_subsets(d, "s", "a", "b", 1.0).collect()) == 1
