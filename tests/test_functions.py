"""Column builders against slow numpy re-derivations, edge rules included."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import histogram as H, kernels, points as P, quantile as Q, scores as C
from tessella.functions.arrays import vector
from tessella.functions.grids import Bins, Grid, constant_bins, default_grid, quantile_native_grid, union_bins

BINS = {
    "ragged": (0.0, 0.5, 0.5, 1.25, 2.0, 2.0, 3.5, 7.0),
    "uniform": tuple(np.linspace(-2, 3, 11)),
    "wide": tuple(np.concatenate([np.linspace(0, 1, 40), np.geomspace(1.1, 9, 50)])),
    "atom_at_end": (0.0, 1.0, 1.0),
    "offset": tuple(1e6 + np.array([0.0, 0.001, 0.002, 0.002, 0.01])),
}
LEVELS = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)


def frame(spark, column, rows, extra=None):
    data = [(i, [float(x) for x in r], *([] if extra is None else [float(extra[i])])) for i, r in enumerate(rows)]
    schema = f"id long, {column} array<double>" + ("" if extra is None else ", y double")
    return spark.createDataFrame(data, schema).repartition(3)


def collect(df, *cols):
    rows = df.select("id", *[c.alias(f"c{i}") for i, c in enumerate(cols)]).orderBy("id").collect()
    return [tuple(r)[1:] for r in rows]


@pytest.mark.parametrize("name", BINS)
def test_histogram_family(spark, name):
    bins = Bins(BINS[name])
    e = bins.array
    rng = np.random.default_rng(3)
    rows = rng.gamma(0.7, size=(6, bins.n)) * (rng.uniform(size=(6, bins.n)) < 0.7)
    rows[1] = 0.0
    y = np.concatenate([[e[0], e[-1], e[0] - 1, e[-1] + 1], rng.uniform(e[0], e[-1], 1), [e[1]]])
    df = frame(spark, "m", rows, y).withColumn("p", H.probabilities("m", bins))
    values = np.unique(np.concatenate([e, [e[0] - 1, e[-1] + 1], rng.uniform(e[0], e[-1], 4)]))
    target = Bins(tuple(np.linspace(e[0] + 0.1 * (e[-1] - e[0]), e[-1], 6)))
    shifted = Bins(tuple(np.sort(np.concatenate([e[1:3], [e[2]], rng.uniform(e[0], e[-1], 3)]))))
    got = collect(df, F.col("p"), H.cdf_at("p", bins, F.col("y")), H.cdf_values("p", bins, values),
                  H.ppf("p", bins, LEVELS), H.ppf_jvm("p", bins, vector(LEVELS)), H.mean("p", bins), H.var("p", bins),
                  H.regrid("p", bins, target), H.outside("p", bins, target), H.regrid("p", bins, shifted),
                  H.pdf_at("p", bins, F.col("y")), H.pdf_values("p", bins, y), H.mode("p", bins),
                  H.atom_at("p", bins, F.lit(float(e[1]))), H.atoms("p", bins, [e[1]]))
    scale = e[-1] - e[0]
    for i, g in enumerate(got):
        p = brute.probs(rows[i], e)
        np.testing.assert_allclose(g[0], p, atol=1e-15)
        np.testing.assert_allclose(g[1], brute.hist_cdf(p, e, y[i]), atol=1e-9)
        np.testing.assert_allclose(g[2], [brute.hist_cdf(p, e, v) for v in values], atol=1e-9)
        want = [brute.hist_ppf(p, e, q) for q in LEVELS]
        np.testing.assert_allclose(g[3], want, atol=1e-9 * scale)
        np.testing.assert_allclose(g[4], want, atol=1e-9 * scale)
        c = 0.5 * (e[1:] + e[:-1])
        np.testing.assert_allclose(g[5], p @ c, rtol=1e-12)
        np.testing.assert_allclose(g[6], p @ ((c - p @ c) ** 2 + np.diff(e) ** 2 / 12), rtol=1e-9, atol=1e-15)
        masses, out = brute.hist_masses(p, e, target.array)
        np.testing.assert_allclose(g[7], masses, atol=1e-9)
        np.testing.assert_allclose(g[8], out, atol=1e-9)
        np.testing.assert_allclose(g[9], brute.hist_masses(p, e, shifted.array)[0], atol=1e-9)
        w = np.diff(e)
        dens = np.divide(p, w, out=np.full(len(w), -np.inf), where=w > 0)
        np.testing.assert_allclose(g[12], c[np.argmax(dens)], rtol=1e-12)
        for x, d in [(y[i], g[10])] + list(zip(y, g[11])):
            k = [j for j in range(bins.n) if w[j] > 0 and (e[j] <= x < e[j + 1] or (x == e[-1] and e[j + 1] == e[-1]))]
            np.testing.assert_allclose(d, p[k[0]] / w[k[0]] if k else 0.0, rtol=1e-9)
        atom = sum(p[j] for j in range(bins.n) if w[j] == 0 and e[j] == e[1])
        assert g[13] == pytest.approx(atom) and g[14][0] == pytest.approx(atom)


def test_empty_row_skips_zero_width_buckets(spark):
    got = collect(frame(spark, "m", [[0, 0, 0]]), H.probabilities("m", Bins((0.0, 1.0, 1.0, 2.0))))
    assert got[0][0] == [0.5, 0.0, 0.5]


def test_invalid_masses(spark):
    df = frame(spark, "m", [[1, 2], [1, -1], [float("nan"), 1], [1, 2, 3], [float("inf"), 0]])
    assert [r[0] for r in collect(df, H.invalid_masses("m", Bins((0.0, 1.0, 2.0))))] == [False, True, True, True, True]


@pytest.mark.parametrize("levels", [(0.05, 0.25, 0.5, 0.75, 0.95), (0.0, 0.3, 1.0), tuple(np.linspace(0.02, 0.98, 25))])
def test_quantile_family(spark, levels):
    q, n = np.array(levels), len(levels)
    rng = np.random.default_rng(5)
    rows = np.sort(rng.normal(1, 0.3, (5, n)), axis=1)
    rows[1, : n // 2 + 1] = rows[1, n // 2]
    rows[2] = rows[2, 0]
    rows[3] = rows[3, ::-1]
    y = np.array([1.0, rows[1, 0], rows[2, 0], 0.2, rows[4, -1]])
    df = frame(spark, "v", rows, y).withColumn("l", Q.monotone("v")).withColumn("k", Q.knots("l", q))
    values = np.unique(np.concatenate([np.linspace(-1, 3, 9), rows[1], rows[4]]))
    small, large = Bins(tuple(np.linspace(0.5, rows[1, 0], 5))), Bins(tuple(np.linspace(0.3, 2.1, 900)))
    got = collect(df, F.col("k"), Q.cdf_at("k", q, F.col("y")), Q.cdf_values("k", q, values), Q.ppf("k", q, LEVELS),
                  Q.mean("k", q), Q.var("k", q), Q.mode("l", q), Q.regrid("k", q, small), Q.outside("k", q, small),
                  Q.regrid("k", q, large), Q.pdf_at("l", q, F.col("y")), Q.atom_at("k", q, F.col("y")),
                  Q.ppf_at("k", q, F.lit(0.37)), Q.regrid("l", q, small, tails=False))
    for i, g in enumerate(got):
        lv, kn = brute.knots(q, rows[i])
        p, e = brute.pieces(lv, kn)
        np.testing.assert_allclose(g[0], kn, atol=1e-12)
        np.testing.assert_allclose(g[1], brute.hist_cdf(p, e, y[i]), atol=1e-9)
        np.testing.assert_allclose(g[2], [brute.hist_cdf(p, e, v) for v in values], atol=1e-9)
        np.testing.assert_allclose(g[3], np.interp(LEVELS, lv, kn), atol=1e-9)
        np.testing.assert_allclose(g[12], np.interp(0.37, lv, kn), atol=1e-9)
        c = 0.5 * (e[1:] + e[:-1])
        np.testing.assert_allclose(g[4], p @ c, atol=1e-12)
        np.testing.assert_allclose(g[5], p @ ((c - p @ c) ** 2 + np.diff(e) ** 2 / 12), atol=1e-12)
        for target, mass in ((small, g[7]), (large, g[9])):
            np.testing.assert_allclose(mass, brute.hist_masses(p, e, target.array)[0], atol=1e-9)
        np.testing.assert_allclose(g[8], brute.hist_masses(p, e, small.array)[1], atol=1e-9)
        tied = sum(s for s, a, b in zip(p, e[:-1], e[1:]) if a == b == y[i])
        assert g[11] == pytest.approx(tied)
        v = np.maximum.accumulate(rows[i])
        # Without tails the outer mass sits on the outer values.
        lv2, kn2 = np.r_[0, q, 1], np.r_[v[0], v, v[-1]]
        np.testing.assert_allclose(g[13], brute.hist_masses(np.diff(lv2), kn2, small.array)[0], atol=1e-9)


def test_quantile_pdf_and_mode(spark):
    q = np.array([0.2, 0.5, 0.8])
    df = frame(spark, "l", [[0.0, 1.0, 3.0]] * 7, [-1.5, -1.0, 0.0, 1.0, 3.0, 5.0, 5.5])
    got = collect(df, Q.pdf_at("l", q, F.col("y")), Q.mode("l", q))
    np.testing.assert_allclose([g[0] for g in got], [0, 0.2, 0.3, 0.15, 0.15, 0.1, 0])
    assert got[0][1] == 0.5
    # A tail that is clearly denser than every segment is the mode.
    dense = frame(spark, "l", [[0.0, 1.0, 10.0]])
    assert collect(dense, Q.mode("l", [0.6, 0.7, 0.8]))[0][0] == pytest.approx(-0.5)


@pytest.mark.parametrize("norm", ["trapezoid", "histogram"])
@pytest.mark.parametrize("n", [12, 60])
def test_grid_scores_and_points(spark, norm, n):
    rng = np.random.default_rng(11)
    edges = np.linspace(0, 2, n + 1) if n == 60 else np.sort(rng.uniform(0, 2, n + 1))
    grid, hist = Grid(tuple(edges), norm), norm == "histogram"
    rows = rng.gamma(0.8, size=(8, n))
    rows[0, 2], rows[0, 3], rows[0, 4] = np.nan, np.inf, -1.0
    rows[1] = 0.0
    rows[2] = 0.0
    rows[2, 4] = 3.0
    y = np.concatenate([[edges[0], edges[-1], edges[0] - 0.3, edges[-1] + 0.2, grid.centers[0], edges[3]], rng.uniform(0.2, 1.8, 2)])
    df = frame(spark, "pdf", rows, y).withColumn("d", grid.normalize("pdf"))
    t = F.col("y")
    masses = grid.masses(F.col("d"))
    got = collect(df, F.col("d"), grid.normalization_error("d"), grid.cdf("d"), grid.density_at(F.col("d"), t), C.pit("d", grid, t),
                  C.cde("d", grid, t), C.nll("d", grid, t), C.crps("d", grid, t), C.crps_jvm(masses, t, grid.nodes),
                  kernels.crps(F.col("d"), t, grid), *P.all_estimates("d", grid), P.peaks("d"), grid.bin_index(t))
    for i, g in enumerate(got):
        d = brute.normalize(rows[i], edges, hist)
        m, nodes = brute.grid_masses(d, edges, hist)
        c, w = grid.centers, brute.node_weights(edges, hist)
        np.testing.assert_allclose(g[0], d, rtol=1e-10)
        assert g[1] < 1e-12
        cdf = np.cumsum(m) - m / 2 if hist else np.r_[0, np.cumsum(m)]
        np.testing.assert_allclose(g[2], cdf, atol=1e-12)
        if hist:
            k = np.clip(np.searchsorted(edges, y[i], side="right") - 1, 0, n - 1)
            at = d[k] if edges[0] <= y[i] <= edges[-1] else 0.0
        else:
            off = y[i] < c[0] - (c[1] - c[0]) / 2 or y[i] > c[-1] + (c[-1] - c[-2]) / 2
            at = 0.0 if off else d[np.searchsorted(0.5 * (c[1:] + c[:-1]), y[i], side="right")]
        np.testing.assert_allclose(g[3], at, rtol=1e-10)
        np.testing.assert_allclose(g[4], np.interp(y[i], nodes, np.r_[0, np.cumsum(m)], left=0, right=1), atol=1e-9)
        np.testing.assert_allclose(g[5], (d * d) @ w - 2 * at, rtol=1e-9)
        np.testing.assert_allclose(g[6], -np.log(max(at, 1e-12)), rtol=1e-9)
        for value in g[7:10]:
            np.testing.assert_allclose(value, brute.crps(m, nodes, y[i]), rtol=1e-7, atol=1e-10)
        np.testing.assert_allclose(g[10], c[np.argmax(d)])
        np.testing.assert_allclose(g[11], brute.peak_mean(d, edges, hist), rtol=1e-9)
        np.testing.assert_allclose(g[12], (d * w) @ c, rtol=1e-9)
        np.testing.assert_allclose(g[13], brute.hist_ppf(m / m.sum(), nodes, 0.5), rtol=1e-7)
        assert g[14] == brute.peaks(d)
        assert g[15] == np.clip(np.searchsorted(edges, y[i], side="right") - 1, 0, n - 1)


def test_searches_match_numpy_on_every_edge_layout(spark):
    for name, edges in BINS.items():
        bins = Bins(edges)
        x = np.unique(np.concatenate([bins.array, bins.centers, [bins.array[0] - 1, bins.array[-1] + 1]]))
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
        got = collect(df, bins.count_le(F.col("x")), bins.count_lt(F.col("x")))
        np.testing.assert_array_equal([g[0] for g in got], np.searchsorted(bins.array, x, side="right"), err_msg=name)
        np.testing.assert_array_equal([g[1] for g in got], np.searchsorted(bins.array, x, side="left"), err_msg=name)


def test_softmax_and_borders(spark):
    df = frame(spark, "z", [[0.0, 1.0, 800.0], [1.0, 1.0, 1.0]])
    got = collect(df, H.softmax("z", 0.9))
    np.testing.assert_allclose(got[0][0], [0, 0, 1], atol=1e-12)
    np.testing.assert_allclose(got[1][0], [1 / 3] * 3)
    assert H.scaled_bins([-1, 0, 2], 10.0, 2.0).edges == (8.0, 10.0, 14.0)
    with pytest.raises(ValueError):
        H.scaled_bins([-1e-9, 0, 1e-9], 1e12, 1e-9)


def test_pinball_is_half_the_absolute_error_at_the_median(spark):
    df = frame(spark, "q", [[1.0], [4.0]], [3.0, 1.0])
    assert [g[0] for g in collect(df, C.pinball(F.col("y"), "q", [0.5]))] == [1.0, 1.5]


def test_grids():
    grid = Grid.linear(0.0, 2.0, 200)
    assert grid.n == 200 and grid.centers[0] == pytest.approx(0.005)
    assert quantile_native_grid(0, 1).n == 1500 and default_grid(0, 1).edges[0] == -0.05
    assert union_bins([Bins((0.0, 1.0)), Bins((0.5, 2.0))]).edges == (0.0, 0.5, 1.0, 2.0)
    assert constant_bins(5.0).widths[1] == 0.0
    for bad in ((0.0, 1.0, 1.0), (0.0, 1.0)):
        with pytest.raises(ValueError):
            Grid(bad)


def test_row_results_do_not_depend_on_partitioning(spark):
    grid = Grid.linear(0, 1, 40)
    rows = np.random.default_rng(0).gamma(1, size=(30, 40))
    df = frame(spark, "pdf", rows, np.linspace(0, 1, 30))
    one, many = (sorted(map(tuple, C.object_scores(df.repartition(k), "pdf", "y", grid, "median").drop("pdf").collect())) for k in (1, 7))
    assert one == many


@pytest.mark.parametrize("norm", ["trapezoid", "histogram"])
def test_one_pass_scores_equal_the_separate_ones(spark, norm):
    grid = Grid(tuple(np.geomspace(1, 5, 50) - 1), norm)
    rng = np.random.default_rng(9)
    rows = rng.gamma(0.8, size=(12, 49))
    rows[0, :5], rows[1] = [np.nan, np.inf, -1, 0, 2], 0.0
    y = np.concatenate([[0.0, 4.0, -0.5, 4.5, grid.centers[0], grid.centers[-1]], rng.uniform(0, 4, 6)])
    df = frame(spark, "pdf", rows, y).withColumn("d", grid.normalize("pdf"))
    t = F.col("y")
    apart = collect(df, C.cde("d", grid, t), C.pit("d", grid, t), C.crps_jvm(grid.masses(F.col("d")), t, grid.nodes), C.nll("d", grid, t), P.mean("d", grid))
    once = C.object_scores(df, "pdf", "y", grid, "mean")
    got = collect(once, *[F.col(c) for c in ("cde", "pit", "crps", "nll", "y_pred")])
    np.testing.assert_allclose(got, apart, rtol=1e-9, atol=1e-12)


# -- rows with edges of their own ---------------------------------------------------


def ragged_rows(n=60, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        k = int(rng.integers(1, 9))
        e = np.sort(np.round(rng.normal(size=k + 1), 1 if i % 3 else 6))
        m = rng.gamma(1.0, size=k) * (rng.uniform(size=k) > 0.3)
        out.append((i, e.tolist(), m.tolist(), float(np.round(rng.normal(), 1))))
    return out


def test_ragged_rows_equal_shared_ones(spark):
    """Each row alone, through the functions of shared bins."""
    from tessella.functions import ragged as RG

    rows = ragged_rows()
    df = spark.createDataFrame(rows, "id long, b array<double>, m array<double>, y double").repartition(3)
    grid = np.linspace(-1.5, 1.5, 13)
    got = {r["id"]: r for r in df.select(
        "id", RG.cdf_at("b", "m", F.col("y")).alias("pit"), RG.cdf_values("b", "m", [-0.5, 0.0, 0.7]).alias("cdf"), RG.ppf("b", "m", [0.0, 0.2, 0.5, 0.99, 1.0]).alias("q"),
        RG.crps("b", "m", F.col("y")).alias("crps"), RG.regrid("b", "m", grid).alias("g")).collect()}
    for i, e, m, y in rows:
        e, m = np.array(e), np.array(m)
        w = np.diff(e)
        p = m / m.sum() if m.sum() > 0 else (w > 0) / (w > 0).sum() if (w > 0).any() else np.full(len(m), 1 / len(m))
        cdf = lambda x: sum(q * (np.clip((x - a) / (b - a), 0, 1) if b > a else float(x >= a)) for q, a, b in zip(p, e[:-1], e[1:]))  # noqa: B023, E731
        assert got[i]["pit"] == pytest.approx(cdf(y), abs=1e-12)
        np.testing.assert_allclose(got[i]["cdf"], [cdf(x) for x in (-0.5, 0.0, 0.7)], atol=1e-12)
        held = np.flatnonzero(p > 0)
        assert got[i]["q"][0] == e[held[0]] and got[i]["q"][4] == e[held[-1] + 1]
        for level, x in zip((0.2, 0.5, 0.99), got[i]["q"][1:4]):
            assert cdf(x + 1e-9) >= level - 1e-9 and cdf(x - 1e-6) <= level + 1e-9
        x = np.unique(np.r_[np.linspace(min(e[0], y), max(e[-1], y), 20_001), e, y])
        mid = (x[1:] + x[:-1]) / 2
        f = np.sum([q * (np.clip((mid - a) / (b - a), 0, 1) if b > a else (mid >= a)) for q, a, b in zip(p, e[:-1], e[1:])], axis=0)
        assert got[i]["crps"] == pytest.approx(float(np.sum(np.diff(x) * (f - (mid >= y)) ** 2)), abs=1e-5)
        inside = [cdf(g) for g in grid]
        inside[0] = cdf(np.nextafter(grid[0], -9))
        np.testing.assert_allclose(got[i]["g"], np.diff(inside), atol=1e-12)


def test_ragged_rows_that_are_no_distributions(spark):
    from tessella.functions import ragged as RG

    good = ([0.0, 1.0, 3.0], [1.0, 1.0])
    bad = [(None, [1.0]), ([0.0, 1.0], None), ([0.0, 1.0], [1.0, 2.0]), ([1.0, 0.0], [1.0]), ([0.0, float("inf")], [1.0]), ([0.0, 1.0], [-1.0]), ([0.0, 1.0], [float("nan")]), ([0.0, None], [1.0]), ([0.0, 1.0], [None]), ([1.0], []), ([], [])]
    rows = [(k, *x) for k, x in enumerate([good, *[x for b in bad for x in (b, good)]])]
    df = spark.createDataFrame([(*r, 2.0) for r in rows] + [(99, *good, None), (98, *good, float("inf"))], "id long, b array<double>, m array<double>, y double").coalesce(1)
    out = df.select("id", RG.cdf_at("b", "m", F.col("y")).alias("pit"), RG.ppf("b", "m", [0.5]).alias("q"), RG.crps("b", "m", F.col("y")).alias("crps"), RG.regrid("b", "m", [0.0, 2.0]).alias("g")).collect()
    for r in out:
        if r["id"] in (98, 99):
            assert r["pit"] is None and r["crps"] is None and r["q"] == [1.0]
        elif r["id"] % 2:
            assert (r["pit"], r["q"], r["crps"], r["g"]) == (None, None, None, None)
        else:
            assert (r["pit"], r["q"], r["g"]) == (0.75, [1.0], [0.75])
    assert df.limit(0).select(RG.ppf("b", "m", [0.5])).count() == 0


def test_raw_rows_equal_normalized_ones(spark, monkeypatch):
    """Kernels that normalize inside give what a pass before them gives, slice by slice, rows without mass and odd rows included."""
    monkeypatch.setattr(kernels, "SLICE", 40)
    rng = np.random.default_rng(8)
    grid = Grid.linear(0.0, 3.0, 12, normalization="histogram")
    other = Bins(tuple(np.sort(rng.uniform(0, 3, 7))))
    rows = [rng.gamma(1.0, size=12) * 10 for _ in range(50)] + [np.zeros(12), np.ones(11), None]
    df = spark.createDataFrame([(i, None if m is None else m.tolist()) for i, m in enumerate(rows)], "id long, m array<double>").coalesce(1)
    df = df.withColumn("p", H.probabilities("m", grid)).withColumn("d", grid.normalize("m"))
    out = df.select(
        "id", H.on_grid("m", grid, grid, raw=True).alias("a"), H.on_grid("p", grid, grid).alias("b"), H.regrid("m", grid, other, raw=True).alias("c"), H.regrid("p", grid, other).alias("e"),
        F.struct(*P.all_estimates("m", grid, raw=True)).alias("f"), F.struct(*P.all_estimates("d", grid)).alias("g")).collect()
    for r in out:
        if r["id"] >= 51:
            assert r["a"] is r["c"] is None and r["f"]["mode"] is None
            continue
        np.testing.assert_allclose(r["a"], r["b"], atol=1e-12)
        np.testing.assert_allclose(r["c"], r["e"], atol=1e-12)
        np.testing.assert_allclose(list(r["f"]), list(r["g"]), atol=1e-12)
