"""Queries of the conditional-density estimators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import histogram as H
from tessella.functions.grids import Bins
from tessella.operators import estimators as E, selection as SE
from tessella.operators.logistic import RIDGE, LogisticHierarchy
from tessella.plans import inputs as I
from tessella.plans.inputs import rounded as r, uniform_sql
from tessella.plans.registry import query
from tessella.plans.relational import KNN, neighbours

LOW, HIGH = 0.0, 500.0
BASE = f"WITH {I.EV}, {I.grid_sql()}"


def long(df: DataFrame, keys: list[str], array: str, name: str, digits: int = 8) -> DataFrame:
    out = df.select(*keys, F.posexplode(array).alias("bin", "v"))
    return out.select(*keys, F.col("bin").cast("long").alias("bin"), r("v", digits).alias(name))


@query("e1_marginal", f"{BASE}, n AS (SELECT {I.bin_sql('y')} AS bin, count(*) AS k FROM ev GROUP BY 1), p AS (SELECT bin, k / sum(k) OVER () AS p FROM n) SELECT id, round(p, 8) AS p FROM ev JOIN p ON p.bin = {I.bin_sql('y')}")
def e1(spark, sf):
    """Every event gets the whole table's N(y), read in its own bin."""
    ev = I.events(spark, sf)
    out = E.marginal(ev, ev, "y", I.GRID).withColumn("p", H.probabilities("masses", I.GRID))
    return out.select("id", r(F.element_at("p", I.GRID.bin_index(F.col("y")) + 1), 8).alias("p"))


@query("e2_bin_shares", f"{BASE}, {I.masses_sql('key', 'count(*)')} SELECT key, CAST(bin AS BIGINT) AS bin, round(m / sum(m) OVER (PARTITION BY key), 8) AS p FROM h")
def e2(spark, sf):
    out = E.bin_shares(I.events(spark, sf), "y", I.GRID, ["key"]).withColumn("p", H.probabilities("masses", I.GRID))
    return long(out, ["key"], "p", "p")


@query("e2_cross_fitted", f"{I.CROSS} SELECT key, CAST(fold AS BIGINT) AS fold, CAST(bin AS BIGINT) AS bin, m AS n FROM h")
def e2_cross(spark, sf):
    out = E.cross_fitted(I.events(spark, sf), "y", I.GRID, ["key"], "fold")
    return out.select("key", F.col("fold").cast("long").alias("fold"), F.posexplode("masses").alias("bin", "n")).select("key", "fold", F.col("bin").cast("long").alias("bin"), "n")


def edges_sql(n: int, shift: float = 0.0, low: float = LOW, high: float = HIGH) -> str:
    """``ce(k, lo, hi)``: equal-mass coarse edges with the ends replaced."""
    levels = [min(max(i / n + shift / n, 0.0), 1.0) for i in range(n + 1)]
    top = high + 1e-6 * (high - low)
    return f"""cq AS (SELECT quantile_cont(y, {levels}) AS q FROM ev),
cr AS (SELECT i, CASE WHEN i = 0 THEN {low} WHEN i = {n} THEN {top} ELSE q[i + 1] END AS e FROM cq, range({n + 1}) t(i)),
ce AS (SELECT * FROM (SELECT i AS k, max(e) OVER (ORDER BY i) AS lo, lead(e) OVER (ORDER BY i) AS hi FROM cr) WHERE hi IS NOT NULL)"""


def layout_sql(n: int, m: int, shift: float = 0.0, low: float = LOW, high: float = HIGH) -> str:
    """``fe(k, f, lo, hi)``: equal-mass fine edges inside each coarse bin."""
    levels = [min(max(i / m + shift / m, 0.0), 1.0) for i in range(m + 1)]
    return f"""{edges_sql(n, shift, low, high)},
cl AS (SELECT ev.*, k FROM ev JOIN ce ON y >= lo AND y < hi),
fq AS (SELECT k, quantile_cont(y, {levels}) AS q FROM cl GROUP BY k),
fr AS (SELECT k, i, CASE WHEN i = 0 THEN lo WHEN i = {m} THEN hi ELSE least(greatest(q[i + 1], lo), hi) END AS e FROM fq JOIN ce USING (k), range({m + 1}) t(i)),
fe AS (SELECT * FROM (SELECT k, i AS f, e AS lo, lead(e) OVER (PARTITION BY k ORDER BY i) AS hi FROM fr) WHERE hi IS NOT NULL)"""


@query("e5_equal_mass_edges", f"{BASE}, {edges_sql(8, 0.5)} SELECT k, round(lo, 6) AS lo, round(hi, 6) AS hi, count(*) AS n FROM ce JOIN ev ON y >= lo AND y < hi GROUP BY ALL")
def e5(spark, sf):
    """Eight bins shifted by half a bin in quantile space, with their row counts."""
    ev = I.events(spark, sf)
    bins = E.equal_mass_edges(ev, "y", 8, LOW, HIGH + 1e-6 * (HIGH - LOW), 0.5)
    counts = ev.groupBy(bins.locate(F.col("y")).alias("bin")).agg(F.count("*").alias("n"))
    return bins.table(spark).join(counts, "bin").select(F.col("bin").cast("long").alias("k"), r("lo").alias("lo"), r("hi").alias("hi"), "n")


@query("e7_bin_labels", f"{BASE}, {layout_sql(5, 4)} SELECT cl.id, k AS coarse, max(f) AS fine FROM cl JOIN fe USING (k) WHERE fe.lo <= cl.y GROUP BY ALL")
def e7(spark, sf):
    """Coarse and fine labels; of zero-width bins at one value the last holds it."""
    ev = I.events(spark, sf)
    layout = E.equal_mass_layout(ev, "y", 5, 4, LOW, HIGH)
    out = E.level_labels(ev, "y", layout)
    return out.select("id", F.col("coarse").cast("long").alias("coarse"), F.col("fine").cast("long").alias("fine"))


HIER = "{layout}, lb AS (SELECT cl.id, cl.key, k, max(f) AS f FROM cl JOIN fe USING (k) WHERE fe.lo <= cl.y GROUP BY ALL), c1 AS (SELECT key, k, count(*)::DOUBLE AS n FROM lb GROUP BY ALL), c0 AS (SELECT key, count(*)::DOUBLE AS n FROM lb GROUP BY ALL), c2 AS (SELECT key, k, f, count(*)::DOUBLE AS n FROM lb GROUP BY ALL)"


@query("e3_hierarchy", f"{BASE}, {HIER.format(layout=layout_sql(5, 4))} SELECT c2.key, CAST(k * 4 + f AS BIGINT) AS bin, round(c1.n / c0.n * (c2.n / c1.n), 8) AS p FROM c2 JOIN c1 USING (key, k) JOIN c0 USING (key)")
def e3(spark, sf):
    """P(coarse | type) P(fine | coarse, type) from shares."""
    ev = I.events(spark, sf)
    out = E.hierarchy_shares(ev, "y", E.equal_mass_layout(ev, "y", 5, 4, LOW, HIGH), ["key"])
    return long(out, ["key"], "masses", "p").where("p > 0")


NEWTON_STEPS, MOMENTS = 10, [(i, j) for i in range(4) for j in range(i, 4)]


def newton_sql(t: int) -> str:
    """Step ``t`` of all splits: sums, elimination of one weight after the other, and the weights put back in reverse."""
    line = " + ".join(f"v{i} * x{i}" for i in range(4))
    ridge = lambda i, j: f" + {RIDGE} * count(*)" if i == j > 0 else ""
    out = [f"m{t} AS (SELECT tr.*, {', '.join(f'v{i}' for i in range(4))}, 1 / (1 + exp(-({line}))) AS mu FROM tr JOIN w{t} USING (split))",
           f"a{t}_0 AS (SELECT split, {', '.join(f'sum(mu * (1 - mu) * x{i} * x{j}){ridge(i, j)} AS a{i}{j}' for i, j in MOMENTS)}, "
           f"{', '.join(f'sum((up - mu) * x{i})' + (f' - {RIDGE} * count(*) * any_value(v{i})' if i else '') + f' AS b{i}' for i in range(4))}, {', '.join(f'any_value(v{i}) AS v{i}' for i in range(4))} FROM m{t} GROUP BY split)"]
    for k in range(3):
        rest = [f"a{i}{j} - a{k}{i} * a{k}{j} / a{k}{k} AS a{i}{j}" for i, j in MOMENTS if i > k] + [f"b{i} - a{k}{i} * b{k} / a{k}{k} AS b{i}" for i in range(k + 1, 4)]
        out.append(f"a{t}_{k + 1} AS (SELECT * REPLACE ({', '.join(rest)}) FROM a{t}_{k})")
    back = f"a{t}_3"
    for k in (3, 2, 1, 0):
        known = "".join(f" - a{k}{j} * d{j}" for j in range(k + 1, 4))
        out.append(f"d{t}_{k} AS (SELECT *, (b{k}{known}) / a{k}{k} AS d{k} FROM {back})")
        back = f"d{t}_{k}"
    out.append(f"w{t + 1} AS MATERIALIZED (SELECT split, {', '.join(f'v{i} + d{i} AS v{i}' for i in range(4))} FROM {back})")
    return ",\n".join(out)


LOGISTIC = f"""{I.ORDERS}, ev AS (SELECT id, price AS y, qty, disc, tax FROM f), {layout_sql(3, 2, 0.0, 0.0, 500_000.0)},
lb AS MATERIALIZED (SELECT cl.id, cl.y, k, max(f) AS f FROM cl JOIN fe USING (k) WHERE fe.lo <= cl.y GROUP BY ALL),
sc AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in ('qty', 'disc', 'tax'))} FROM ev),
z AS MATERIALIZED (SELECT id, y, k, f, 1.0::DOUBLE AS x0, (qty - m_qty) / s_qty AS x1, (disc - m_disc) / s_disc AS x2, (tax - m_tax) / s_tax AS x3 FROM lb JOIN ev USING (id, y) CROSS JOIN sc),
tr AS MATERIALIZED (SELECT 0 AS split, CAST(k > 0 AS INT) AS up, z.* FROM z UNION ALL SELECT 1, CAST(k > 1 AS INT), z.* FROM z WHERE k >= 1 UNION ALL SELECT 2 + k, CAST(f > 0 AS INT), z.* FROM z),
w0 AS (SELECT split, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS v2, 0.0::DOUBLE AS v3 FROM range(5) t(split)),
{", ".join(newton_sql(t) for t in range(NEWTON_STEPS))},
u AS (SELECT id, y, split, 1 / (1 + exp(-(v0 * x0 + v1 * x1 + v2 * x2 + v3 * x3))) AS u FROM z CROSS JOIN w{NEWTON_STEPS}),
c AS (SELECT id, any_value(y) AS y, {', '.join(f'max(u) FILTER (split = {i}) AS u{i}' for i in range(5))} FROM u GROUP BY id),
pc AS (SELECT id, y, unnest([1 - u0, u0 * (1 - u1), u0 * u1]) AS pk, unnest([u2, u3, u4]) AS uf, unnest([0, 1, 2]) AS k FROM c),
pb AS (SELECT id, y, k, unnest([pk * (1 - uf), pk * uf]) AS p, unnest([0, 1]) AS f FROM pc)"""


@query("e3_classifier_hierarchy", f"""{LOGISTIC} SELECT pb.id, pb.y, round(sum(p * CASE WHEN hi > lo THEN least(greatest((pb.y - lo) / (hi - lo), 0), 1) ELSE CAST(pb.y >= lo AS INT) END), 6) AS pit
FROM pb JOIN fe ON fe.k = pb.k AND fe.f = pb.f GROUP BY ALL""")
def e3_classifier(spark, sf):
    """The same with logistic regressions on line aggregates, all levels in one fit."""
    df = I.order_features(spark, sf).select("id", F.col("price").alias("y"), "qty", "disc", "tax")
    layout = E.equal_mass_layout(df, "y", 3, 2, 0.0, 500_000.0)
    out = LogisticHierarchy.fit(df, ["qty", "disc", "tax"], "y", layout).predict(df)
    return out.select("id", "y", r(H.cdf_at("masses", layout.bins, F.col("y"))).alias("pit"))


@query("e8_dithers", f"""{BASE}, {HIER.format(layout=layout_sql(4, 3)).replace('cq AS', 'cq AS')},
a AS (SELECT key, fe.lo, fe.hi, c1.n / c0.n * (c2.n / c1.n) AS p FROM c2 JOIN c1 USING (key, k) JOIN c0 USING (key) JOIN fe USING (k, f)),
{HIER.format(layout=layout_sql(4, 3, 0.5)).replace('cq', 'dq').replace('cr', 'dr').replace('ce', 'de').replace('cl.', 'dl.').replace('cl ', 'dl ').replace('fq', 'gq').replace('fr ', 'gr ').replace('fr,', 'gr,').replace('FROM fr', 'FROM gr').replace('fe', 'ge').replace('lb', 'mb').replace('c1', 'd1').replace('c0', 'd0').replace('c2', 'd2')},
b AS (SELECT key, ge.lo, ge.hi, d1.n / d0.n * (d2.n / d1.n) AS p FROM d2 JOIN d1 USING (key, k) JOIN d0 USING (key) JOIN ge USING (k, f)),
m AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT ev.id, round(sum(0.5 * p * CASE WHEN hi > lo THEN least(greatest((y - lo) / (hi - lo), 0), 1) ELSE CAST(y >= lo AS INT) END), 8) AS pit FROM ev JOIN m USING (key) GROUP BY ev.id""")
def e8(spark, sf):
    """Two edge shifts mixed equally; each event's PIT under the mixture."""
    ev = I.events(spark, sf)
    mix = E.dithered(ev, ev.select("id", "key"), "y", ["key"], 2, 4, 3, LOW, HIGH)
    rows = mix.df.join(ev.select("id", "y"), "id")
    from tessella.operators.mixtures import Mixture
    return Mixture(rows, mix.parts).cdf(F.col("y"), "pit").select("id", r("pit", 8).alias("pit"))


LABELS = Bins(tuple(np.arange(-0.5, 10.0, 1.0)))


@query("e9_neighbour_histogram", f"{KNN}, l AS (SELECT unnest(range(10)) AS b) SELECT id, b AS bin, round((0.001 + count(*) FILTER (y = b)) / 8.01, 8) AS p FROM n CROSS JOIN l GROUP BY id, b")
def e9(spark, sf):
    out = E.neighbour_histogram(neighbours(spark, sf), LABELS).withColumn("p", H.probabilities("masses", LABELS))
    return long(out, ["id"], "p", "p")


@query("e9_neighbour_quantiles", f"{KNN} SELECT id, round(avg(y), 7) AS median, round(avg(y) + (stddev_pop(y) + 0.001) * 1.2815515655446004, 5) AS p90 FROM n GROUP BY id")
def e9_quantiles(spark, sf):
    out = E.neighbour_quantiles(neighbours(spark, sf), [0.5, 0.9])
    return out.select("id", r(F.col("locs")[0], 7).alias("median"), r(F.col("locs")[1], 5).alias("p90"))


@query("e10_constant_target", "SELECT event_id AS id, 3.5::DOUBLE AS q, 1.0::DOUBLE AS pit FROM events")
def e10(spark, sf):
    """A constant target needs no model: every row is a point mass."""
    ev = I.events(spark, sf).select("id", "key", F.lit(3.5).alias("y"))
    model = E.DensityModel(["key"]).fit(ev)
    out = model.transform(model.transform(ev, "quantiles", levels=[0.5]), "pit")
    return out.select("id", r(F.col("quantiles")[0]).alias("q"), r("pit").alias("pit"))


@query("e11_batch_predictor", f"{BASE} SELECT id, round(50 + least(y, 200) / 4, 6) AS median FROM ev")
def e11(spark, sf):
    """An external quantile predictor, one Arrow batch at a time; row count and width are checked."""
    def predict(batch):
        center = 50.0 + np.minimum(batch["y"].to_numpy(), 200.0)[:, None] / 4.0
        return center + np.array([-10.0, 0.0, 10.0])[None, :]

    out = E.apply_predictor(I.events(spark, sf), ["y"], predict, 3, name="locs")
    return out.select("id", r(F.col("locs")[1]).alias("median"))


@query("e12_grid_layout", f"{BASE}, x AS (SELECT {I.bin_sql('y', 0.0, 500.0, 25)} AS b FROM ev) SELECT CASE WHEN b < 9 THEN 0 WHEN b < 17 THEN 1 ELSE 2 END AS coarse, CASE WHEN b < 9 THEN b WHEN b < 17 THEN b - 9 ELSE b - 17 END AS fine, count(*) AS n FROM x GROUP BY ALL")
def e12(spark, sf):
    """A grid of 25 bins is taken as it is, in runs of 9, 8 and 8."""
    ev = I.events(spark, sf)
    layout = E.choose_layout(ev, "y", n_coarse="grid", n_fine="grid", grid=Bins(tuple(np.linspace(0, 500, 26))), low=LOW, high=HIGH)
    return E.level_labels(ev, "y", layout).groupBy("coarse", "fine").agg(F.count("*").alias("n"))


@query("e12_auto_layout", f"{BASE}, {edges_sql(10)} SELECT k, count(*) AS n FROM ev JOIN ce ON y >= lo AND y < hi GROUP BY k")
def e12_auto(spark, sf):
    """Five hundred rows or more give ten coarse bins."""
    ev = I.events(spark, sf)
    layout = E.choose_layout(ev, "y", low=LOW, high=HIGH)
    out = ev.groupBy(layout.coarse.locate(F.col("y")).alias("k")).agg(F.count("*").alias("n"))
    return out.select(F.col("k").cast("long").alias("k"), "n")


@query("e12_explicit_layout", f"{BASE}, {layout_sql(6, 3)}, lb AS (SELECT cl.id, k, max(f) AS f FROM cl JOIN fe USING (k) WHERE fe.lo <= cl.y GROUP BY ALL) SELECT k AS coarse, f AS fine, count(*) AS n, (SELECT count(*) < 1000000 FROM ev) AS refused FROM lb GROUP BY ALL")
def e12_explicit(spark, sf):
    """Six coarse and three fine bins as asked for; more bins than context rows are refused."""
    ev = I.events(spark, sf)
    layout = E.choose_layout(ev, "y", n_coarse=6, n_fine=3, low=LOW, high=HIGH)
    try:
        E.choose_layout(ev, "y", n_coarse=1000, n_fine=1000, low=LOW, high=HIGH)
        refused = False
    except ValueError:
        refused = True
    out = E.level_labels(ev, "y", layout).groupBy("coarse", "fine").agg(F.count("*").alias("n"))
    return out.select(F.col("coarse").cast("long").alias("coarse"), F.col("fine").cast("long").alias("fine"), "n", F.lit(refused).alias("refused"))


@query("e13_bagged_levels", f"""{BASE}, {layout_sql(5, 4)}, lb AS (SELECT cl.id, k, max(f) AS f FROM cl JOIN fe USING (k) WHERE fe.lo <= cl.y GROUP BY ALL),
mk AS (SELECT id, unnest(range(3)) AS member FROM ev), mu AS (SELECT *, member || '/' || id AS mkey FROM mk), mr AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY {uniform_sql('5', 'mkey')}, mkey) AS rn FROM mu),
bag AS (SELECT member, id FROM mr WHERE rn <= 40), mc AS (SELECT member, k, f, count(*)::DOUBLE AS c FROM bag JOIN lb USING (id) GROUP BY ALL), ms AS (SELECT member, k, sum(c) AS n FROM mc GROUP BY ALL), ma AS (SELECT k, count(*) AS a FROM ms GROUP BY k),
w AS (SELECT k, f, count(*)::DOUBLE AS c FROM lb GROUP BY ALL)
SELECT k AS coarse, f AS fine, round(sum(c / n / a), 8) AS p FROM mc JOIN ms USING (member, k) JOIN ma USING (k) GROUP BY ALL
UNION ALL SELECT k, f, round(c / sum(c) OVER (PARTITION BY k), 8) FROM w WHERE k NOT IN (SELECT k FROM ma)""")
def e13(spark, sf):
    """Three bags of forty rows: a member without rows in a coarse bin sits out."""
    ev = I.events(spark, sf)
    labelled = E.level_labels(ev, "y", E.equal_mass_layout(ev, "y", 5, 4, LOW, HIGH))
    bags = SE.draw_bags(ev, "id", 3, 40, 5)
    out = E.bagged_levels(labelled, bags, "id", 4)
    return out.select(F.col("coarse").cast("long").alias("coarse"), F.col("fine").cast("long").alias("fine"), r("p", 8).alias("p"))
