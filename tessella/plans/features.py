"""Queries of feature building and context-fitted transforms, on per-order line aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import uniform as UN
from tessella.operators import features as FE, selection as SE
from tessella.plans import inputs as I
from tessella.plans.inputs import rounded as r
from tessella.plans.registry import query

BANDS = ("A", "B", "C", "D")
AGG = {"A": "l_quantity", "B": "l_discount", "C": "l_tax", "D": "l_extendedprice"}


def bands(spark: SparkSession, sf: str) -> DataFrame:
    """Means as bands and population deviations as their errors, per order."""
    li = I.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(
        *[F.avg(c).alias(b) for b, c in AGG.items()], *[F.stddev_pop(c).alias(f"{b}ERR") for b, c in AGG.items()])


BANDS_SQL = "WITH b AS (SELECT l_orderkey AS id, " + ", ".join(
    [f"avg({c})::FLOAT AS {b}, stddev_pop({c})::FLOAT AS {b}ERR" for b, c in AGG.items()]) + " FROM lineitem GROUP BY 1)"


def pair_sql(a: str, b: str, digits: int = 2) -> str:
    return (f"round(CAST({a} - {b} AS DOUBLE), {digits}) AS \"{a}-{b}\", "
            f"round(CAST(CAST(sqrt(CAST({a}ERR AS DOUBLE) * {a}ERR + CAST({b}ERR AS DOUBLE) * {b}ERR) AS FLOAT) AS DOUBLE), {digits}) AS \"{a}-{b}ERR\"")


def single_sql(b: str, digits: int = 2) -> str:
    return f"round(CAST({b} AS DOUBLE), {digits}) AS {b}, round(CAST({b}ERR AS DOUBLE), {digits}) AS {b}ERR"


def features(spark, sf, mode: str) -> DataFrame:
    out = FE.build_features(bands(spark, sf), mode, bands=BANDS, reference="A", keep=["id"])
    return out.select("id", *[r(F.col(f"`{c}`").cast("double"), 2).alias(c) for c in out.columns[1:]])


@query("f1_magnitudes", f"{BANDS_SQL} SELECT id, {', '.join(single_sql(b) for b in BANDS)} FROM b")
def f1_mag(spark, sf):
    return features(spark, sf, "mag")


@query("f1_adjacent_differences", f"{BANDS_SQL} SELECT id, {single_sql('A')}, {', '.join(pair_sql(a, b) for a, b in zip(BANDS, BANDS[1:]))} FROM b")
def f1_color(spark, sf):
    return features(spark, sf, "mag-color")


@query("f1_all_differences", f"{BANDS_SQL} SELECT id, {', '.join(single_sql(b) for b in BANDS)}, {', '.join(pair_sql(a, b) for i, a in enumerate(BANDS) for b in BANDS[i + 1:])} FROM b")
def f1_all(spark, sf):
    return features(spark, sf, "all")


def context(spark, sf) -> DataFrame:
    return I.order_features(spark, sf).select("id", "price", "qty", "disc", "tax", "ext")


@query("f3_power")
def f3(spark, sf):
    """The exponent is found by narrowing over likelihood aggregates: iterative, so no SQL twin.
    The tests compare it with a dense scan."""
    df = context(spark, sf)
    return FE.Power.fit(df, ["price", "ext", "disc"]).transform(df).select("id", "price", "ext", "disc")


def map_sql(column: str, levels: list[float], normal: bool) -> str:
    """The empirical quantile map: knots by percentile, ties take the middle."""
    k = len(levels)
    return f"""kn AS (SELECT unnest(quantile_cont({column}, {levels})) AS v, unnest(range({k})) AS i FROM f),
seg AS (SELECT * FROM (SELECT i, v AS a, lead(v) OVER (ORDER BY i) AS b FROM kn) WHERE b IS NOT NULL),
lo AS (SELECT id, any_value({column}) AS x, sum(CASE WHEN b <= {column} THEN 1 WHEN a < {column} THEN ({column} - a) / (b - a) ELSE 0 END) / {k - 1} AS hi,
  sum(CASE WHEN b < {column} THEN 1 WHEN a < {column} THEN least(({column} - a) / (b - a), 1) ELSE 0 END) / {k - 1} AS lo FROM f CROSS JOIN seg GROUP BY id)"""


KNOTS = [i / 20 for i in range(21)]


def small_map(df: DataFrame, normal: bool) -> FE.QuantileMap:
    """A map with 21 knots, fitted on all rows."""
    found = FE.column_quantiles(df, ["price"], KNOTS)
    return FE.QuantileMap(found, tuple(KNOTS), normal)


@query("f4_quantile_uniform", f"{I.ORDERS}, {map_sql('price', KNOTS, False)} SELECT id, round((lo + hi) / 2, 8) AS price FROM lo")
def f4_uniform(spark, sf):
    df = context(spark, sf).select("id", "price")
    return small_map(df, False).transform(df).select("id", r("price", 8).alias("price"))


SPREAD = f"""{I.ORDERS}, s AS (SELECT price AS v, row_number() OVER (ORDER BY price) - 1 AS r, count(*) OVER () AS n FROM f),
c AS (SELECT any_value(n) AS n, any_value(n) // 5 - 1 AS top FROM s), k AS (SELECT i, (n - 1) * i // top AS lo, ((n - 1) * i % top) / top::DOUBLE AS fr, n, top FROM c, range(top + 1) t(i)),
kn AS (SELECT i, a.v + (b.v - a.v) * fr AS q, top FROM k JOIN s a ON a.r = lo JOIN s b ON b.r = least(lo + 1, k.n - 1)),
runs AS (SELECT q, min(i) AS fi, max(i) AS la, any_value(top) AS top FROM kn GROUP BY q), e AS (SELECT min(q) AS q0, max(q) AS q1 FROM runs),
m AS (SELECT id, price, CASE WHEN price <= q0 THEN 0 WHEN price >= q1 THEN 1 WHEN price = p.q THEN (p.fi + p.la) / 2.0 / p.top
  ELSE (p.la + (x.fi - p.la) * (price - p.q) / (x.q - p.q)) / p.top END AS share FROM (SELECT id, price, q0, q1 FROM f CROSS JOIN e) z ASOF JOIN runs p ON z.price >= p.q ASOF JOIN runs x ON z.price <= x.q)"""


@query("f4_quantile_uniform_all", f"{SPREAD} SELECT id, round(share, 8) AS price FROM m")
def f4_spread(spark, sf):
    """A knot for every five rows: the knots are a table, joined by brackets."""
    df = I.order_features(spark, sf).select("id", "price")
    return FE.SpreadMap.fit(df, ["price"]).transform(df).select("id", r("price", 8).alias("price"))


@query("f4_with_original", f"{SPREAD} SELECT id, round(share, 8) AS price, price AS price_original FROM m")
def f4_original(spark, sf):
    """The mapped column with the untransformed one after it."""
    df = I.order_features(spark, sf).select("id", "price")
    both = FE.with_original(df, FE.SpreadMap.fit(df, ["price"]).transform(df), ["price"], "id")
    return both.select("id", r("price", 8).alias("price"), "price_original")


def normal_sql(p: str) -> str:
    """The inverse normal polynomial in SQL."""
    def horner(coefficients, x: str) -> str:
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r})"
        return out

    def tail(q: str) -> str:
        r = f"sqrt(-2.0::DOUBLE * ln({q}))"
        return f"({horner(UN._C, r)} / ({horner(UN._D, r)} * {r} + 1))"

    q = f"({p} - 0.5::DOUBLE)"
    center = f"({horner(UN._A, f'({q} * {q})')} * {q} / ({horner(UN._B, f'({q} * {q})')} * {q} * {q} + 1))"
    return f"CASE WHEN {p} < {UN._LOW!r} THEN {tail(p)} WHEN {p} > 1 - {UN._LOW!r} THEN -{tail(f'(1.0::DOUBLE - {p})')} ELSE {center} END"


def normal_map_sql(column: str) -> str:
    """A column through its own 1,000-knot map to normal output, cut at the bound."""
    levels, bound = np.linspace(0.0, 1.0, 1000).tolist(), FE.NORMAL_BOUND
    return f"""(WITH {map_sql(column, levels, True)}, e AS (SELECT min(v) AS q0, max(v) AS q1 FROM kn), sh AS (SELECT id, least(greatest(CASE WHEN x <= q0 + {bound!r} THEN 0
  WHEN x >= q1 - {bound!r} THEN 1 ELSE (lo + hi) / 2 END, {bound!r}), 1 - {bound!r}) AS p FROM lo, e) SELECT id, round({normal_sql('p')}, 5) AS v FROM sh)"""


@query("f4_quantile_normal", f"{I.ORDERS} SELECT a.id, a.v AS price, b.v AS qty FROM {normal_map_sql('price')} a JOIN {normal_map_sql('qty')} b USING (id)")
def f4_normal(spark, sf):
    """As many knots as rows allow (1,000), normal output."""
    df = context(spark, sf).select("id", "price", "qty")
    return FE.QuantileMap.fit(df, ["price", "qty"]).transform(df).select("id", r("price", 5).alias("price"), r("qty", 5).alias("qty"))


@query("f5_quantile_with_noise")
def f5(spark, sf):
    df = context(spark, sf).select("id", "qty")
    return FE.QuantileMap.fit(df, ["qty"], rule="noisy", seed=3).transform(df)


@query("f6_robust", f"{I.ORDERS}, q AS (SELECT quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS i, quantile_cont(disc, 0.5) AS dm, quantile_cont(disc, 0.75) - quantile_cont(disc, 0.25) AS di FROM f) SELECT id, round((price - m) / i, 8) AS price, round((disc - dm) / di, 8) AS disc FROM f, q")
def f6(spark, sf):
    df = context(spark, sf)
    return FE.Robust.fit(df, ["price", "disc"]).transform(df).select("id", r("price", 8).alias("price"), r("disc", 8).alias("disc"))


@query("f7_fit_on_context", f"{I.ORDERS}, q AS (SELECT quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS i FROM f WHERE status = 'F') SELECT id, CASE WHEN id % 10 <> 3 THEN round((price - m) / i, 8) END AS price FROM f, q")
def f7(spark, sf):
    """Fitted on finished orders, applied to all; a missing value stays missing."""
    df = I.order_features(spark, sf)
    fitted = FE.Robust.fit(df.where("status = 'F'"), ["price"])
    holes = df.withColumn("price", F.when(F.col("id") % 10 != 3, F.col("price")))
    return fitted.transform(holes).select("id", r("price", 8).alias("price"))


@query("f8_soft_clip", f"""WITH {I.EV}, a AS (SELECT avg(y) - 2 * greatest(stddev_samp(y), 1e-6) AS lo, avg(y) + 2 * greatest(stddev_samp(y), 1e-6) AS hi FROM ev),
b AS (SELECT avg(y) - 2 * greatest(stddev_samp(y), 1e-6) AS lo, avg(y) + 2 * greatest(stddev_samp(y), 1e-6) AS hi FROM ev WHERE y BETWEEN (SELECT lo FROM a) AND (SELECT hi FROM a)),
c AS (SELECT id, greatest(y, lo - ln(1 + abs(y))) AS x, hi FROM ev, b) SELECT id, round(least(x, hi + ln(1 + abs(x))), 6) AS y FROM c""")
def f8(spark, sf):
    ev = I.events(spark, sf)
    return FE.SoftClip.fit(ev, ["y"], 2.0).transform(ev).select("id", r("y").alias("y"))


@query("f9_informative_columns", f"WITH {I.EV} SELECT id, y FROM ev")
def f9(spark, sf):
    """Constant and all-missing columns are dropped."""
    ev = I.events(spark, sf).select("id", "y", F.lit(3.0).alias("constant"), F.lit(None).cast("double").alias("missing"))
    return ev.select("id", *FE.informative_columns(ev, ["y", "constant", "missing"]))


ORDER = SE.permutations(3, 3, 7)[2]
NAMES = ("price", "qty", "disc")


@query("f10_permuted_columns", f"{I.ORDERS} SELECT id, " + ", ".join(f"{NAMES[i]} AS c{p}" for p, i in enumerate(ORDER)) + " FROM f")
def f10(spark, sf):
    df = SE.permute(context(spark, sf), list(NAMES), ORDER, keep=["id"])
    return df.select("id", *[F.col(c).alias(f"c{p}") for p, c in enumerate(df.columns[1:])])


@query("f11_ordinal_encode", """WITH d AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'))
SELECT c_custkey AS id, CAST(code AS DOUBLE) AS code FROM customer LEFT JOIN d USING (c_mktsegment)""")
def f11(spark, sf):
    """Codes learned on a context that never saw one category, which becomes missing."""
    c = I.table(spark, sf, "customer")
    learned = FE.ordinal_dictionary(c.where("c_acctbal > 0 AND c_mktsegment <> 'BUILDING'"), "c_mktsegment")
    return FE.ordinal_encode(c, "c_mktsegment", learned, "code").select(F.col("c_custkey").alias("id"), "code")


@query("f12_target_scaling", f"{I.ORDERS}, s AS (SELECT avg(price) AS m, stddev_pop(price) AS s FROM f) SELECT id, round((price - m) / s, 8) AS z FROM f, s")
def f12(spark, sf):
    df = context(spark, sf)
    offset, scale = FE.target_scaling(df, "price")
    return df.select("id", r((F.col("price") - offset) / scale, 8).alias("z"))


