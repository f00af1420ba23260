"""The driver's tables as inputs of the operators, with the SQL that builds the same ones.

Every distribution here is derived from a whole table: value-weighted
histograms of events per user, cross-fitted densities per event type,
quantiles per user, and quantities per supplier with a real point mass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.functions.grids import Bins, Grid
from tessella.functions.uniform import hash_uniform
from tessella.operators.estimators import cross_fitted, pivot_counts
from tessella.operators.ranks import exact_quantiles

GRID = Grid.linear(0.0, 500.0, 50, normalization="histogram")
TRAPEZOID = Grid.linear(0.0, 500.0, 50, normalization="trapezoid")
COARSE = Bins(tuple(np.linspace(0.0, 500.0, 36)))
# Quantities 1..50 with a point mass at 25.
ATOM_BINS = Bins((0.0, 10.0, 25.0, 25.0, 40.0, 50.0))
LEVELS = tuple(round(0.05 * i, 2) for i in range(1, 20))
PRICE_GRID = Grid.linear(0.0, 500_000.0, 40, normalization="histogram")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, key, usr, y, fold)``: the target is 20 sqrt(value), which spreads the skewed values
    over the grid; the folds serve cross-fitting, so every row is learned from and scored.
    A fold is never NULL, and the plan knows it: no join on it hashes the ids a second time."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("key"), F.col("user_id").alias("usr"),
        (F.sqrt("value") * 20.0).alias("y"), F.coalesce(F.floor(hash_uniform("fold", F.col("event_id")) * 5).cast("int"), F.lit(0)).alias("fold"))


def weighted_histograms(df: DataFrame, bins: Bins, by: list[str], name: str = "masses") -> DataFrame:
    """Masses are sums of the value, so that no two bins tie by accident."""
    sums = df.groupBy(*by, bins.locate(F.col("y")).alias("bin")).agg(F.sum("y").alias("m"))
    return pivot_counts(sums, by, "bin", "m", bins.n, name)


def user_histograms(spark: SparkSession, sf: str, bins: Bins = GRID) -> DataFrame:
    """``(usr, masses)``."""
    return weighted_histograms(events(spark, sf), bins, ["usr"])


def event_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every event with its user's histogram: ``(id, key, usr, y, fold, masses)``."""
    return events(spark, sf).join(user_histograms(spark, sf), "usr")


def cross_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every event with the density of its type learned on the other folds: a row per type and fold, which goes to the events."""
    ev = events(spark, sf).where("key IS NOT NULL")
    return ev.join(F.broadcast(cross_fitted(ev, "y", GRID, ["key"], "fold")), ["key", "fold"])


def user_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """``(usr, n, locs)`` at 0.05 .. 0.95."""
    return exact_quantiles(events(spark, sf), "y", LEVELS, ["usr"]).withColumnRenamed("q", "locs")


def supplier_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """``(sup, masses)`` of quantities per supplier; quantity 25 is a point mass."""
    q = F.col("l_quantity")
    bucket = F.when(q == 25, F.lit(2)).otherwise(ATOM_BINS.locate(q))
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sup"), bucket.alias("bin")).agg(F.count("*").cast("double").alias("c"))
    return pivot_counts(counts, ["sup"], "bin", "c", ATOM_BINS.n)


def supplier_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of whole-number quantities: many ties. ``(sup, n, locs)``."""
    return exact_quantiles(table(spark, sf, "lineitem"), "l_quantity", LEVELS, ["l_suppkey"]).select(
        F.col("l_suppkey").alias("sup"), "n", F.col("q").alias("locs"))


def order_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every order: price as target, and line aggregates as magnitude, color and bands."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum("l_extendedprice").alias("ext"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"),
        F.avg("l_quantity").alias("qty"), F.max("l_quantity").alias("maxq"), F.count("*").alias("lines"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"))
    # An order without lines stays, with zeros.
    return orders.join(lines, "id", "left").fillna(0, ["ext", "disc", "tax", "qty", "maxq", "lines"])


# -- the same inputs in SQL --------------------------------------------------------

def uniform_sql(seed: str, *keys: str) -> str:
    text = " || '-' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


EV = f"""ev AS (SELECT event_id AS id, event_type AS key, user_id AS usr, sqrt(value) * 20.0::DOUBLE AS y,
  CAST(floor({uniform_sql('fold', 'event_id')} * 5) AS INTEGER) AS fold FROM events)"""


def grid_sql(name: str = "g", low: float = 0.0, high: float = 500.0, n: int = 50) -> str:
    w = (high - low) / n
    return f"""{name} AS (SELECT CAST(i AS INTEGER) AS bin, CAST({low} + i * {w!r} AS DOUBLE) AS lo,
  CAST({low} + (i + 1) * {w!r} AS DOUBLE) AS hi, CAST({low} + (i + 0.5) * {w!r} AS DOUBLE) AS c,
  CAST({w!r} AS DOUBLE) AS w FROM range({n}) t(i))"""


def bin_sql(x: str, low: float = 0.0, high: float = 500.0, n: int = 50) -> str:
    return f"CAST(least(greatest(floor(({x} - {low}) / CAST({(high - low) / n!r} AS DOUBLE)), 0), {n - 1}) AS INTEGER)"


def masses_sql(keys: str, weight: str, source: str = "ev", name: str = "h", grid: str = "g", x: str = "y", **bounds) -> str:
    """``name(keys, bin, lo, hi, c, w, m)`` with every bin of every key."""
    return f"""{name}_n AS (SELECT {keys}, {bin_sql(x, **bounds)} AS bin, {weight} AS m FROM {source} GROUP BY ALL),
{name} AS (SELECT k.*, {grid}.bin, lo, hi, c, w, coalesce(m, 0.0) AS m FROM (SELECT DISTINCT {keys} FROM {source}) k
  CROSS JOIN {grid} LEFT JOIN {name}_n USING ({keys}, bin))"""


def probs_sql(keys: str, source: str = "h", name: str = "p") -> str:
    """Adds ``p`` and ``f0``, ``f1``: the CDF at the bin's ends."""
    return f"""{name}_t AS (SELECT *, m / sum(m) OVER (PARTITION BY {keys}) AS p FROM {source}),
{name} AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY {keys} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS f0,
  sum(p) OVER (PARTITION BY {keys} ORDER BY bin) AS f1 FROM {name}_t)"""


USER = f"WITH {EV},\n{grid_sql()},\n{masses_sql('usr', 'sum(y)')},\n{probs_sql('usr')}"

CROSS = f"""WITH {EV},
{grid_sql()},
cf_n AS (SELECT key, fold, {bin_sql('y')} AS bin, count(*) AS n FROM ev GROUP BY ALL),
cf_k AS (SELECT DISTINCT key, fold FROM ev),
cf_a AS (SELECT key, bin, sum(n) AS n FROM cf_n GROUP BY ALL),
h AS (SELECT k.key, k.fold, g.bin, lo, hi, c, w, CAST(coalesce(a.n, 0) - coalesce(o.n, 0) AS DOUBLE) AS m
  FROM cf_k k CROSS JOIN g LEFT JOIN cf_a a ON a.key = k.key AND a.bin = g.bin
  LEFT JOIN cf_n o ON o.key = k.key AND o.fold = k.fold AND o.bin = g.bin),
{probs_sql('key, fold')}"""

# Per event: the four scores on the histogram grid.
CRPS_SQL = """(least(greatest(y, lo), hi) - lo) * (f0*f0 + f0*fc + fc*fc) / 3
  + (hi - least(greatest(y, lo), hi)) * ((fc-1)*(fc-1) + (fc-1)*(f1-1) + (f1-1)*(f1-1)) / 3"""
SCORES = f"""{CROSS},
r AS (SELECT e.id, e.key, e.fold, e.usr, e.y, p.bin, lo, hi, c, w, p.p, f0, f1, f0 + p.p * (least(greatest(e.y, lo), hi) - lo) / w AS fc,
  {bin_sql('e.y')} = p.bin AS own FROM ev e JOIN p USING (key, fold)),
s AS (SELECT id, any_value(key) AS key, any_value(fold) AS fold, any_value(usr) AS usr, any_value(y) AS y, sum(p*p/w) - 2*sum(CASE WHEN own THEN p/w ELSE 0 END) AS cde,
  least(sum(CASE WHEN own THEN fc ELSE 0 END), 1) AS pit, sum({CRPS_SQL}) AS crps,
  -ln(greatest(sum(CASE WHEN own THEN p/w ELSE 0 END), 1e-12)) AS nll, sum(p*c) AS mean_pred FROM r GROUP BY id)"""

ATOMS = """WITH li AS (SELECT l_suppkey AS sup, l_quantity AS q FROM lineitem),
g AS (SELECT * FROM (VALUES (0,0.0::DOUBLE,10.0::DOUBLE),(1,10.0,25.0),(2,25.0,25.0),(3,25.0,40.0),(4,40.0,50.0)) t(bin,lo,hi)),
h_n AS (SELECT sup, CASE WHEN q = 25 THEN 2 WHEN q < 10 THEN 0 WHEN q < 25 THEN 1 WHEN q < 40 THEN 3 ELSE 4 END AS bin, count(*) AS m FROM li GROUP BY ALL),
h AS (SELECT k.sup, g.bin, lo, hi, (lo+hi)/2 AS c, hi-lo AS w, CAST(coalesce(m, 0) AS DOUBLE) AS m FROM (SELECT DISTINCT sup FROM li) k CROSS JOIN g LEFT JOIN h_n USING (sup, bin)),
""" + probs_sql("sup")


def quantile_knots_sql(source: str, key: str, value: str) -> str:
    """``k(key, i, lv, v)``: quantiles at 0.05 .. 0.95 and both tail ends."""
    return f"""qq AS (SELECT {key}, unnest(quantile_cont({value}, {list(LEVELS)})) AS v, unnest(range(1, 20)) AS i FROM {source} GROUP BY {key}),
gaps AS (SELECT *, lead(v) OVER (PARTITION BY {key} ORDER BY i) - v AS gap FROM qq),
tails AS (SELECT {key}, coalesce(arg_min(gap, i) FILTER (gap > 0), 0) AS below, coalesce(arg_max(gap, i) FILTER (gap > 0), 0) AS above,
  arg_min(v, i) AS first, arg_max(v, i) AS last FROM gaps GROUP BY {key}),
k AS (SELECT {key}, i, i * 0.05::DOUBLE AS lv, v FROM qq UNION ALL SELECT {key}, 0, 0.0, first - below FROM tails
  UNION ALL SELECT {key}, 20, 1.0, last + above FROM tails),
seg AS (SELECT * FROM (SELECT {key}, i, lv AS l0, v AS a, lead(lv) OVER w AS l1, lead(v) OVER w AS b FROM k WINDOW w AS (PARTITION BY {key} ORDER BY i)) WHERE b IS NOT NULL)"""


UQ = f"WITH {EV},\n{quantile_knots_sql('ev', 'usr', 'y')}"
SQ = f"WITH li AS (SELECT l_suppkey AS sup, l_quantity AS q FROM lineitem),\n{quantile_knots_sql('li', 'sup', 'q')}"

ORDERS = """WITH o AS (SELECT o_orderkey AS id, o_totalprice AS price, o_orderpriority AS priority, o_orderstatus AS status FROM orders),
l AS (SELECT l_orderkey AS id, sum(l_extendedprice) AS ext, avg(l_discount) AS disc, avg(l_tax) AS tax, avg(l_quantity) AS qty,
  max(l_quantity) AS maxq, count(*) AS lines FROM lineitem GROUP BY 1),
f AS (SELECT id, price, priority, status, coalesce(ext, 0) AS ext, coalesce(disc, 0) AS disc, coalesce(tax, 0) AS tax, coalesce(qty, 0) AS qty,
  coalesce(maxq, 0) AS maxq, coalesce(lines, 0) AS lines FROM o LEFT JOIN l USING (id))"""
