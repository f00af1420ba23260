"""Queries of the joins, groupings, ranks and windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F


from tessella.functions import ragged as RG
from tessella.functions.grids import Bins
from tessella.operators import mixtures as MX, ranks as RK, recipes as RC, selection as SE
from tessella.operators.neighbours import nearest
from tessella.plans import inputs as I
from tessella.plans.inputs import rounded as r
from tessella.plans.registry import query
from tessella.plans.scoring import SECOND, two_models


@query("j3_interval_overlap", f"""WITH {I.EV}, {I.grid_sql('o', 20.0, 420.0, 25)}, q AS (SELECT usr, quantile_cont(y, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS b FROM ev GROUP BY usr),
s AS (SELECT usr, b[i] AS lo, b[i+1] AS hi, 0.2::DOUBLE AS p FROM q, range(1, 6) t(i))
SELECT usr, CAST(o.bin AS BIGINT) AS bin, round(sum(p * greatest(least(s.hi, o.hi) - greatest(s.lo, o.lo), 0) / (s.hi - s.lo)), 7) AS mass FROM s JOIN o ON s.lo < o.hi AND s.hi > o.lo WHERE s.hi > s.lo GROUP BY ALL HAVING mass > 0""")
def j3(spark, sf):
    """Rows with their own edges (equal-mass buckets per user) re-binned by an equi-join on touched bins."""
    from tessella.functions.grids import Grid

    own = RK.exact_quantiles(I.events(spark, sf), "y", np.linspace(0, 1, 6).tolist(), ["usr"]).select("usr", F.col("q").alias("bins"))
    own = own.withColumn("masses", F.array(*[F.lit(0.2)] * 5))
    grid = Grid(tuple(np.linspace(20.0, 420.0, 26)), "histogram")
    out = MX.regrid_rows(own, "usr", "bins", "masses", grid)
    return out.select("usr", F.col("bin").cast("long").alias("bin"), r("mass", 7).alias("mass")).where("mass > 0")


OWN = f"""WITH {I.EV}, q AS (SELECT usr, quantile_cont(y, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS b FROM ev GROUP BY usr),
s AS (SELECT usr, i, b[i] AS lo, b[i + 1] AS hi, i / 15.0::DOUBLE AS p, (i - 1) * i / 30.0::DOUBLE AS f0, i * (i + 1) / 30.0::DOUBLE AS f1 FROM q, range(1, 6) t(i))"""


def own_edges(spark, sf):
    """Every event with its user's histogram on the user's own edges: masses 1 to 5 between the quintiles."""
    own = RK.exact_quantiles(I.events(spark, sf), "y", np.linspace(0, 1, 6).tolist(), ["usr"]).select("usr", F.col("q").alias("bins"))
    return own.withColumn("masses", F.lit(np.arange(1.0, 6.0)))


@query("h5_own_edges_pit", f"{OWN} SELECT ev.id, round(sum(p * CASE WHEN hi > lo THEN least(greatest((y - lo) / (hi - lo), 0), 1) ELSE CAST(y >= lo AS INT) END), 8) AS pit FROM ev JOIN s USING (usr) GROUP BY ev.id")
def h5_own(spark, sf):
    """The PIT under rows with edges of their own, zero-width buckets included."""
    df = I.events(spark, sf).join(own_edges(spark, sf), "usr")
    return df.select("id", r(RG.cdf_at("bins", "masses", F.col("y")), 8).alias("pit"))


@query("h6_own_edges_quantiles", f"""{OWN} SELECT usr, round(max(CASE WHEN f0 < 0.1 AND f1 >= 0.1 THEN lo + (hi - lo) * (0.1 - f0) / p END), 6) AS q10,
  round(max(CASE WHEN f0 < 0.5 AND f1 >= 0.5 THEN lo + (hi - lo) * (0.5 - f0) / p END), 6) AS q50, round(max(CASE WHEN i = 5 THEN hi END), 6) AS q100 FROM s GROUP BY usr""")
def h6_own(spark, sf):
    out = own_edges(spark, sf).select("usr", RG.ppf("bins", "masses", [0.1, 0.5, 1.0]).alias("q"))
    return out.select("usr", *[r(F.col("q")[i]).alias(n) for i, n in enumerate(("q10", "q50", "q100"))])


@query("c4_own_edges_crps", f"""{OWN}, x AS (SELECT ev.id, lo, hi, f0, f1, least(greatest(y, lo), hi) AS c, CASE WHEN hi > lo THEN f0 + p * (least(greatest(y, lo), hi) - lo) / (hi - lo) ELSE f0 END AS fc FROM ev JOIN s USING (usr))
SELECT id, round(sum((c - lo) * (f0*f0 + f0*fc + fc*fc) / 3 + (hi - c) * ((fc-1)*(fc-1) + (fc-1)*(f1-1) + (f1-1)*(f1-1)) / 3), 6) AS crps FROM x GROUP BY id""")
def c4_own(spark, sf):
    df = I.events(spark, sf).join(own_edges(spark, sf), "usr")
    return df.select("id", r(RG.crps("bins", "masses", F.col("y"))).alias("crps"))


@query("h10_own_edges_regrid", f"""{OWN}, {I.grid_sql('o', 20.0, 420.0, 25)}
SELECT usr, CAST(o.bin AS BIGINT) AS bin, round(sum(p * greatest(least(s.hi, o.hi) - greatest(s.lo, o.lo), 0) / (s.hi - s.lo)), 7) AS mass FROM s JOIN o ON s.lo < o.hi AND s.hi > o.lo WHERE s.hi > s.lo GROUP BY ALL HAVING mass > 0""")
def h10_own(spark, sf):
    """Re-binned row by row: nothing is exploded before the result."""
    out = own_edges(spark, sf).select("usr", RG.regrid("bins", "masses", np.linspace(20.0, 420.0, 26)).alias("m"))
    rows = out.select("usr", F.posexplode("m").alias("bin", "mass"))
    return rows.select("usr", F.col("bin").cast("long").alias("bin"), r("mass", 7).alias("mass")).where("mass > 0")


EDGES = (0.0, 1.0, 2.5, 7.0, 7.5, 20.0, 33.0, 80.0, 500.0)


@query("j4_bracket_lookup", f"WITH {I.EV}, e AS (SELECT unnest({list(EDGES)})::DOUBLE AS e) SELECT id, any_value(max_e) AS edge, CAST(any_value(n) - 1 AS BIGINT) AS bracket FROM (SELECT id, max(e) AS max_e, count(*) AS n FROM ev JOIN e ON e <= y GROUP BY id) GROUP BY id")
def j4(spark, sf):
    """As-of lookup of a value in a shared ordered list, as an array expression."""
    bins = Bins(EDGES)
    k = bins.count_le(F.col("y"))
    return I.events(spark, sf).select("id", F.element_at(F.lit(np.array(EDGES)), k).alias("edge"), (k - 1).cast("long").alias("bracket"))


@query("j4_bracket_table", f"""WITH {I.EV}, k AS (SELECT o_totalprice / 1000 AS q, min(o_orderkey) AS id FROM orders GROUP BY 1)
SELECT ev.id, round(a.q, 6) AS below, a.id AS below_id, round(b.q, 6) AS above, b.id AS above_id FROM ev ASOF LEFT JOIN k a ON ev.y >= a.q ASOF LEFT JOIN k b ON ev.y <= b.q""")
def j4_table(spark, sf):
    """Each event between the order prices next to it: an as-of join with a table, both ways."""
    ev = I.events(spark, sf).select("id", "y")
    prices = I.table(spark, sf, "orders").groupBy((F.col("o_totalprice") / 1000).alias("q")).agg(F.min("o_orderkey").alias("id"))
    out = ev.join(RK.bracket(ev, "y", prices), "y")
    return out.select("id", r("below.q").alias("below"), F.col("below.id").alias("below_id"), r("above.q").alias("above"), F.col("above.id").alias("above_id"))


KNN = """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label AS y FROM embeddings),
d AS (SELECT a.id, b.id AS nid, b.y, list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM e a CROSS JOIN e b),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS rn FROM d QUALIFY rn <= 8)"""


def neighbours(spark, sf, k: int = 8):
    e = I.table(spark, sf, "embeddings")
    return nearest(e, e, k, id_col="vec_id", vector_col="embedding", context_id="vec_id", value="label").withColumnRenamed("vec_id", "id")


@query("j5_nearest_neighbours", f"{KNN} SELECT id, CAST(rn AS BIGINT) AS rank, nid AS neighbour, round(d, 6) AS distance FROM n")
def j5(spark, sf):
    out = neighbours(spark, sf).select("id", F.posexplode("neighbours").alias("rank", "t"))
    return out.select("id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("t.id").alias("neighbour"), r("t.d").alias("distance"))


@query("j6_anti_join", "SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j6(spark, sf):
    orders = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return orders.join(I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")), "id", "left_anti")


@query("j7_overlap", f"WITH {I.EV} SELECT count(*) AS n FROM (SELECT usr FROM ev WHERE key = 'click' INTERSECT SELECT usr FROM ev WHERE y > 200)")
def j7(spark, sf):
    ev = I.events(spark, sf)
    shared = SE.overlap(ev.where("key = 'click'").select("usr"), ev.where("y > 200").select("usr"), "usr")
    return ev.agg(F.lit(shared).cast("long").alias("n"))


@query("j8_edge_union", f"WITH {I.EV}, e AS (SELECT DISTINCT usr, round(unnest(quantile_cont(y, [0.1, 0.5, 0.9])), 6) AS e FROM ev GROUP BY usr, key) SELECT usr, count(*) AS n_edges, round(min(e), 6) AS lo, round(max(e), 6) AS hi FROM e GROUP BY usr")
def j8(spark, sf):
    """The union of a user's per-type edges, as a distinct."""
    parts = RK.exact_quantiles(I.events(spark, sf), "y", [0.1, 0.5, 0.9], ["usr", "key"])
    edges = parts.select("usr", F.explode("q").alias("e")).select("usr", F.round("e", 6).alias("e")).distinct()
    return edges.groupBy("usr").agg(F.count("*").alias("n_edges"), F.min("e").alias("lo"), F.max("e").alias("hi"))


@query("a1_group_percentile", "SELECT l_suppkey AS sup, l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY ALL")
def a1(spark, sf):
    out = RK.exact_quantiles(I.table(spark, sf, "lineitem"), "l_extendedprice", [0.9], ["l_suppkey", "l_returnflag"])
    return out.select(F.col("l_suppkey").alias("sup"), F.col("l_returnflag").alias("flag"), r(F.col("q")[0], 4).alias("p90"))


@query("a1_percentile_by_intervals", "SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY ALL")
def a1_large(spark, sf):
    """The large-table path on the same data: cut points, counts, then only the intervals that matter."""
    out = RK.exact_quantiles(I.table(spark, sf, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.99], ["l_returnflag"])
    return out.select(F.col("l_returnflag").alias("flag"), *[r(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p99"))])


@query("a1_null_groups", "SELECT CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS flag, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey END AS sup, count(*) AS n, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY ALL")
def a1_nulls(spark, sf):
    """Rows without a flag, or without a supplier, are groups too: a large one among many small ones."""
    li = I.table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey")).alias("sup"), "l_extendedprice")
    out = RK.exact_quantiles(li, "l_extendedprice", [0.9], ["flag", "sup"])
    return out.select("flag", "sup", "n", r(F.col("q")[0], 4).alias("p90"))


def subsets(spark, sf):
    return I.order_features(spark, sf).withColumn("split", F.when(F.col("status") == "F", "biased").when(F.col("status") == "O", "test"))


@query("a2_describe_subsets", f"""{I.ORDERS}, s AS (SELECT CASE status WHEN 'F' THEN 'biased' WHEN 'O' THEN 'test' ELSE 'unused' END AS set, qty, price FROM f UNION ALL SELECT 'catalog', qty, price FROM f)
SELECT set, count(*) AS n, round(median(qty), 6) AS median_magnitude, round(median(price), 4) AS median_y, max(price) AS max_y, avg(CAST(qty > 30 AS INT)) AS faint_fraction FROM s GROUP BY set""")
def a2(spark, sf):
    out = SE.describe_subsets(subsets(spark, sf), "split", "qty", "price", 30.0)
    return out.select("set", "n", r("median_magnitude").alias("median_magnitude"), r("median_y", 4).alias("median_y"), "max_y", "faint_fraction")


MAG, TGT = (0.0, 10.0, 20.0, 25.0, 30.0, 51.0), (0.0, 1e5, 2e5, 3e5, 5e5)


def kept_sql(rows: str) -> str:
    cells = [("i", "qty", MAG), ("z", "price", TGT)]
    return " UNION ALL ".join(
        f"SELECT '{label} in [{a}, {b})' AS bin, count(*) AS n_all, count(*) FILTER (keep) AS n_selected, count(*) FILTER (keep) / greatest(count(*), 1)::DOUBLE AS fraction FROM {rows} WHERE {col} >= {a} AND {col} < {b}"
        for label, col, edges in cells for a, b in zip(edges[:-1], edges[1:]))


@query("a3_kept_fraction", f"{I.ORDERS}, x AS (SELECT qty, price, status = 'F' AS keep FROM f) {kept_sql('x')}")
def a3(spark, sf):
    df = I.order_features(spark, sf).withColumn("keep", F.col("status") == "F")
    return SE.selection_summary(df, "qty", "price", "keep", MAG, TGT)


@query("a4_value_shares", "SELECT l_quantity AS value, count(*) AS n, count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS share FROM lineitem GROUP BY 1")
def a4(spark, sf):
    li = I.table(spark, sf, "lineitem")
    counts = li.groupBy(F.col("l_quantity").alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / li.agg(F.count("*")).scalar())


@query("a5_median_by_type", f"WITH {I.EV} SELECT key, round(quantile_cont(y, 0.25), 6) AS p25, round(median(y), 6) AS p50, round(quantile_cont(y, 0.75), 6) AS p75 FROM ev GROUP BY key")
def a5(spark, sf):
    out = RK.exact_quantiles(I.events(spark, sf), "y", [0.25, 0.5, 0.75], ["key"])
    return out.select("key", *[r(F.col("q")[i]).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])


TABLE = f"{SECOND}, tb AS (SELECT key, 'type' AS model, avg(crps) AS crps FROM s GROUP BY key UNION ALL SELECT s.key, 'user', avg(crps2) FROM s JOIN s2 USING (id) GROUP BY s.key)"


def model_table(spark, sf):
    both = two_models(spark, sf).join(I.events(spark, sf).select("id", "key"), "id")
    means = both.groupBy("key").agg(F.avg("crps_type").alias("type"), F.avg("crps_user").alias("user"))
    return means.unpivot("key", ["type", "user"], "model", "crps")


@query("a6_relative_to_best", f"{TABLE} SELECT key, model, round(crps / min(crps) OVER (PARTITION BY key), 7) AS relative FROM tb")
def a6(spark, sf):
    return RC.relative_to_best(model_table(spark, sf), "key", "crps").select("key", "model", r("relative", 7).alias("relative"))


@query("a6_pivot_by_model", f"{TABLE} SELECT key, round(max(crps) FILTER (model = 'type'), 6) AS type, round(max(crps) FILTER (model = 'user'), 6) AS \"user\" FROM tb GROUP BY key")
def a6_pivot(spark, sf):
    out = RC.pivot_models(model_table(spark, sf), "key", "model", "crps", ["type", "user"])
    return out.select("key", r("type").alias("type"), r("user").alias("user"))


RANK_SQL = "SELECT price, before, c, n FROM (SELECT o_totalprice AS price, count(*) AS c, sum(count(*)) OVER (ORDER BY o_totalprice) - count(*) AS before, sum(count(*)) OVER () AS n FROM orders GROUP BY 1)"


@query("t1_global_ranks", RANK_SQL.replace("before, c, n", "CAST(before AS BIGINT) AS before, c, CAST(n AS BIGINT) AS n"))
def t1(spark, sf):
    """Ranks of a whole column, by intervals."""
    return RK.running_counts(I.table(spark, sf, "orders").select(F.col("o_totalprice").alias("price")), "price")


@query("t1_ranks_by_group", """SELECT flag, value, CAST(before AS BIGINT) AS before, c, CAST(n AS BIGINT) AS n FROM (SELECT l_returnflag AS flag, l_quantity AS value, count(*) AS c,
sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - count(*) AS before, sum(count(*)) OVER (PARTITION BY l_returnflag) AS n FROM lineitem GROUP BY 1, 2)""")
def t1_groups(spark, sf):
    li = I.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("value"))
    return RK.running_counts(li, "value", ["flag"])


INFINITE = "CASE WHEN l_linenumber = 1 THEN 'Infinity'::DOUBLE WHEN l_linenumber = 2 THEN '-Infinity'::DOUBLE ELSE l_quantity END"


@query("t1_infinite_values", f"""SELECT flag, value, CAST(before AS BIGINT) AS before, c, CAST(n AS BIGINT) AS n FROM (SELECT l_returnflag AS flag, {INFINITE} AS value, count(*) AS c,
sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY {INFINITE}) - count(*) AS before, sum(count(*)) OVER (PARTITION BY l_returnflag) AS n FROM lineitem GROUP BY 1, 2)""")
def t1_infinite(spark, sf):
    """Infinities of both signs, half of all values, are ordered like other numbers."""
    q = F.when(F.col("l_linenumber") == 1, float("inf")).when(F.col("l_linenumber") == 2, float("-inf")).otherwise(F.col("l_quantity"))
    return RK.running_counts(I.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), q.alias("value")), "value", ["flag"])


@query("t1_hash_ranks", f"SELECT o_orderkey AS id, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {I.uniform_sql('5', 'o_orderkey')}, o_orderkey) AS rank FROM orders")
def t1_hash(spark, sf):
    o = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    return RK.hash_ranks(o, 5, "id", ["priority"])


@query("t2_top_spread", f"{SECOND} SELECT id, round(abs(crps - crps2), 6) AS spread FROM s JOIN s2 USING (id) ORDER BY abs(crps - crps2) DESC, id LIMIT 8")
def t2(spark, sf):
    df = two_models(spark, sf).withColumn("spread", F.abs(F.col("crps_type") - F.col("crps_user")))
    return RC.top_k(df, "spread", 8, "id").select("id", r("spread").alias("spread"))


@query("t3_widest_intervals", f"""{I.UQ}, w AS (SELECT usr, max(v) FILTER (i = 17) - max(v) FILTER (i = 3) AS w FROM qq GROUP BY usr)
SELECT usr, round(w, 6) AS width FROM w WHERE w > (SELECT quantile_cont(w, 0.95) FROM w)""")
def t3(spark, sf):
    df = I.user_quantiles(spark, sf).select("usr", (F.col("locs")[16] - F.col("locs")[2]).alias("width"))
    return RC.hardest(df, "width").select("usr", r("width").alias("width"))


@query("w1_running_sums", f"{I.USER} SELECT usr, CAST(bin AS BIGINT) AS bin, round(sum(m) OVER (PARTITION BY usr ORDER BY bin), 4) AS running, round(max(m) OVER (PARTITION BY usr ORDER BY bin), 4) AS running_max FROM h")
def w1(spark, sf):
    long = I.user_histograms(spark, sf).select("usr", F.posexplode("masses").alias("bin", "m"))
    w = Window.partitionBy("usr").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return long.select("usr", F.col("bin").cast("long").alias("bin"), r(F.sum("m").over(w), 4).alias("running"), r(F.max("m").over(w), 4).alias("running_max"))


@query("w2_first_by_hash", f"SELECT id, priority FROM (SELECT o_orderkey AS id, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {I.uniform_sql('11', 'o_orderkey')}, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE rn <= n // 3")
def w2(spark, sf):
    """A third of every priority, in random order, without sorting a whole priority."""
    o = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    quota = o.groupBy("priority").agg(F.floor(F.count("*") / 3).alias("quota"))
    return RK.first_by_hash(o, 11, "id", quota, ["priority"])


