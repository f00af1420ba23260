"""URL filter: a rule list, and a tree of path templates for what no rule fits; DataFrame functions only.

The tree grows per host, one path segment a round, from pages that a rule has
labelled. Numbers, hashes and the like are wildcards at once. At a node, a
segment on fewer than ``LEAST_PAGES`` pages is variable: all of these share one
wildcard branch. Any other segment, wildcards included, is a branch. Branches
with enough labels are merged where a test between them finds their shares of
blocked pages alike; a branch with few or no labels stays by itself, whatever
its siblings' labels say. A node goes on to its next segment while it has
labels enough to tell branches apart, however deep that leads.

A template is where that ends. Its purity is the share of blocked pages among
its own labelled pages, each counted once, smoothed by an even prior of
``WEIGHT`` pages; from ``REJECT`` on its pages are rejected. A template
without labels has purity one half, and no single variable segment can lift
its branch to ``REJECT``.

The tree is built from distinct generalised paths with their counts, never
from single pages, so a host with very many pages costs no more than its
distinct shapes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.llm.common import materialize, upper_to_lower

#: Pages from which a segment is a branch, and labelled pages from which a branch can be merged or split.
LEAST_PAGES = 15
LEAST_LABELLED = 15
#: Standard errors from which the shares of two branches differ.
LEAST_Z = 3.0
#: Weight of the even prior, in pages, and the purity from which a template is rejected.
WEIGHT = 10.0
REJECT = 0.8


@dataclass(frozen=True)
class UrlRule:
    """``host`` + ``path`` is the rule's name; it fits the host and all its subdomains if a path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for a null or one without ``://``."""
    pattern = r"://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    return upper_to_lower(F.regexp_extract(known, pattern, 1)), F.regexp_extract(known, pattern, 2)


def fitting(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """The longest rule that fits, as a struct of name and verdict; null if none does. A rule list is small: it goes into the plan."""
    order = sorted(rules, key=lambda r: (-len(r.name), r.name))
    cases = [F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
                    F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in order]
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<rule:string,verdict:string>")


def generalised(path: Column) -> Column:
    """A path's segments: numbers, long hexadecimal and mixed ones as wildcards that keep a file ending; empty ones left out."""
    def one(s: Column) -> Column:
        ending = F.regexp_extract(s, r"(\.[a-z]{1,5})$", 1)
        return (F.when(F.regexp_like(s, F.lit(r"^[0-9]+(\.[a-z]{1,5})?$")), F.concat(F.lit("<n>"), ending))
                .when(F.regexp_like(s, F.lit(r"^[0-9a-fA-F-]{8,}(\.[a-z]{1,5})?$")), F.concat(F.lit("<h>"), ending))
                .when(F.regexp_like(s, F.lit(r"[0-9]{4,}")), F.concat(F.lit("<m>"), ending)).otherwise(s))
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), one)


def _counts() -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")]


def _branches(rows: DataFrame) -> DataFrame:
    """(node, seg, child) for the segments that follow each node in ``rows`` (node, seg, n, labelled, blocked)."""
    name = F.when((F.col("seg") == "") | (F.col("n") >= LEAST_PAGES), F.col("seg")).otherwise(F.lit("<*>"))
    segments = materialize(rows.groupBy("node", "seg").agg(*_counts()).withColumn("name", name))
    pooled = segments.groupBy("node", "name").agg(*_counts()).where((F.col("labelled") >= LEAST_LABELLED) & (F.col("name") != ""))
    # Branches in order of their share, each tested against those before it.
    order = Window.partitionBy("node").orderBy(F.col("blocked") / F.col("labelled"), "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    tested = pooled.withColumns({"l": F.sum("labelled").over(before), "b": F.sum("blocked").over(before)})
    share = (F.col("blocked") + F.col("b")) / (F.col("labelled") + F.col("l"))
    error = F.sqrt(share * (1 - share) * (F.lit(1.0) / F.col("labelled") + F.lit(1.0) / F.col("l")))
    apart = F.col("blocked") / F.col("labelled") - F.col("b") / F.col("l") > LEAST_Z * error
    grouped = tested.withColumn("group", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order))
    several = F.count("*").over(Window.partitionBy("node", "group")) > 1
    merged = grouped.withColumn("several", several).where("several").select("node", "name", F.concat(F.lit("<"), F.col("group"), F.lit(">")).alias("merged"))
    return segments.join(merged, ["node", "name"], "left").select("node", "seg", F.concat_ws("/", "node", F.coalesce("merged", "name")).alias("child"))


def template_tree(pages: DataFrame) -> DataFrame:
    """(host, shape, template, purity) of every shape in ``pages`` (host, shape, blocked: 1, 0 or null)."""
    shapes = pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked"))
    open_, done, level = materialize(shapes.withColumn("node", F.col("host"))), [], 0
    while True:
        labels = open_.groupBy("node").agg(F.sum("labelled").alias("labels")).where(F.col("labels") >= LEAST_LABELLED).select("node")
        done.append(open_.join(labels, "node", "left_anti"))
        segments = F.split("shape", "/")
        here = open_.join(labels, "node", "left_semi").withColumn("seg", F.coalesce(F.try_element_at(segments, F.lit(level + 1)), F.lit("")))
        if here.isEmpty():
            break
        moved = materialize(here.join(_branches(here), ["node", "seg"]).withColumn("node", F.col("child")).drop("child"))
        done.append(moved.where("seg = ''").drop("seg"))
        open_ = moved.where("seg <> ''").drop("seg")
        level += 1
    columns = ["host", "shape", "node", "labelled", "blocked"]
    ended = reduce(lambda a, b: a.unionByName(b), [d.select(*columns) for d in done])
    purity = ended.groupBy("node").agg(((F.sum("blocked") + WEIGHT / 2) / (F.sum("labelled") + WEIGHT)).alias("purity"))
    return ended.select("host", "shape", "node").join(purity, "node").withColumnRenamed("node", "template")


def judge(pages: DataFrame, rules: Sequence[UrlRule] = RULES, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict, template, purity.

    The verdict is the longest fitting rule's; without one, ``block`` if the
    template's purity is ``REJECT`` or more, else ``allow``. A null URL and one
    without ``://`` have empty host and path, and are pages of one host without a name.
    Paths of any length and depth are taken whole. Repeated rows each get a
    row (and count each), an empty table gives none; other columns are not looked at.
    """
    host, path = parts(F.col(f"`{url}`").cast("string"))
    own = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = own.withColumn("r", fitting(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"), F.array_join(generalised(F.col("path")), "/").alias("shape"))
    blocked = F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int"))
    tree = template_tree(ruled.select("host", "shape", blocked.alias("blocked")))
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return ruled.join(tree, ["host", "shape"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))
