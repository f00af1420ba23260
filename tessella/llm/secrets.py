"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Every historical version of a text is a blob named by the SHA-256 of its
content. The ledger holds a row for each blob and rule that has been scanned,
with the spans found. A scan takes the distinct pairs of a blob and a rule
version that the ledger lacks, scans each such blob once, appends the pairs,
and joins the ledger's findings back to all paths that hold the blob.

Spans need the places of matches, which the engine's regular expressions do
not give: the pieces between matches (``split``) and the matches themselves
(``regexp_extract_all``) alternate, so running sums of their lengths do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.common import free_name, materialize

#: The ledger's columns.
LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` is matched leftmost and non-overlapping; matches that fail the test are dropped.

    ``least`` is the least length of the match, or of its group ``group``.
    A new version makes every blob unseen for this rule.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1


# The base rules, in the order of their kinds, and the rules that the ledger adds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", least=8, group=2),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# A private key's body: with its END line, of all that wraps base64; without it, runs of base64 of a line's size and then lines of base64 alone.
# Stars stand on character classes only, so that a body of any length needs no stack; no class of a body holds the dashes of the next key. Written line breaks (\r\n) count as such.
_FIELDS = r"(?:[\x20\t\r\n\\]*[A-Za-z]+-[A-Za-z-]+:\x20?[A-Za-z0-9,=+/-]*){0,9}"
_WITH_END = r"""[A-Za-z0-9+/=\x20\t\r\n\\"',;|>#*]*-----END [A-Z ]{0,40}PRIVATE KEY-----"""
_RUNS = r"""(?:[\x20\t\r\n\\rn"',;|>#*]*[A-Za-z0-9+/=]{24}(?:[A-Za-z0-9+/=\x20\t\r\n\\"',;|>#*]*[A-Za-z0-9+/=]{24})?[A-Za-z0-9+/=]*)?"""
_LINES = r"(?:[\x20\t]*[\r\n\\][A-Za-z0-9+/=\r\n\\]*(?:[\r\n\\]|\z))?"
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----{_FIELDS}(?:{_WITH_END}|{_RUNS}{_LINES})", version=2),
)
RULES = BASE + MORE


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches in code points, end exclusive; failing matches left out."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    sizes = F.arrays_zip(between.alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("size"), F.transform(tested, lambda x: F.length(x)).alias("tested"))
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        fits = x["size"].isNotNull() & (x["tested"] >= rule.least)
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(fits, F.concat(state["found"], own)).otherwise(state["found"]).alias("found"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), F.aggregate(sizes, step, add, lambda s: s["found"])).otherwise(none)


def blobs(docs: DataFrame, text: str = "text") -> Column:
    """The name of a row's content; a null text counts as empty."""
    return F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256)


def unseen(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """(blob, text, rules): each blob that the ledger lacks a rule version for, once, with the kinds to scan.

    One row per blob stays by a partial and a final aggregate, so copies are
    dropped before anything moves and a blob of any number of copies is one row.
    """
    own = docs.select(blobs(docs, text).alias("blob"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    every = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    own = own.dropDuplicates(["blob"])
    if ledger is None:
        return own.withColumn("rules", every)
    seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("seen"))
    fresh = own.join(seen, "blob", "left").withColumn("rules", F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, "seen")))
    return fresh.where(F.size("rules") > 0).select("blob", "text", "rules")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows (blob, rule, version, spans): one for each unseen pair of a blob and a rule version."""
    todo = unseen(docs, ledger, rules, text)
    made = todo.select("blob", F.array(*[
        F.when(F.array_contains("rules", f"{r.kind}:{r.version}"), F.struct(
            F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r in rules]).alias("made"))
    return made.select("blob", F.explode(F.filter("made", lambda m: m.isNotNull())).alias("m")).select("blob", "m.rule", "m.version", "m.spans")


def findings(docs: DataFrame, rows: DataFrame, keep: dict[str, Column], rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Ledger findings joined back to every row of ``docs``: the columns in ``keep`` and ``found``.

    ``found`` is an array of (start, kind number, kind, end) sorted by start,
    then by the rules' order. Only blobs with a finding are joined; a blob
    held by very many rows is split by the join, not gathered.
    """
    number = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    current = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    held = rows.where((F.size("spans") > 0) & (current[F.col("rule")] == F.col("version")))
    one = held.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), number[F.col("rule")].alias("number"), F.col("rule").alias("kind"), s["end"].alias("end")))))).alias("found"))
    # Written first: then both sides of the join are plain shuffles, and Spark can split a blob that very many rows hold.
    one = materialize(one)
    own = docs.select(*[c.alias(n) for n, c in keep.items()], blobs(docs, text).alias("__blob"))
    none = F.array().cast("array<struct<start:int,number:int,kind:string,end:int>>")
    return own.join(one.withColumnRenamed("blob", "__blob"), "__blob", "left").select(*keep, F.coalesce("found", none).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts by base kind, a digest of the base spans, and all spans.

    Null texts count as empty and have no span; repeated rows and null ids get
    their own rows; an empty table gives none.
    """
    rows = scan(docs, ledger, text=text)
    if ledger is not None:
        rows = rows.unionByName(ledger.select("blob", "rule", "version", "spans"))
    found = findings(docs, rows, {"doc_id": F.col(f"`{id_col}`")}, text=text)
    base = F.filter("found", lambda s: s["number"] < len(BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The documents with every span of their text replaced by ``mask``, all columns and rows kept.

    Overlapping spans become one. A null text stays null. Repeated rows all
    stay, extra columns of any name too; an empty table gives none.
    """
    content = blobs(docs, text)
    rows = scan(docs, text=text).where(F.size("spans") > 0)
    blob, marks = free_name(docs, "__blob"), free_name(docs, "__spans")
    one = rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias(marks)).withColumnRenamed("blob", blob)
    one = materialize(one)  # as in findings()
    marked = docs.withColumn(blob, content)
    whole = F.col(f"`{text}`")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        before = F.concat(state["out"], F.substring(whole, state["at"] + 1, s["start"] - state["at"]), F.lit(mask))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, before).otherwise(state["out"]).alias("out"))

    clean = F.aggregate(marks, start, cut, lambda s: F.concat(s["out"], F.substring(whole, s["at"] + 1, F.length(whole))))
    joined = marked.join(one, blob, "left")
    return joined.select(*[F.when(F.col(marks).isNull() | whole.isNull(), whole).otherwise(clean).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
