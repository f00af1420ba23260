"""A Merkle manifest of a dataset: one hash per row, a tree per group, a tree over the groups, and proofs for any rows.

A tree pairs neighbours level by level until one node remains; a node without
a neighbour goes up as the hash of itself alone. Leaves are ordered in range
partitions and numbered by counts, so no task sees a whole group. The tree is
built in rounds of aligned subtrees of ``2 ** SPAN`` nodes.

Proofs are octopus multiproofs. The rows to prove are cut into leaf partitions
(stretches of ``2 ** SPAN`` places). A partition computes the coordinates
of the nodes its proofs need and its own leaves do not give: walking up, a
known node whose sibling is neither known nor derived needs that sibling, and
no other node is ever asked for. This least union is fetched once, by one join
with the stored nodes. The partition then derives the interiors its leaves
share and expands every leaf's own proof from them.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessella.llm.common import materialize

#: Levels that one task folds at once.
SPAN = 12
SIDES = "array<struct<left: string, right: string>>"


def field(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    """The hash of a row: sha256, in lowercase hex, of its fields one after the other."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _hash(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return max(0, int(n - 1).bit_length())


def fold(nodes: list[str], levels: int) -> list[list[str]]:
    """The levels above ``nodes``, whose first has an even place at every level folded."""
    made = []
    for _ in range(levels):
        pairs = zip(nodes[::2], [*nodes[1::2], ""] if len(nodes) % 2 else nodes[1::2], strict=True)
        nodes = [_hash(a, b) for a, b in pairs]
        made.append(nodes)
    return made


def places(leaves: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds ``place`` (from 0 in the group) and ``n`` (the group's rows); equal rows may change places."""
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [group, *order]
    # Rows that are equal throughout spread over partitions by where they were read.
    spread = leaves.withColumn("_read", F.monotonically_increasing_id())
    placed = materialize(spread.repartitionByRange(parts, *names, "_read").sortWithinPartitions(*names, "_read").withColumn("_p", F.spark_partition_id()))
    counts = placed.groupBy("_p", group).agg(F.count("*").alias("_c"))
    own = Window.partitionBy(group)
    starts = materialize(counts.select(
        "_p", F.col(group).alias("_g"), (F.sum("_c").over(own.orderBy("_p")) - F.col("_c")).alias("_start"), F.sum("_c").over(own).alias("n")))
    # A row per partition and group: its size follows the partitions and groups, not the rows.
    known = F.broadcast(starts) if starts.count() <= 100_000 else starts
    inside = F.row_number().over(Window.partitionBy("_p", group).orderBy(*order, "_read"))
    joined = placed.withColumn("_i", inside).withColumnRenamed("_p", "_q").join(
        known, (F.col("_q") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("place", F.col("_start") + F.col("_i") - 1).drop("_read", "_p", "_q", "_g", "_i", "_start")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first ``keys`` columns; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(keys)]
        start = 0
        for i, key in enumerate(zip(*columns, strict=True)):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *columns).sortWithinPartitions(*columns, *order)


def nodes(leaves: DataFrame) -> DataFrame:
    """(tree, n, level, place, hash): all nodes of the trees over ``leaves`` (tree long, n long, place long, hash), leaves included."""
    schema = "tree long, n long, level int, place long, hash string"

    def build(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _runs(batches, 2):
                tree, n, stretch = rows["tree"][0].as_py(), rows["n"][0].as_py(), rows["stretch"][0].as_py()
                made = fold(rows["hash"].to_pylist(), min(SPAN, height(n) - level))
                out = [(level + d, (stretch << SPAN) >> d, h) for d, h in enumerate(made, 1)]
                size = sum(len(h) for _, _, h in out)
                if size:
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([tree] * size, pa.int64()), "n": pa.array([n] * size, pa.int64()),
                        "level": pa.array(np.repeat([d for d, _, _ in out], [len(h) for _, _, h in out]), pa.int32()),
                        "place": pa.array(np.concatenate([at + np.arange(len(h)) for _, at, h in out]), pa.int64()),
                        "hash": [x for _, _, h in out for x in h]})
        return run

    base = leaves.select("tree", "n", F.lit(0).alias("level"), "place", "hash")
    done, level, low = base, 0, base
    most = leaves.agg(F.max("n")).first()[0] or 0
    while level < height(most):
        # Trees whose root lies at this level or below are complete.
        open_ = low.where(F.col("n") > (1 << level)).withColumn("stretch", F.shiftright("place", SPAN))
        made = materialize(_dealt(open_.select("tree", "stretch", "n", "place", "hash"), ["tree", "stretch"], ["place"]).mapInArrow(build(level), schema))
        done = done.unionByName(made)
        level += SPAN
        low = made.where(F.col("level") == level)
    return done


def missing(places_: np.ndarray, n: int) -> list[np.ndarray]:
    """The octopus walk: per level, the places whose nodes the proofs of ``places_`` need and cannot derive."""
    known, wanted, size = np.unique(places_), [], n
    while size > 1:
        sibling = known ^ 1
        wanted.append(np.setdiff1d(sibling[sibling < size], known, assume_unique=False))
        known, size = np.unique(known >> 1), (size + 1) // 2
    return wanted


def expand(places_: np.ndarray, hashes: np.ndarray, n: int, fetched: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], str]:
    """(places, hashes) of every level that the leaves and the fetched nodes give, siblings included, and the root."""
    at, first = np.unique(places_, return_index=True)
    held, size, levels = hashes[first], n, []
    for more, given in fetched:
        order = np.argsort(np.concatenate([at, more]), kind="stable")
        at, held = np.concatenate([at, more])[order], np.concatenate([held, given])[order]
        levels.append((at, held))
        # A left node comes with its right one, but for the last of its level.
        left = np.flatnonzero(at % 2 == 0)
        paired = np.append(at[1:], -1)[left] == at[left] + 1
        made = [_hash(held[i], held[i + 1]) if two else _hash(held[i]) for i, two in zip(left.tolist(), paired.tolist(), strict=True)]
        at, held, size = at[left] >> 1, np.array(made, object), (size + 1) // 2
    return levels, held[0]


def _paths(places_: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    """Each leaf's siblings, level by level."""
    rows, depth = len(places_), len(levels)
    left, right = np.empty((rows, depth), object), np.empty((rows, depth), object)
    for d, (at, held) in enumerate(levels):
        own = places_ >> d
        found = np.minimum(np.searchsorted(at, own ^ 1), len(at) - 1)
        other = np.where(at[found] == own ^ 1, held[found], None)
        left[:, d], right[:, d] = np.where(own & 1, other, None), np.where(own & 1, None, other)
    sides = pa.StructArray.from_arrays([pa.array(left.ravel(), pa.string()), pa.array(right.ravel(), pa.string())], names=["left", "right"])
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * depth, pa.int32()), sides)


def proofs(leaves: DataFrame, stored: DataFrame) -> DataFrame:
    """(row, tree, place, hash, root, path) of each row of ``leaves`` (row, tree, n, place, hash).

    ``stored`` are the trees' nodes; ``leaves`` may be any part of their leaves.
    ``path`` has an entry per level: the sibling left or right of the path, or
    neither where a node goes up alone. ``row`` is handed through.
    """
    cut = leaves.withColumn("stretch", F.shiftright("place", SPAN))
    kind = leaves.schema["row"].dataType.simpleString()
    columns = ["tree", "stretch", "n", "kind", "level", "place", "hash", "row"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 2):
            tree, stretch, n = rows["tree"][0].as_py(), rows["stretch"][0].as_py(), rows["n"][0].as_py()
            wanted = missing(rows["place"].to_numpy(), n)
            size = sum(map(len, wanted))
            if size:
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([tree] * size, pa.int64()), "stretch": pa.array([stretch] * size, pa.int64()),
                    "level": pa.array(np.repeat(np.arange(len(wanted)), [len(w) for w in wanted]), pa.int32()),
                    "place": pa.array(np.concatenate(wanted), pa.int64())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 2):
            rows = rows.combine_chunks()
            first = int((rows["kind"].to_numpy() == 0).sum())
            fetched, mine = rows.slice(0, first), rows.slice(first)
            n = mine["n"][0].as_py()
            level, at, held = fetched["level"].to_numpy(), fetched["place"].to_numpy(), np.array(fetched["hash"].to_pylist(), object)
            got = [(at[level == d], held[level == d]) for d in range(height(n))]
            place = mine["place"].to_numpy()
            levels, root = expand(place, np.array(mine["hash"].to_pylist(), object), n, got)
            yield pa.RecordBatch.from_arrays(
                [*[mine[c].combine_chunks() for c in ("row", "tree", "place", "hash")], pa.array([root] * len(place), pa.string()), _paths(place, levels)],
                names=["row", "tree", "place", "hash", "root", "path"])

    asked = _dealt(cut.select("tree", "stretch", "n", "place"), ["tree", "stretch"], ["place"]).mapInArrow(
        ask, "tree long, stretch long, level int, place long")
    fetched = asked.join(stored.select("tree", "level", "place", "hash"), ["tree", "level", "place"]).withColumns(
        {"kind": F.lit(0), "n": F.lit(0).cast("long"), "row": F.lit(None).cast(kind)})
    both = fetched.select(*columns).unionByName(cut.withColumns({"kind": F.lit(1), "level": F.lit(0)}).select(*columns))
    return _dealt(both, ["tree", "stretch"], ["kind", "level", "place"]).mapInArrow(
        answer, f"row {kind}, tree long, place long, hash string, root string, path {SIDES}")


def folded(hash_: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to: what a reader recomputes to verify a row."""
    step = lambda h, s: F.sha2(F.concat(F.coalesce(s["left"], F.lit("")), h, F.coalesce(s["right"], F.lit(""))), 256)
    return F.aggregate(path, hash_, step)


def siblings(path: Column) -> Column:
    """The path's hashes, level by level."""
    return F.filter(F.transform(path, lambda s: F.coalesce(s["left"], s["right"])), lambda h: h.isNotNull())


@dataclasses.dataclass(frozen=True)
class Manifest:
    """``leaves`` (row, tree, n, place, hash), ``nodes`` of the groups' trees, and the tree over the groups."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    tops: DataFrame

    def write(self, path: str) -> None:
        """Stores the four tables as Parquet under ``path``."""
        for part in dataclasses.fields(self):
            getattr(self, part.name).write.mode("overwrite").parquet(f"{path}/{part.name}")


def read(spark: SparkSession, path: str) -> Manifest:
    """A stored manifest."""
    return Manifest(*[spark.read.parquet(f"{path}/{part.name}") for part in dataclasses.fields(Manifest)])


def build(leaves: DataFrame, group: str, order: Sequence[str], row: str) -> Manifest:
    """The manifest of ``leaves``: one row per dataset row with its ``hash``, its group and what orders it.

    A group's leaves ascend by ``order``, nulls first, ties by hash; groups
    ascend by their UTF-8 bytes, null first. Rows that are equal throughout are
    leaves of their own. Without rows there is no node and no root. ``row``
    names the column that is handed through to the proofs.
    """
    placed = materialize(places(leaves.select(F.col(group).alias("_group"), *order, F.col(row).alias("row"), "hash"), "_group", [*order, "hash"]))
    names = places(placed.where("place = 0").select(F.lit(0).cast("long").alias("one"), F.col("_group").alias("name"), F.col("n").alias("rows")), "one", ["name"])
    groups = materialize(names.select("name", "rows", F.col("place").alias("tree"), F.col("n").alias("trees")))
    known = F.broadcast(groups) if groups.count() <= 100_000 else groups
    numbered = materialize(placed.join(known.select("name", "tree"), F.col("_group").eqNullSafe(F.col("name"))).select("row", "tree", "n", "place", "hash"))
    made = materialize(nodes(numbered))
    roots = made.where((F.col("place") == 0) & (F.pow(F.lit(2.0), F.col("level")) >= F.col("n")))
    tops = roots.groupBy("tree").agg(F.min_by("hash", "level").alias("hash")).join(groups.select("tree", "trees"), "tree").select(
        F.lit(0).cast("long").alias("tree"), F.col("trees").alias("n"), F.col("tree").alias("place"), "hash")
    return Manifest(numbered, made, groups, materialize(nodes(materialize(tops))))


def prove(manifest: Manifest, rows: DataFrame | None = None) -> DataFrame:
    """(row, hash, subroot, root, path) of ``rows``, a part of the manifest's leaves (all if None)."""
    own = proofs(manifest.leaves if rows is None else rows, manifest.nodes)
    tops = manifest.tops.where("level = 0").select(F.col("place").cast("string").alias("row"), "tree", "n", "place", "hash")
    upper = materialize(proofs(tops, manifest.tops).select(F.col("place").alias("tree"), F.col("root").alias("top"), F.col("path").alias("above")))
    known = F.broadcast(upper) if upper.count() <= 10_000 else upper
    return own.join(known, "tree").select("row", "hash", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("path", "above").alias("path"))
