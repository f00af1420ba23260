"""SimHash near-duplicates through a Gray-order hierarchical index.

Documents get a 64-bit fingerprint; fingerprints within ``radius`` bits link,
and linked documents form components.

The index over the distinct fingerprints is a tree of shared bit patterns:

* Upper nodes fix the bits under a mask. Four masks share out a fingerprint's
  bits, and of two fingerprints within 3 bits one mask's bits are equal, so
  every pair meets in a node in which no difference has accumulated yet, while
  all other nodes are pruned. A node with too many fingerprints is refined by
  four masks over its remaining bits in the same way; other nodes stay. Nodes
  are Spark partitioning keys: the tree is never gathered anywhere.
* Below, a node's fingerprints are sorted by Gray rank, so neighbours share
  bits. Windows of them become lower nodes: the bits on which a window agrees.
  Two windows are compared by the differences under the bits common to both;
  more than ``radius`` prunes all their pairs, else the pairs are compared.

A node returns links to the least fingerprint of each linked group, so the
output stays linear although a group of near copies may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.common import free_name, materialize, rows_of
from tessella.llm.components import components

SEED = 42
#: Bits under each mask, level by level; 4 masks each.
LEVELS = (16, 12, 9, 7)
#: Fingerprints in a node above which it is refined.
NODE_ROWS = 4096
WINDOW = 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str, words: int = 3) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; fewer words make one run, none make none."""
    found = text.encode().lower().split()
    if len(found) > words:
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(found) - words + 1
        h = xxhash.xxh64_intdigest
        pieces = [h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1:].tolist(), strict=True)]
        return np.array(pieces, np.uint64)
    return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)] if found else [], np.uint64)


def fingerprint(text: str, words: int = 3) -> int:
    """Bit by bit the strict majority of the shingles' hashes, as a signed 64-bit number."""
    h = shingle_hashes(text, words)
    octets = h.view(np.uint8).reshape(len(h), 8)
    if len(h) < 2048:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(df: DataFrame, text: str, keep: dict[str, Column], words: int = 3) -> DataFrame:
    """The columns in ``keep`` and ``fp`` (long); a null text counts as empty and has fingerprint zero."""
    names = [*keep, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            made = [fingerprint(t or "", words) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.int64())], names=names)

    source = df.select(*[c.alias(name) for name, c in keep.items()], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["fp long"])
    return source.mapInArrow(run, schema)


def _descend(rows: DataFrame, width: int, left: int) -> DataFrame:
    """Each row under its four masks of ``width`` bits over the ``left`` bits that remain."""
    made = []
    for k in range(4):
        low, keep = width * k, left - width
        pattern = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << width) - 1))
        above = F.lit(0).cast("long") if low + width >= 64 else F.shiftrightunsigned("rest", low + width)
        rest = F.shiftleft(above, low).bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << low) - 1))) if keep else F.lit(0).cast("long")
        node = F.shiftleft("node", width + 2).bitwiseOR(F.lit(k << width)).bitwiseOR(pattern)
        made.append(F.struct(node.alias("node"), rest.alias("rest")))
    return rows.select("fp", F.explode(F.array(*made)).alias("x")).select("fp", "x.node", "x.rest")


def index_nodes(codes: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """(fp, node): every fingerprint in the nodes that hold it; big nodes are refined while masks are left."""
    rows = codes.select("fp", F.lit(1).cast("long").alias("node"), F.col("fp").alias("rest"))
    done, left = None, 64
    for level, width in enumerate(LEVELS):
        rows, left = _descend(rows, width, left), left - width
        counts = rows.groupBy("node").count()
        big = materialize(counts.where(F.col("count") > node_rows).select("node")) if level + 1 < len(LEVELS) else None
        # Level marks keep nodes of different levels apart.
        mark = F.shiftleft("node", 2).bitwiseOR(F.lit(level))
        if big is None or big.isEmpty():
            part = rows.select("fp", mark.alias("node"))
            return part if done is None else done.unionByName(part)
        part = rows.join(big, "node", "left_anti").select("fp", mark.alias("node"))
        done = part if done is None else done.unionByName(part)
        rows = rows.join(big, "node", "left_semi")
    return done


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The rank of each 64-bit word in the reflected Gray order: the inverse of r ^ (r >> 1)."""
    r = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        r = r ^ (r >> np.uint64(shift))
    return r


def _roots(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Joins the groups of ``i`` and ``j``: labels are positions, each group's is its least."""
    while True:
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            return label
        np.minimum.at(label, high[open_], low[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= radius


def linked(codes: np.ndarray, radius: int = 3) -> np.ndarray:
    """For a node's codes in Gray order: the position of the first code of each one's group."""
    n = len(codes)
    label = np.arange(n)
    if n <= 2 * WINDOW:
        i, j = np.triu_indices(n, 1)
        hit = _near(codes[i], codes[j], radius)
        return _roots(i[hit], j[hit], label)
    starts = np.arange(0, n, WINDOW)
    every = np.bitwise_and.reduceat(codes, starts)
    some = np.bitwise_or.reduceat(codes, starts)
    mask = every | ~some
    within = np.arange(WINDOW)
    for w in range(len(starts)):
        # Differences that have accumulated under the bits on which both windows agree.
        apart = np.bitwise_count((every[w] ^ every[w:]) & mask[w] & mask[w:])
        open_ = w + np.flatnonzero(apart <= radius)
        j = (starts[open_][:, None] + within).ravel()
        j = j[j < n]
        i = np.arange(starts[w], min(n, starts[w] + WINDOW))
        hit_i, hit_j = np.nonzero(_near(codes[i][:, None], codes[j][None, :], radius))
        if len(hit_i):
            label = _roots(i[hit_i], j[hit_j], label)
    return label


def _small_nodes(codes: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within many small nodes at once, for sorted nodes: codes a few places apart in the same node."""
    a, b = [], []
    for step in range(1, 2 * WINDOW):
        same = np.flatnonzero(nodes[:-step] == nodes[step:]) if step < len(nodes) else np.array([], np.int64)
        if not len(same):
            break
        hit = same[_near(codes[same], codes[same + step], radius)]
        a.append(codes[hit])
        b.append(codes[hit + step])
    return np.concatenate(a or [codes[:0]]), np.concatenate(b or [codes[:0]])


def _search(nodes: np.ndarray, codes: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links of whole nodes; ``nodes`` is sorted, codes in Gray order within a node."""
    first = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
    size = np.diff(np.append(first, len(nodes)))
    small = np.repeat(size <= 2 * WINDOW, size)
    a, b = _small_nodes(codes[small], nodes[small], radius)
    a, b = [a], [b]
    for start, n in zip(first[size > 2 * WINDOW], size[size > 2 * WINDOW], strict=True):
        own = codes[start:start + n]
        label = linked(own, radius)
        other = np.flatnonzero(label != np.arange(n))
        a.append(own[other])
        b.append(own[label[other]])
    return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a).view(np.int64)), "b": pa.array(np.concatenate(b).view(np.int64))})


def links(codes: DataFrame, radius: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """(a, b) pairs of distinct fingerprints within ``radius`` (3 at most) that connect all linked groups."""
    if not 0 <= radius <= 3:
        raise ValueError("four masks find differences of 3 bits at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, codes = np.array([], np.int64), np.array([], np.uint64)
        for batch in batches:
            nodes = np.concatenate([nodes, batch.column(0).to_numpy()])
            codes = np.concatenate([codes, batch.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(nodes, nodes[-1])) if len(nodes) else 0
            if cut:
                yield _search(nodes[:cut], codes[:cut], radius)
                nodes, codes = nodes[cut:], codes[cut:]
        if len(nodes):
            yield _search(nodes, codes, radius)

    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    placed = index_nodes(codes, node_rows).select("node", "fp", rank.bitwiseXOR(F.lit(-(1 << 63))).alias("rank"))
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartition(parts, "node").sortWithinPartitions("node", "rank").select("node", "fp")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def fingerprint_groups(ids: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, group) for every fingerprint of ``ids`` (a checkpointed table) that links to another; the rest stand alone."""
    return components(links(ids.select("fp").distinct(), radius))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Equal fingerprints link too. A null or wordless text has fingerprint zero
    and is linked like any other. Rows with a null id get a row and take part;
    they never name a component unless it has no other id (then null). Repeated
    rows are all returned. An empty table gives an empty result.
    """
    ids = materialize(fingerprints(df, text, {"doc_id": F.col(f"`{id_col}`").cast("long")}, words))
    groups = fingerprint_groups(ids, radius)
    least = ids.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = least.join(groups, "fp", "left").select("fp", "least", F.coalesce("group", "fp").alias("group"))
    smallest = named.groupBy("group").agg(F.min("least").alias("component_id"))
    of_fp = named.select("fp", "group").join(smallest, "group").select("fp", "component_id")
    return ids.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """The documents with one of each near-duplicate group: the one with the smallest id, null ids last.

    Rows that repeat both the id and the text are one document. All columns
    stay as they are, extra ones included.
    """
    content = F.xxhash64(F.col(f"`{text}`").isNull(), F.col(f"`{text}`"))
    keys = {"id": F.col(f"`{id_col}`").cast("long"), "content": content}
    own_id, own_content, kept_id, kept_content = (free_name(docs, f"__{n}") for n in ("id", "content", "kept_id", "kept_content"))
    ids = materialize(fingerprints(docs, text, keys, words))
    groups = fingerprint_groups(ids, radius)
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("content"))
    least = ids.groupBy("fp").agg(F.min(order).alias("least"))
    named = least.join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    first = named.groupBy("group").agg(F.min("least").alias("least")).select(
        F.col("least.id").alias(kept_id), F.col("least.content").alias(kept_content))
    marked = docs.withColumns({own_id: keys["id"], own_content: content})
    chosen = marked.join(first, F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_content) == F.col(kept_content)), "left_semi")
    # What repeats a kept id and text is the same document.
    return chosen.dropDuplicates([own_id, own_content]).select(*[F.col(f"`{c}`") for c in docs.columns])
