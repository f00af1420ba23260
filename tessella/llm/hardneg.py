"""Hard negatives of labelled vectors: for every anchor and each of its positives, the best rows of other labels in a score window.

Anchors and rows meet in blocks. A block's scores are one matrix product, from
which only what can matter leaves the task: each anchor's best rows of its own
label, and, once its positives are known, the best rows of other labels in
each positive's window. What is left is packed into (anchor, descending score,
id) keys and goes through one secondary sort
(``repartitionAndSortWithinPartitions``); an iterator walks an anchor's keys
in order, opens a window at every positive and hands negatives out to the open
windows. It holds a window per positive, never an anchor's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.rdd import portable_hash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.llm.common import materialize

#: Anchors and rows in a block: their score matrix is the memory of a task.
ANCHOR_ROWS = 1024
BLOCK_ROWS = 4096
LONG = (1 << 63) - 1
#: Integers up to here are exact as doubles.
EXACT = 1 << 53
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(rows: DataFrame, id_col: str, vector: str, label: Column) -> DataFrame:
    """(id, label, vec, dim): rows that take part, each once, with components floor(256 x)."""
    x = F.col(f"`{vector}`").cast("array<double>")
    every = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), x.alias("vec"))
    kept = every.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(
        F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return kept.dropDuplicates().withColumn("dim", F.size("vec"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(256.0 * flat.reshape(len(column), dim))


def _scores(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products: doubles where they are exact, else Python's whole numbers, held at the ends of a long."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(r).max(initial=0)) * max(1, a.shape[1])
    if bound * max(100, len(r)) < EXACT:
        return a @ r.T
    whole = [[int(v) for v in row] for row in r.tolist()]
    rows = []
    for left in a.tolist():
        mine = [int(v) for v in left]
        rows.append([min(max(sum(x * y for x, y in zip(mine, other, strict=True)), -LONG - 1), LONG) for other in whole])
    return np.array(rows, object).reshape(len(a), len(r))


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of each line's ``k`` highest allowed scores; of equal scores the first column counts as higher."""
    n = scores.shape[1]
    if scores.dtype == object:
        lines, columns = [], []
        for i in range(len(scores)):
            order = sorted(np.flatnonzero(allowed[i]).tolist(), key=lambda j: (-scores[i, j], j))[:k]
            lines += [i] * len(order)
            columns += order
        return np.array(lines, np.int64), np.array(columns, np.int64)
    packed = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), -np.inf)
    if n > k:
        columns = np.argpartition(packed, n - k, axis=1)[:, n - k:]
    else:
        columns = np.broadcast_to(np.arange(n), packed.shape)
    lines = np.repeat(np.arange(len(packed)), columns.shape[1])
    columns = columns.ravel()
    open_ = packed[lines, columns] > -np.inf
    return lines[open_], columns[open_]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(anchors, some rows) of one block pair after the other; ``batches`` are sorted by (block, kind)."""
    block, anchors, rows = None, [], []

    def flush() -> Iterator[tuple[pa.Table, pa.Table]]:
        if anchors and rows:
            yield pa.Table.from_batches(anchors), pa.Table.from_batches(rows)
        rows.clear()

    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if start == end:
                continue
            if keys[start] != block:
                yield from flush()
                anchors.clear()
                block = keys[start]
            part = batch.slice(start, end - start)
            first = int(np.searchsorted(part.column(1).to_numpy(), 1))
            if first:
                anchors.append(part.slice(0, first))
            if first < part.num_rows:
                rows.append(part.slice(first))
            if sum(x.num_rows for x in rows) >= BLOCK_ROWS:
                yield from flush()
    yield from flush()


def _meet(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int) -> DataFrame:
    """Anchors and rows side by side, block pair by block pair: (block, kind, id, tag, label, vec, dim, wins), anchors first."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, r = -(-max(n_anchors, 1) // ANCHOR_ROWS), max(parts, -(-n_rows // BLOCK_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["a", "r", "kind", "id", "tag", "label", "vec", "dim", "wins"]
    left = anchors.withColumn("kind", F.lit(0)).withColumn("a", F.pmod(F.xxhash64("id", "tag"), F.lit(a)).cast("int")).withColumn("r", every(r))
    right = rows.withColumns({"kind": F.lit(1), "tag": F.lit(0).cast("long"), "wins": F.lit(None).cast("array<long>")})
    right = right.withColumn("r", F.pmod(F.xxhash64("id", "label", "vec"), F.lit(r)).cast("int")).withColumn("a", every(a))
    both = left.select(*columns).unionByName(right.select(*columns)).withColumn("block", F.xxhash64("a", "r", "dim"))
    return both.repartition(min(a * r, 4 * parts), "block").sortWithinPartitions("block", "kind", "id").select("block", "kind", "id", "tag", "label", "vec", "dim", "wins")


def _kernel(pick: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs ``pick(scores, anchors, rows) -> (lines, columns)`` on every block pair; returns (anchor, tag, score, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, rows in _blocks(batches):
            anchors, rows = anchors.combine_chunks(), rows.combine_chunks()
            a_ids, r_ids = anchors["id"].to_numpy(), rows["id"].to_numpy()
            dim = anchors["dim"][0].as_py()
            scores = _scores(_matrix(anchors["vec"].combine_chunks(), dim), _matrix(rows["vec"].combine_chunks(), dim))
            same = anchors["label"].to_numpy()[:, None] == rows["label"].to_numpy()[None, :]
            lines, columns = pick(scores, same, a_ids, r_ids, anchors["wins"].to_pylist())
            found = [int(v) for v in scores[lines, columns]]
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array(a_ids[lines]), "tag": pa.array(anchors["tag"].to_numpy()[lines]),
                "score": pa.array(found, pa.int64()), "id": pa.array(r_ids[columns])})

    return run


def windows(keys: Iterator[tuple], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Walks sorted (anchor, tag, -score, kind, id) keys; kind 0 is a positive, 1 a negative.

    A positive opens a window of scores from ``low`` to ``high`` percent of its own,
    which takes the first ``negatives`` rows of other labels that fit.
    """
    anchor, open_, opened = None, [], 0
    for (a, tag, below, kind, i), _ in keys:
        if (a, tag) != anchor:
            anchor, open_, opened = (a, tag), [], 0
        score = -below
        if kind == 0:
            opened += 1
            if opened <= positives:
                open_.append([score, i, 0])
            continue
        for window in open_:
            if low * window[0] <= 100 * score <= high * window[0]:
                window[2] += 1
                yield a, window[1], window[2], i, window[0], score
        open_ = [w for w in open_ if w[2] < negatives and 100 * score >= low * w[0]]


def mine(
    table: DataFrame, anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: Column | str = "label", *,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor.

    ``anchor`` says over the column ``id`` which rows are anchors. A row's
    score is the inner product of the vectors' floor(256 x); higher scores come first, of
    equal scores the smaller id. An anchor's positives are the first
    ``positives`` rows of its label with another id; a positive's negatives are
    the first ``negatives`` rows of other labels that score between ``low`` and
    ``high`` percent of it. Anchors without positives, and positives without
    negatives, have no row.

    Rows with a null id, label, vector or component, or a component that is not
    finite, take no part. Rows that repeat id, label and vector are one row;
    rows that share an id alone are rows of their own, and never each other's
    positives. Only vectors of equal length are compared; empty vectors score
    zero. Scores beyond a long are held at its ends. Labels, vectors and ids
    may repeat without limit: rows are dealt to blocks by a hash of all
    three. An empty table gives an empty result. Other columns
    are not looked at.
    """
    rows = materialize(usable(table, id_col, vector, F.col(f"`{label}`") if isinstance(label, str) else label))
    chosen = materialize(rows.where(anchor).withColumn("tag", F.xxhash64("label", "vec")))
    n, m = rows.count(), chosen.count()
    k, wins = positives, negatives

    def own(scores, same, a_ids, r_ids, _):
        return _best(scores, same & (a_ids[:, None] != r_ids[None, :]), k)

    def other(scores, same, a_ids, r_ids, won):
        width = scores.shape[1]
        found = []
        for slot in range(k):
            have = np.array([w is not None and slot < len(w) for w in won])
            at = np.array([w[slot] if w is not None and slot < len(w) else 0 for w in won], scores.dtype)[:, None]
            fits = ~same & have[:, None] & (low * at <= 100 * scores).astype(bool) & (100 * scores <= high * at).astype(bool)
            lines, columns = _best(scores, fits, wins)
            found.append(lines * width + columns)
        packed = np.unique(np.concatenate(found))
        return packed // width, packed % width

    columns = "anchor long, tag long, score long, id long"
    alone = chosen.withColumn("wins", F.lit(None).cast("array<long>"))
    near = _meet(alone, rows, m, n).mapInArrow(_kernel(own), columns)
    order = Window.partitionBy("anchor", "tag").orderBy(F.desc("score"), "id")
    best = materialize(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place"))
    scores = best.groupBy(F.col("anchor").alias("id"), "tag").agg(F.array_distinct(F.sort_array(F.collect_list("score"))).alias("wins"))
    far = _meet(chosen.join(scores, ["id", "tag"]), rows, m, n).mapInArrow(_kernel(other), columns)
    candidates = best.withColumn("kind", F.lit(0)).unionByName(far.withColumn("kind", F.lit(1)))
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = candidates.rdd.map(lambda r: ((r["anchor"], r["tag"], -r["score"], r["kind"], r["id"]), None))
    ordered = keyed.repartitionAndSortWithinPartitions(parts, lambda key: portable_hash(key[:2]))
    found = ordered.mapPartitions(lambda it: windows(it, positives, negatives, low, high))
    return table.sparkSession.createDataFrame(found, RESULT, verifySchema=False)
