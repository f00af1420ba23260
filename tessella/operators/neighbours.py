"""Exact nearest neighbours through a metric index.

A few pivots, chosen farthest-first from a bounded sample, cut the context into
cells: a row belongs to its nearest pivot. Of every cell the index knows the
ring of distances in which its rows lie around each pivot. A query is first
compared with the rows of its nearest cells, which bounds its k-th distance;
by the triangle inequality, a cell can hold a nearer row only if the query's
distance to every pivot is within that bound of the cell's ring. All other
cells are never visited, and the result is the same as without an index.

A cell of any size is cut into parts of bounded size, and the parts, in order,
are packed into slabs. A task holds one slab and lets a group of the queries
that visit it stream past, in the order of their cells. Of rows with equal
vectors only the first ``k`` ids can be neighbours; the others are left out.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessella.session import materialize

# Bounds of the index: pivots, rows they are chosen from, and about how many rows a cell should have.
MOST_PIVOTS = 256
PIVOT_SAMPLE = 4096
CELL_ROWS = 128
# Rows of a part of a cell, of a block of a matrix product, and differences that are measured at once.
PART_ROWS = 4096
BLOCK_ROWS = 1024
MEASURED = 16_384
# Rows and bytes of the slab of parts that a task holds, and queries beyond which a slab is held by several tasks.
SLAB_LEAST = 1024
SLAB_BYTES = 32 << 20
TASK_QUERIES = 262_144
#: Relative room for rounding in the bounds.
SLACK = 1e-9


@dataclasses.dataclass(frozen=True)
class MetricIndex:
    """``rows`` (cell, part, cid, v, y), and per cell its size and the rings around all pivots."""

    rows: DataFrame
    pivots: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    part_rows: int

    @property
    def parts(self) -> np.ndarray:
        return np.maximum(1, -(-self.sizes // self.part_rows))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def distances(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` to the few rows of ``z``, without cancellation."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in z], axis=1)


def farthest_first(points: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` points, each the farthest from those before it; of equals the first. Copies are never chosen."""
    chosen, left = [0], np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    while len(chosen) < most and left.max() > 0:
        chosen.append(int(left.argmax()))
        left = np.minimum(left, np.sqrt(((points - points[chosen[-1]]) ** 2).sum(axis=1)))
    return points[chosen]


def metric_index(context: DataFrame, *, id_col: str, vector_col: str, value: str, part_rows: int = PART_ROWS) -> MetricIndex:
    """The index of the rows with a vector; vectors have one length and finite components."""
    rows = context.select(F.col(id_col).alias("cid"), F.col(vector_col).cast("array<double>").alias("v"), F.col(value).cast("double").alias("y")).where("v IS NOT NULL")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("cid"), "cid").limit(PIVOT_SAMPLE).select("v").collect()
    points = np.array([r["v"] for r in sample], np.float64).reshape(len(sample), len(sample[0]["v"]) if sample else 0)
    pivots = farthest_first(points, min(MOST_PIVOTS, max(1, n // CELL_ROWS))) if n else points
    count, width = len(pivots), points.shape[1]
    shared = context.sparkSession.sparkContext.broadcast(pivots)  # MOST_PIVOTS vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = distances(_matrix(batch.column(1), width), shared.value).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], names=["cell", "cid", "v", "y"])

    def rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((count, count), np.inf), np.full((count, count), -np.inf)
        size = np.zeros(count, np.int64)
        for batch in batches:
            cell = batch.column(0).to_numpy()
            d = distances(_matrix(batch.column(1), width), shared.value)
            np.minimum.at(low, cell, d)
            np.maximum.at(high, cell, d)
            size += np.bincount(cell, minlength=count)
        for c in np.flatnonzero(size).tolist():
            yield pa.RecordBatch.from_pydict({
                "cell": pa.array([c] * count, pa.int32()), "pivot": pa.array(range(count), pa.int32()), "low": pa.array(low[c]), "high": pa.array(high[c]),
                "n": pa.array([int(size[c])] * count, pa.int64())})

    sizes, low, high = np.zeros(count, np.int64), np.full((count, count), np.inf), np.full((count, count), -np.inf)
    if not n:
        return MetricIndex(rows.select(F.lit(0).alias("cell"), "cid", "v", "y", F.lit(0).alias("part")), pivots, sizes, low, high, part_rows)
    kind = rows.schema["cid"].dataType.simpleString()
    placed = materialize(rows.mapInArrow(assign, f"cell int, cid {kind}, v array<double>, y double"))
    table = placed.select("cell", "v").mapInArrow(rings, "cell int, pivot int, low double, high double, n long").groupBy("cell", "pivot").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toArrow()  # MOST_PIVOTS squared rows at most
    c, p = table["cell"].to_numpy(), table["pivot"].to_numpy()
    sizes[c], low[c, p], high[c, p] = table["n"].to_numpy(), table["low"].to_numpy(), table["high"].to_numpy()
    parts = F.lit(np.maximum(1, -(-sizes // part_rows)).astype(np.int32))
    part = F.pmod(F.xxhash64("cid", "v"), F.element_at(parts, F.col("cell") + 1)).cast("int")
    return MetricIndex(placed.withColumn("part", part), pivots, sizes, low, high, part_rows)


def home_cells(queries: DataFrame, index: MetricIndex, k: int) -> DataFrame:
    """(qid, v, cells, home, bound): each query's nearest cells, as many as hold ``k`` rows, and the nearest one; nothing bounds it yet."""
    shared = queries.sparkSession.sparkContext.broadcast((index.pivots, index.sizes))
    kind, width = queries.schema["qid"].dataType.simpleString(), index.pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, sizes = shared.value
        for batch in batches:
            order = distances(_matrix(batch.column(1), width), pivots).argsort(axis=1, kind="stable")
            need = (sizes[order].cumsum(axis=1) < k).sum(axis=1) + 1
            cells = [row[:m].tolist() for row, m in zip(order, need.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(cells, pa.list_(pa.int32())), pa.array(order[:, 0], pa.int32()), pa.array(np.full(len(order), np.inf))],
                names=["qid", "v", "cells", "home", "bound"])

    return queries.select("qid", "v").mapInArrow(run, f"qid {kind}, v array<double>, cells array<int>, home int, bound double")


def open_cells(queries: DataFrame, index: MetricIndex) -> DataFrame:
    """The queries (qid, v, cells, home, bound) with the cells that may hold a row nearer than ``bound``, beyond those in ``cells``."""
    shared = queries.sparkSession.sparkContext.broadcast((index.pivots, index.low, index.high))
    kind, width = queries.schema["qid"].dataType.simpleString(), index.pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, low, high = shared.value
        for batch in batches:
            d = distances(_matrix(batch.column(1), width), pivots)
            bound = batch.column(3).to_numpy(zero_copy_only=False)
            found = []
            for own, far, seen in zip(d, bound, batch.column(2).to_pylist(), strict=True):
                room = far + SLACK * (1.0 + far + own.max())
                inside = ((own >= low - room) & (own <= high + room)).all(axis=1)
                inside[seen] = False
                found.append(np.flatnonzero(inside).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int32())), *batch.columns[4:], batch.column(3)], names=["qid", "v", "cells", "home", "bound"])

    return queries.select("qid", "v", "cells", "bound", "home").mapInArrow(run, f"qid {kind}, v array<double>, cells array<int>, home int, bound double")


def _leading(r: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each row ``r`` by ``d``, of equals the smaller id, in that order."""
    order = np.lexsort((ids, d, r))
    at = np.arange(len(order))
    starts = np.r_[True, np.diff(r[order]) != 0] if len(order) else np.zeros(0, bool)
    return order[at - np.maximum.accumulate(np.where(starts, at, 0)) < k]


def _nearest_of(
    x: np.ndarray, z: np.ndarray, squares: np.ndarray, cid: np.ndarray, cell: np.ndarray, ask: np.ndarray, bound: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``x``, position in ``z``, squared distance) of each row's ``k`` nearest in the cells it asks for, none beyond ``bound``.

    ``z`` is in the order of its cells, ``ask`` has a column per cell. Matrix products
    of a block bound the distances; what may be among the nearest is measured exactly.
    """
    own = (x * x).sum(axis=1)
    slack = SLACK * (own + squares.max())
    limit = bound * bound * (1.0 + SLACK)
    row, place, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for start in range(0, len(z), BLOCK_ROWS):
        here = cell[start:start + BLOCK_ROWS]
        wanted = ask[:, here[0]:here[-1] + 1]
        rows = np.flatnonzero(wanted.any(axis=1))
        if not rows.size:
            continue
        whole = bool(wanted[rows].all())
        cols = np.arange(start, start + len(here)) if whole else start + np.flatnonzero(wanted.any(axis=0)[here - here[0]])
        rough = x[rows] @ z[cols].T
        rough *= -2.0
        rough += squares[cols]
        if not whole:
            unasked = ~wanted[np.ix_(rows, cell[cols] - here[0])]
            rough[unasked] = np.inf
        bar = limit[rows] + slack[rows] - own[rows]
        loose = np.flatnonzero(np.isinf(bar))
        if loose.size and len(cols) >= k:
            bar[loose] = np.partition(rough[loose], k - 1, axis=1)[:, k - 1] + 2.0 * slack[rows][loose]
        # A rough distance that is no number is measured, too.
        held = ~(rough > bar[:, None])
        if not whole:
            held &= ~unasked
        r, c = np.nonzero(held)
        if len(r) > 4 * k * len(rows):
            first = _leading(r, rough[r, c], c, k)
            last = np.flatnonzero(np.r_[np.diff(r[first]) != 0, True])
            full = np.bincount(r[first], minlength=len(rows)) >= k
            kth = np.full(len(rows), np.inf)
            kth[r[first][last]] = rough[r, c][first[last]] + 2.0 * slack[rows][r[first][last]]
            kth[~full] = np.inf
            near = ~(rough[r, c] > kth[r])
            r, c = r[near], c[near]
        d = np.empty(len(r))
        for i in range(0, len(r), MEASURED):
            d[i:i + MEASURED] = ((z[cols[c[i:i + MEASURED]]] - x[rows[r[i:i + MEASURED]]]) ** 2).sum(axis=1)
        row, place, dist = np.r_[row, rows[r]], np.r_[place, cols[c]], np.r_[dist, d]
        best = _leading(row, dist, cid[place], k)
        row, place, dist = row[best], place[best], dist[best]
        ends = np.flatnonzero(np.r_[np.diff(row) != 0, True])
        full = np.bincount(row, minlength=len(x))[row[ends]] >= k if len(row) else np.zeros(0, bool)
        limit[row[ends[full]]] = np.minimum(limit[row[ends[full]]], dist[ends[full]])
    near = dist <= bound[row] * bound[row] * (1.0 + SLACK)
    return row[near], place[near], dist[near]


@dataclasses.dataclass(frozen=True)
class Slabs:
    """How the parts of the cells, in order, are packed into slabs: a part's slab, and each slab's first and last cell."""

    begin: np.ndarray
    slab: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @property
    def n(self) -> int:
        return len(self.first)


def _slabs(index: MetricIndex, rows: int) -> Slabs:
    parts = index.parts
    cell = np.repeat(np.arange(len(parts)), parts)
    size = (index.sizes / parts)[cell]
    slab = np.unique(((np.cumsum(size) - size) // rows).astype(np.int64), return_inverse=True)[1].astype(np.int32)
    starts = np.flatnonzero(np.r_[True, np.diff(slab) != 0])
    ends = np.r_[starts[1:], len(slab)] - 1
    return Slabs((np.cumsum(parts) - parts).astype(np.int32), slab, cell[starts], cell[ends])


def _search(visits: DataFrame, index: MetricIndex, k: int, n_queries: int) -> DataFrame:
    """(qid, d, cid, y): up to ``k`` candidates of each slab that a query (qid, v, cells, bound) visits, none beyond its bound.

    Context and queries meet in blocks, about as many as there are shuffle
    partitions: a row of the context is sent once per group of queries, a
    query once per slab that holds a cell of its, whatever the number of cells.
    """
    count = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width, n, n_cells = index.pivots.shape[1], int(index.sizes.sum()), len(index.sizes)
    side = max(1.0, math.sqrt(count))
    slabs = _slabs(index, int(min(max(n / side, SLAB_LEAST), max(1, SLAB_BYTES // (8 * max(1, width))))))
    salts = max(1, math.ceil(n_queries / TASK_QUERIES), min(math.ceil(2 * count / slabs.n), n_queries // 1024))
    kinds = {"qid": visits.schema["qid"].dataType.simpleString(), "cid": index.rows.schema["cid"].dataType.simpleString()}
    columns = ["slab", "salt", "kind", "cell", "qid", "cid", "v", "y", "ask", "bound"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(2)
            ask = np.zeros((batch.num_rows, n_cells), bool)
            ask[np.repeat(np.arange(batch.num_rows), np.diff(cells.offsets.to_numpy())), cells.flatten().to_numpy()] = True
            packed = pa.array([row.tobytes() for row in np.packbits(ask, axis=1)], pa.binary())
            for s in range(slabs.n):
                rows = np.flatnonzero(ask[:, slabs.first[s]:slabs.last[s] + 1].any(axis=1))
                if rows.size:
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(rows.size, s, np.int32)), *[batch.column(i).take(at) for i in (0, 1, 3, 4)], packed.take(at)],
                        names=["slab", "qid", "v", "bound", "cell", "ask"])

    asked = visits.select("qid", "v", "cells", "bound", "home").mapInArrow(route, f"slab int, qid {kinds['qid']}, v array<double>, bound double, cell int, ask binary")
    asked = asked.withColumns({"salt": F.pmod(F.xxhash64("qid"), F.lit(salts)).cast("int"), "kind": F.lit(1), "cid": F.lit(None).cast(kinds["cid"]), "y": F.lit(None).cast("double")})
    slab = F.element_at(F.lit(slabs.slab), F.element_at(F.lit(slabs.begin), F.col("cell") + 1) + F.col("part") + 1)
    held = index.rows.withColumns({"slab": slab, "salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1))), "kind": F.lit(0)}).withColumns(
        {"qid": F.lit(None).cast(kinds["qid"]), "ask": F.lit(None).cast("binary"), "bound": F.lit(None).cast("double")})
    both = held.select(*columns).unionByName(asked.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, z = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if start == end:
                    continue
                now, piece = tuple(keys[start, :2]), batch.slice(start, end - start)
                if now != block:
                    block, own, z = now, [], None
                if keys[start, 2] == 0:
                    own.append(piece.select(["cell", "cid", "v", "y"]))
                    continue
                if not own:
                    continue
                if z is None:
                    table = pa.Table.from_batches(own)
                    z, cell, cid, y = _matrix(table["v"], width), table["cell"].to_numpy(), table["cid"].to_numpy(), table["y"].to_numpy()
                    squares = (z * z).sum(axis=1)
                x, bound = _matrix(piece.column(6), width), piece.column(9).to_numpy()
                bits = np.stack([np.frombuffer(b, np.uint8) for b in piece.column(8).to_pylist()])
                ask = np.unpackbits(bits, axis=1, count=n_cells).astype(bool)
                for i in range(0, len(x), 256):
                    r, at, d = _nearest_of(x[i:i + 256], z, squares, cid, cell, ask[i:i + 256], bound[i:i + 256], k)
                    yield pa.RecordBatch.from_arrays([piece.column(4).take(pa.array(r + i)), pa.array(d), pa.array(cid[at]), pa.array(y[at])], names=["qid", "d", "cid", "y"])

    ordered = both.repartition(count, "slab", "salt").sortWithinPartitions("slab", "salt", "kind", "cell")
    return ordered.mapInArrow(run, f"qid {kinds['qid']}, d double, cid {kinds['cid']}, y double")


def _first(candidates: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid").orderBy("d", "cid"))
    return candidates.withColumn("place", place).where(F.col("place") <= k).drop("place")


@dataclasses.dataclass(frozen=True)
class Search:
    """``found`` (qid, d, cid, y), ``k`` rows per query, and ``visits`` (qid, cells) that it took."""

    found: DataFrame
    visits: DataFrame


def search(queries: DataFrame, index: MetricIndex, k: int) -> Search:
    """The ``k`` nearest rows of each query (qid, v); all rows, if there are fewer. Ids are unique."""
    home = materialize(home_cells(queries, index, k))
    n_queries = home.count()
    near = materialize(_first(_search(home, index, k, n_queries), k))
    # Fewer than k rows in all: nothing lies beyond the cells visited.
    bound = near.groupBy("qid").agg(F.sqrt(F.max("d")).alias("bound"))
    more = open_cells(home.drop("bound").join(bound, "qid"), index)
    found = _first(near.unionByName(_search(more, index, k, n_queries)), k)
    return Search(found, home.select("qid", "cells").unionByName(more.select("qid", "cells")))


def nearest(
    queries: DataFrame, context: DataFrame, k: int, *, id_col: str, vector_col: str, context_id: str, value: str, part_rows: int = PART_ROWS,
) -> DataFrame:
    """Exact k nearest context rows per query: ``(id, neighbours array<struct<d, id, y>>)``, nearest first.

    ``d`` is the squared distance. Context rows without a vector take no part;
    a query without one, or an empty context, gives an empty array.
    """
    copies = Window.partitionBy(vector_col).orderBy(context_id)
    context = context.where(F.col(vector_col).isNotNull()).withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy")
    index = metric_index(context, id_col=context_id, vector_col=vector_col, value=value, part_rows=part_rows)
    own = queries.select(F.col(id_col).alias("qid"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = f"array<struct<d:double,id:{index.rows.schema['cid'].dataType.simpleString()},y:double>>"
    none = own.select(F.col("qid").alias(id_col), F.array().cast(kind).alias("neighbours"), "v")
    if not len(index.pivots):
        return none.drop("v")
    found = search(own.where("v IS NOT NULL"), index, k).found
    best = F.array_sort(F.collect_list(F.struct("d", F.col("cid").alias("id"), "y")))
    return found.groupBy(F.col("qid").alias(id_col)).agg(best.alias("neighbours")).unionByName(none.where("v IS NULL").drop("v"))
