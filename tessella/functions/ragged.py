"""Histogram distributions whose rows bring their own edges: ``bins`` and ``masses`` are both array columns.

A batch's edges and masses are two flat arrays with offsets. Everything below
is a segmented scan over them: running sums restart at each row, and where
points fall among a row's edges is found for all rows by one sort of edges
and points. Nothing is exploded, and no Python loop runs over rows.

A row is valid if it has one edge more than masses, at least one mass, edges
that are finite and never fall, and masses that are finite and not negative.
Any other row gives NULL. A row of zero masses is uniform over its buckets of
positive width. The CDF counts a point mass from its own point on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from tessella.functions.arrays import as_column


class Rows:
    """The valid rows of a batch, flat: edges, probabilities, sums up to the start of each bucket, and offsets."""

    def __init__(self, bins: pa.Array, masses: pa.Array) -> None:
        bins, masses = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (bins, masses))
        fits = pc.and_(pc.greater(pc.list_value_length(masses), 0), pc.equal(pc.list_value_length(bins), pc.add(pc.list_value_length(masses), 1)))
        ok = pc.fill_null(fits, False).to_numpy(zero_copy_only=False).copy()
        place = np.flatnonzero(ok)
        edges, size = self._flat(bins.filter(pa.array(ok)))
        m, n = self._flat(masses.filter(pa.array(ok)))
        edge_row, row = np.repeat(np.arange(len(place)), size), np.repeat(np.arange(len(place)), n)
        falls = np.zeros(len(edges), bool)
        falls[1:] = (edges[1:] < edges[:-1]) & (edge_row[1:] == edge_row[:-1])
        bad = np.zeros(len(place), bool)
        bad[edge_row[falls | ~np.isfinite(edges)]] = True
        bad[row[~np.isfinite(m) | ~(m >= 0)]] = True
        if bad.any():
            ok[place[bad]] = False
            edges, m, size, n = edges[~bad[edge_row]], m[~bad[row]], size[~bad], n[~bad]
            edge_row, row = np.repeat(np.arange(len(n)), size), np.repeat(np.arange(len(n)), n)
        self.ok, self.count, self.edges, self.edge_row, self.row, self.n = ok, len(n), edges, edge_row, row, n
        self.start = np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64) if len(n) else np.zeros(0, np.int64)
        self.edge_start = self.start + np.arange(len(n))
        first = np.arange(len(row)) + row  # the edge that begins each bucket
        self.low, self.high = edges[first], edges[first + 1]
        self.width = self.high - self.low
        total = np.bincount(row, m, len(n))[row] if len(n) else m
        wide = (self.width > 0).astype(float)
        open_ = np.bincount(row, wide, len(n))[row] if len(n) else m
        even = np.where(open_ > 0, wide / np.maximum(open_, 1.0), 1.0 / np.maximum(n[row], 1)) if len(n) else m
        self.p = np.divide(m, total, out=even, where=total > 0)
        ends = np.cumsum(self.p)
        before = np.concatenate(([0.0], ends))[self.start]
        self.after = ends - before[row] if len(n) else ends
        self.before = self.after - self.p

    @staticmethod
    def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)

    def rank(self, points: np.ndarray, point_row: np.ndarray) -> np.ndarray:
        """How many of its row's edges are at most each point."""
        n = len(self.edges)
        kind = np.concatenate([np.zeros(n, np.int8), np.ones(len(points), np.int8)])
        order = np.lexsort((kind, np.concatenate([self.edges, points]), np.concatenate([self.edge_row, point_row])))
        is_edge = order < n
        out = np.empty(len(points), np.int64)
        out[order[~is_edge] - n] = np.cumsum(is_edge)[~is_edge]
        return out - self.edge_start[point_row]

    def cdf(self, points: np.ndarray, point_row: np.ndarray) -> np.ndarray:
        """The CDF of its row at each point."""
        at = self.rank(points, point_row)
        n = self.n[point_row]
        k = self.start[point_row] + np.clip(at - 1, 0, n - 1)
        share = np.divide(points - self.low[k], self.width[k], out=np.ones(len(points)), where=self.width[k] > 0)
        inner = self.before[k] + self.p[k] * np.clip(share, 0.0, 1.0)
        return np.where(at == 0, 0.0, np.where(at > n, 1.0, np.clip(inner, 0.0, 1.0)))

    def each(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shared values once for every row."""
        return np.tile(values, self.count), np.repeat(np.arange(self.count), len(values))

    def quantiles(self, levels: np.ndarray) -> np.ndarray:
        """(row, level): where the row's CDF first reaches each level; the ends of its support at 0 and 1."""
        if not self.count:
            return np.empty((0, len(levels)))
        held = self.p > 0
        first = np.full(self.count, len(self.p))
        np.minimum.at(first, self.row[held], np.flatnonzero(held))
        last = np.full(self.count, -1)
        np.maximum.at(last, self.row[held], np.flatnonzero(held))
        after = self.after.copy()
        # From the last bucket that holds anything on, the sum is one.
        after[np.arange(len(after)) >= last[self.row]] = 1.0
        out = np.empty((self.count, len(levels)))
        for j, level in enumerate(levels):
            k = np.minimum(self.start + np.bincount(self.row, after < level, self.count).astype(np.int64), last)
            share = np.divide(level - self.before[k], self.p[k], out=np.zeros(self.count), where=self.p[k] > 0)
            found = self.low[k] + np.clip(share, 0.0, 1.0) * self.width[k]
            out[:, j] = self.low[first] if level <= 0 else self.high[last] if level >= 1 else found
        return out

    def crps(self, truth: np.ndarray) -> np.ndarray:
        """The integral of the squared distance of each row's CDF from the step at its truth."""
        t = truth[self.row]
        cut = np.clip(t, self.low, self.high)
        share = np.divide(cut - self.low, self.width, out=np.zeros(len(cut)), where=self.width > 0)
        middle = self.before + self.p * share
        third = lambda a, b, w: w * (a * a + a * b + b * b) / 3.0
        piece = third(self.before, middle, cut - self.low) + third(middle - 1.0, self.after - 1.0, self.high - cut)
        low, high = self.edges[self.edge_start], self.edges[self.edge_start + self.n]
        # Outside the support the CDF is 0 or 1, and the step is not.
        return np.bincount(self.row, piece, self.count) + np.maximum(low - truth, 0.0) + np.maximum(truth - high, 0.0)

    def masses(self, target: np.ndarray) -> np.ndarray:
        """(row, bucket): the mass between the target's edges."""
        f = self.cdf(*self.each(target)).reshape(self.count, len(target))
        # A point mass on the first edge belongs to the first bucket.
        at = self.rank(*self.each(target[:1]))
        below = self.cdf(np.full(self.count, np.nextafter(target[0], -np.inf)), np.arange(self.count)) if self.count else np.empty(0)
        f[:, 0] = np.where(at > 0, below, f[:, 0])
        return np.diff(f, axis=1)


def _lists(matrix: np.ndarray, ok: np.ndarray) -> pa.Array:
    sizes = np.where(ok, matrix.shape[1], 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.ascontiguousarray(matrix).ravel()), mask=None if ok.all() else pa.array(~ok))


def _arrays(bins: Column | str, masses: Column | str, found: Callable[[Rows], np.ndarray]) -> Column:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def of(b: pa.Array, m: pa.Array) -> pa.Array:
        rows = Rows(b, m)
        return _lists(found(rows), rows.ok)

    return of(as_column(bins), as_column(masses))


def _at_truth(bins: Column | str, masses: Column | str, y: Column, found: Callable[[Rows, np.ndarray], np.ndarray]) -> Column:
    @F.arrow_udf("double")
    def of(b: pa.Array, m: pa.Array, y: pa.Array) -> pa.Array:
        rows = Rows(b, m)
        truth = pc.fill_null(y.combine_chunks() if isinstance(y, pa.ChunkedArray) else y, float("nan")).to_numpy(zero_copy_only=False)
        out, known = np.zeros(len(truth)), rows.ok & np.isfinite(truth)
        t = truth[rows.ok]
        values = found(rows, np.where(np.isfinite(t), t, 0.0))
        out[rows.ok] = values
        return pa.array(out, mask=~known)

    return of(as_column(bins), as_column(masses), y.cast("double"))


def cdf_at(bins: Column | str, masses: Column | str, y: Column) -> Column:
    """Each row's CDF at its own value: the PIT of a truth. NULL for a value that is missing or not finite."""
    return _at_truth(bins, masses, y, lambda rows, t: rows.cdf(t, np.arange(rows.count)))


def cdf_values(bins: Column | str, masses: Column | str, values: Sequence[float]) -> Column:
    """Each row's CDF at shared values."""
    v = np.asarray(values, np.float64)
    return _arrays(bins, masses, lambda rows: rows.cdf(*rows.each(v)).reshape(rows.count, len(v)))


def ppf(bins: Column | str, masses: Column | str, levels: Sequence[float]) -> Column:
    """Each row's quantiles at shared levels."""
    q = np.atleast_1d(np.asarray(levels, np.float64))
    if (q < 0).any() or (q > 1).any():
        raise ValueError("levels must lie within [0, 1]")
    return _arrays(bins, masses, lambda rows: rows.quantiles(q))


def crps(bins: Column | str, masses: Column | str, y: Column) -> Column:
    """The exact CRPS of each row against its truth, wherever that lies."""
    return _at_truth(bins, masses, y, lambda rows, t: rows.crps(t))


def regrid(bins: Column | str, masses: Column | str, target: Sequence[float]) -> Column:
    """Each row's exact masses in shared buckets; what lies outside is left out."""
    edges = np.asarray(target, np.float64)
    return _arrays(bins, masses, lambda rows: rows.masses(edges))
