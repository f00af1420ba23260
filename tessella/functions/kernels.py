"""Arrow kernels for row operations over wide arrays.

Spark's higher-order functions cost about 0.1 us per element and about 0.9 us
while their state is a struct. The scans, regrids, pools and point estimates
below therefore run as Arrow batches through numpy, at every width; Spark
still partitions and ships the rows. A row that is NULL, or whose array has
another length than the grid, gets a NULL result; no row can reach into
another one.

A kernel cannot sit inside a lambda, and its array must be a column of its
own: an expression whose nested lambdas share a variable is not pulled out of
the call by the optimizer. The array's size rides along as a second reference,
which keeps the optimizer from inlining that column back into the call.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T


#: Elements of a matrix that are worked on at once.
SLICE = 1 << 17


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the right length as a matrix, and which rows those are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    fits = ok.to_numpy(zero_copy_only=False)
    held = column if fits.all() else column.filter(ok)
    flat = held.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(int(fits.sum()), width), fits


def _lists(matrix: np.ndarray, fits: np.ndarray) -> pa.Array:
    """The matrix's rows as lists at their places, NULL elsewhere."""
    sizes = np.where(fits, matrix.shape[1], 0)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()), mask=None if fits.all() else pa.array(~fits))


def _values(found: np.ndarray, fits: np.ndarray) -> pa.Array:
    out = np.zeros(len(fits))
    out[fits] = found
    return pa.array(out, mask=~fits)


def _truths(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Truths as numbers and whether each is finite; NULL counts as not."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    t = pc.fill_null(column, float("nan")).to_numpy(zero_copy_only=False)
    return t, np.isfinite(t)


def _masses(grid):
    """Turns a batch of densities on a grid into masses between its nodes."""
    if grid.histogram:
        widths = grid.widths
        return lambda d: d * widths
    half = 0.5 * np.diff(grid.centers)
    return lambda d: (d[:, 1:] + d[:, :-1]) * half


def grid_cdf(density: Column, grid) -> Column:
    """Cumulative mass at a grid's bin centers."""
    width, masses, histogram = grid.n, _masses(grid), grid.histogram

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def running(values: pa.Array, _: pa.Array) -> pa.Array:
        d, fits = _matrix(values, width)
        m = masses(d)
        f = np.cumsum(m, axis=1)
        return _lists(f - 0.5 * m if histogram else np.concatenate([np.zeros((len(f), 1)), f], axis=1), fits)

    return running(density, F.size(density))


def cdf_points(probabilities: Column, width: int, bucket, share, keep, base) -> Column:
    """CDF values at shared points, each given as its bucket and the share of it below."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def points(values: pa.Array, _: pa.Array) -> pa.Array:
        p, fits = _matrix(values, width)
        inner = np.cumsum(p, axis=1)[:, bucket] - p[:, bucket] * (1.0 - share)
        return _lists(base + keep * np.clip(inner, 0.0, 1.0), fits)

    return points(probabilities, F.size(probabilities))


def inverse_cdf(array: Column, edges: np.ndarray, levels: np.ndarray, grid=None) -> Column:
    """Quantiles at shared levels of probabilities in shared buckets, or of a grid's densities."""
    widths, width = np.diff(edges), len(edges) - 1
    prepare = _masses(grid) if grid is not None else None
    row_width = width if grid is None else grid.n
    levels = np.asarray(levels, dtype=np.float64)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def invert(values: pa.Array, _: pa.Array) -> pa.Array:
        p, fits = _matrix(values, row_width)
        p = p if prepare is None else prepare(p)
        out = np.empty((len(p), levels.size))
        for i, row in enumerate(p):
            held = np.flatnonzero(row > 0)
            if not held.size:
                out[i] = np.nan
                continue
            cum = np.cumsum(row)
            cum[held[-1]:] = 1.0
            k = np.minimum(np.searchsorted(cum, levels, side="left"), held[-1])
            share = np.divide(levels - (cum[k] - row[k]), row[k], out=np.zeros(levels.size), where=row[k] > 0)
            out[i] = edges[k] + np.clip(share, 0.0, 1.0) * widths[k]
            out[i, levels <= 0.0] = edges[held[0]]
            out[i, levels >= 1.0] = edges[held[-1] + 1]
        return _lists(out, fits)

    return invert(array, F.size(array))


def _crps(m: np.ndarray, t: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """CRPS of rows of masses between shared nodes against their truths."""
    w = np.diff(nodes)
    hi = np.cumsum(m, axis=1)
    lo = hi - m
    k = np.clip(np.searchsorted(nodes, t, side="right") - 1, 0, w.size - 1)
    rows = np.arange(len(m))
    step = (np.arange(w.size)[None, :] > k[:, None]).astype(np.float64)
    u, v = lo - step, hi - step
    piece = (u * u + u * v + v * v) * (w / 3.0)
    piece[rows, k] = 0.0
    # The piece that holds the truth is split there.
    cut = np.clip(t, nodes[k], nodes[k + 1])
    f0, f1 = lo[rows, k], hi[rows, k]
    fc = f0 + (f1 - f0) * (cut - nodes[k]) / w[k]
    a, b = fc - 1.0, f1 - 1.0
    own = (cut - nodes[k]) * (f0 * f0 + f0 * fc + fc * fc) / 3.0 + (nodes[k + 1] - cut) * (a * a + a * b + b * b) / 3.0
    return piece.sum(axis=1) + own + np.maximum(nodes[0] - t, 0.0) + np.maximum(t - nodes[-1], 0.0)


def crps(density: Column, y: Column, grid) -> Column:
    """CRPS of a density on a grid, one value per row."""
    nodes, masses, width = grid.nodes.array, _masses(grid), grid.n

    @F.arrow_udf(T.DoubleType())
    def score(values: pa.Array, truth: pa.Array, _: pa.Array) -> pa.Array:
        (d, fits), (t, known) = _matrix(values, width), _truths(truth)
        both = fits & known
        return _values(_crps(masses(d[both[fits]]), t[both], nodes), both)

    return score(density, y, F.size(density))


def object_scores(pdf: Column, y: Column, grid, floor: float) -> Column:
    """``struct<cde, pit, crps, nll, mean, mode>`` of raw densities from one normalization per batch; NULL fields where a row cannot be scored.

    Marked nondeterministic, so that a filter on its result is not pushed
    below it, where it would be evaluated a second time.
    """
    nodes, masses, width, weights = grid.nodes.array, _masses(grid), grid.n, grid.node_weights
    centers, edges, histogram = grid.centers, grid.array, grid.histogram
    names = ("cde", "pit", "crps", "nll", "mean", "mode")

    def found(d: np.ndarray, t: np.ndarray) -> np.ndarray:
        d = np.where(np.isfinite(d), np.maximum(d, 0.0), 0.0)
        total = (d * weights).sum(axis=1)
        d[~(total > 0)] = 1.0
        d /= (d * weights).sum(axis=1)[:, None]
        rows, m = np.arange(len(d)), masses(d)
        if histogram:
            at = np.clip(np.searchsorted(edges, t, side="right") - 1, 0, width - 1)
            off = (t < edges[0]) | (t > edges[-1])
        else:
            at = np.searchsorted(0.5 * (centers[1:] + centers[:-1]), t, side="right")
            off = (t < 1.5 * centers[0] - 0.5 * centers[1]) | (t > 1.5 * centers[-1] - 0.5 * centers[-2])
        p = np.where(off, 0.0, d[rows, at])
        k = np.clip(np.searchsorted(nodes, t, side="right") - 1, 0, nodes.size - 2)
        share = np.clip((t - nodes[k]) / np.diff(nodes)[k], 0.0, 1.0)
        pit = (np.cumsum(m, axis=1) - m)[rows, k] + m[rows, k] * share
        pit = np.where(t >= nodes[-1], 1.0, np.where(t <= nodes[0], 0.0, np.clip(pit, 0.0, 1.0)))
        out = ((d * d * weights).sum(axis=1) - 2.0 * p, pit, _crps(m, t, nodes), -np.log(np.maximum(p, floor)),
               (d * (weights * centers)).sum(axis=1), centers[np.argmax(d, axis=1)])
        return np.stack(out, axis=1)

    @F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def score(values: pa.Array, truth: pa.Array, _: pa.Array) -> pa.Array:
        (d, fits), (t, known) = _matrix(values, width), _truths(truth)
        both = fits & known
        out = _sliced(d if both.sum() == fits.sum() else d[both[fits]], found, t[both])
        return pa.StructArray.from_arrays([_values(x, both) for x in out.T], names=list(names))

    return score.asNondeterministic()(pdf, y, F.size(pdf))


def knot_masses(knots: Column, levels: np.ndarray, edges: np.ndarray) -> Column:
    """Mass of piecewise-linear CDFs (per-row knots, shared levels) in shared buckets.

    Returns ``n_buckets + 2`` values: below the edges, each bucket, above them.
    """
    width = len(levels)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def bucket(values: pa.Array, _: pa.Array) -> pa.Array:
        rows, fits = _matrix(values, width)
        out = np.empty((len(rows), len(edges) + 1))
        for i, row in enumerate(rows):
            # The left limit at every edge but the last: a tie on an edge counts above it.
            k = np.searchsorted(row, edges, side="left")
            k[-1] = np.searchsorted(row, edges[-1], side="right")
            j = np.clip(k, 1, width - 1)
            gap = row[j] - row[j - 1]
            share = np.divide(edges - row[j - 1], gap, out=np.zeros(len(edges)), where=gap > 0)
            f = levels[j - 1] + (levels[j] - levels[j - 1]) * share
            f = np.where(k == 0, 0.0, np.where(k == width, 1.0, f))
            out[i] = np.maximum(np.diff(np.concatenate([[0.0], f, [1.0]])), 0.0)
        return _lists(out, fits)

    return bucket(knots, F.size(knots))



def _below(p: np.ndarray, source: np.ndarray, x: np.ndarray, side: str) -> np.ndarray:
    """Mass of each row below (``left``) or up to (``right``) shared points: what the running sum and the split bucket hold."""
    n, widths = p.shape[1], np.diff(source)
    k = np.clip(np.searchsorted(source, x, side=side) - 1, -1, n)
    inside = (k >= 0) & (k < n)
    j = np.clip(k, 0, n - 1)
    share = np.divide(x - source[j], widths[j], out=np.ones(len(x)), where=widths[j] > 0).clip(0.0, 1.0)
    run = np.cumsum(p, axis=1)
    return np.where(k < 0, 0.0, np.where(inside, run[:, j] - p[:, j] * (1.0 - share), run[:, -1:]))


def _parts(p: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Masses below, in each of, and above the target buckets.

    A point mass on an edge belongs to the bucket above it; the last bucket is closed.
    """
    f = _below(p, source, target, "left")
    f[:, -1:] = _below(p, source, target[-1:], "right")
    return np.concatenate([f[:, :1], np.maximum(np.diff(f, axis=1), 0.0), np.maximum(p.sum(axis=1, keepdims=True) - f[:, -1:], 0.0)], axis=1)


def _sliced(rows: np.ndarray, f, *more: np.ndarray) -> np.ndarray:
    """``f`` over slices of rows (and of ``more`` of as many rows) that stay in a processor's cache, its results in one array."""
    step = max(1, SLICE // max(1, rows.shape[1]))
    if len(rows) <= step:
        return f(rows, *more)
    first = f(rows[:step], *[m[:step] for m in more])
    out = np.empty((len(rows), *first.shape[1:]), first.dtype)
    out[:step] = first
    for start in range(step, len(rows), step):
        out[start:start + step] = f(rows[start:start + step], *[m[start:start + step] for m in more])
    return out


def _shares(masses: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Masses over their sum; a row without mass is uniform over the buckets of positive width."""
    total = masses.sum(axis=1, keepdims=True)
    return np.where(total > 0, np.divide(masses, total, out=np.zeros_like(masses), where=total > 0), np.where(np.isnan(total), np.nan, wide / wide.sum()))


def _wide(source: np.ndarray) -> np.ndarray:
    wide = (np.diff(source) > 0).astype(float)
    return wide if wide.any() else np.ones(len(wide))


def regrid_parts(p: Column, source: np.ndarray, target: np.ndarray, raw: bool = False, inner: bool = False) -> Column:
    """Exact masses of rows on shared buckets below, in each of, and above other buckets; ``inner`` leaves out the first and the last.

    With ``raw`` the rows are masses of any sum.
    """
    width, wide = len(source) - 1, _wide(source)

    def moved(rows: np.ndarray) -> np.ndarray:
        parts = _parts(_shares(rows, wide) if raw else rows, source, target)
        return parts[:, 1:-1] if inner else parts

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def move(values: pa.Array, _: pa.Array) -> pa.Array:
        rows, fits = _matrix(values, width)
        return _lists(_sliced(rows, moved), fits)

    return move(p, F.size(p))


def on_grid(p: Column, source: np.ndarray, grid, raw: bool = False) -> Column:
    """Densities on a grid, normalized by its convention, of rows of masses in shared buckets; with ``raw`` masses of any sum."""
    width, target, widths, weights = len(source) - 1, grid.array, grid.widths, grid.node_weights
    own, wide = np.array_equal(source, target) and bool((widths > 0).all()), _wide(source)

    def dense(rows: np.ndarray) -> np.ndarray:
        rows = _shares(rows, wide) if raw else rows
        return _normalized((rows if own else _parts(rows, source, target)[:, 1:-1]) / widths, weights)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def density(values: pa.Array, _: pa.Array) -> pa.Array:
        rows, fits = _matrix(values, width)
        return _lists(_sliced(rows, dense), fits)

    return density(p, F.size(p))


def _normalized(d: np.ndarray, weights: np.ndarray) -> np.ndarray:
    d = np.where(np.isfinite(d), np.maximum(d, 0.0), 0.0)
    mass = d @ weights
    d[~(mass > 0)] = 1.0
    return d / (d @ weights)[:, None]


def point_estimates(density: Column, grid, fraction: float, raw: bool = False) -> Column:
    """``struct<mode, peak_mean, mean, median>`` of normalized densities; with ``raw`` of densities of any scale."""
    width, weights, centers = grid.n, grid.node_weights, grid.centers
    nodes, masses = grid.nodes.array, _masses(grid)

    def found(d: np.ndarray) -> np.ndarray:
        d = _normalized(d, weights) if raw else d
        top = np.argmax(d, axis=1) if len(d) else np.array([], np.int64)
        rows = np.arange(len(d))
        low = d < (d[rows, top] * fraction)[:, None]
        place = np.arange(width)
        # The run of high bins around the mode: from the last low bin before it to the first after it.
        start = np.where(low & (place < top[:, None]), place + 1, 0).max(axis=1, initial=0)
        end = np.where(low & (place > top[:, None]), place, width).min(axis=1, initial=width)
        run = np.concatenate([np.zeros((len(d), 1)), np.cumsum(d * weights, axis=1)], axis=1)
        moment = np.concatenate([np.zeros((len(d), 1)), np.cumsum(d * (weights * centers), axis=1)], axis=1)
        held = run[rows, end] - run[rows, start]
        peak = np.where(held > 0, (moment[rows, end] - moment[rows, start]) / np.where(held > 0, held, 1.0), centers[top])
        m = masses(d)
        cum = np.cumsum(m, axis=1)
        some = m > 0
        last = m.shape[1] - 1 - np.argmax(some[:, ::-1], axis=1) if len(d) else top
        k = np.minimum((cum < 0.5).sum(axis=1), last)
        below, own = np.where(k == last, 1.0 - m[rows, k], cum[rows, k] - m[rows, k]), m[rows, k]
        share = np.divide(0.5 - below, own, out=np.zeros(len(d)), where=own > 0).clip(0.0, 1.0)
        middle = nodes[k] + share * np.diff(nodes)[k]
        return np.stack([centers[top], peak, moment[:, -1], middle], axis=1)

    @F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("mode", "peak_mean", "mean", "median")]))
    def points(values: pa.Array, _: pa.Array) -> pa.Array:
        d, fits = _matrix(values, width)
        four = _sliced(d, found)
        return pa.StructArray.from_arrays([_values(four[:, k], fits) for k in range(4)], names=["mode", "peak_mean", "mean", "median"])

    return points(density, F.size(density))


def linear_pool(members: list[Column], weights: np.ndarray, width: int) -> Column:
    """The weighted mean of a row's arrays; NULL if a member is."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def pool(*values: pa.Array) -> pa.Array:
        rows, fits = _members(values[: len(weights)], width)
        return _lists(_sliced(rows[0], lambda *part: sum(w * m for w, m in zip(weights, part)), *rows[1:]), fits)

    return pool(*members, *[F.size(m) for m in members])


def geometric_pool(members: list[Column], weights: np.ndarray, widths: np.ndarray, floor: float) -> Column:
    """The exponentiated weighted mean of floored log densities, as masses up to a factor."""

    def pooled(*rows: np.ndarray) -> np.ndarray:
        logs = sum(w * np.log(m / widths + floor) for w, m in zip(weights, rows))
        return np.exp(logs - logs.max(axis=1, initial=-np.inf, keepdims=True)) * widths

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def pool(*values: pa.Array) -> pa.Array:
        rows, fits = _members(values[: len(weights)], len(widths))
        return _lists(_sliced(rows[0], pooled, *rows[1:]), fits)

    return pool(*members, *[F.size(m) for m in members])


def _members(values, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows that every member has, member by member."""
    found = [_matrix(v, width) for v in values]
    both = np.logical_and.reduce([fits for _, fits in found])
    return [m if fits.sum() == both.sum() else m[both[fits]] for m, fits in found], both


def mixed_masses(columns: list[Column], edges: list[np.ndarray], weights: list[float], union: np.ndarray, raw: bool = False) -> Column:
    """Masses between the ``union`` edges of a weighted mixture of rows of probabilities, each on edges of its own.

    The members' running sums are read at the union's edges and added up, in
    one pass over the rows. A row that lacks a member is NULL. With ``raw`` a
    member's rows are masses of any sum.
    """
    plans = []
    for own, weight in zip(edges, weights, strict=True):
        # Of edges that coincide the last: the mass at a point lies below the edge that ends it.
        k = np.clip(np.searchsorted(own, union, side="right") - 1, 0, len(own) - 2)
        wide = own[k + 1] - own[k]
        share = np.clip(np.divide(union - own[k], wide, out=np.ones(len(union)), where=wide > 0), 0.0, 1.0)
        share[union < own[0]] = 0.0
        # The last bucket that reaches into each piece of the union.
        plans.append((len(own) - 1, k, share, weight, np.where(share[1:] > 0, k[1:], k[1:] - 1)))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def mixed(*arrays: pa.Array) -> pa.Array:
        found = [_matrix(a, width) for a, (width, *_) in zip(arrays[::2], plans, strict=True)]
        fits = np.logical_and.reduce([f for _, f in found])
        total = np.zeros((int(fits.sum()), len(union) - 1))
        for (p, own), plan, e in zip(found, plans, edges, strict=True):
            total += _sliced(p if own.all() and fits.all() else p[fits[own]], lambda rows, plan=plan, wide=_wide(e): _pieces(_shares(rows, wide) if raw else rows, *plan[1:]))
        return _lists(total, fits)

    return mixed(*[c for column in columns for c in (column, F.size(column))])


def _pieces(p: np.ndarray, k: np.ndarray, share: np.ndarray, weight: float, last: np.ndarray) -> np.ndarray:
    """A member's weighted masses between the union's edges."""
    if len(k) == p.shape[1] + 1 and (k[:-1] == np.arange(len(k) - 1)).all() and not share[:-1].any() and share[-1] == 1.0:
        return weight * p  # the union's edges are the member's own
    cum = np.cumsum(p, axis=1)
    pieces = np.diff(cum[:, k] - p[:, k] * (1.0 - share), axis=1)
    # No rounding where no bucket with mass reaches: the support keeps its ends and its gaps.
    held = np.concatenate([np.zeros((len(p), 1), np.int64), np.cumsum(p > 0, axis=1)], axis=1)
    return weight * np.where(held[:, last + 1] > held[:, k[:-1]], np.maximum(pieces, 0.0), 0.0)
