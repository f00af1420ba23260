"""Slow numpy re-derivations, one row at a time, used as an independent check."""

import numpy as np


def probs(masses, edges):
    masses, w = np.asarray(masses, float), np.diff(edges)
    if masses.sum() > 0:
        return masses / masses.sum()
    wide = (w > 0).astype(float) if (w > 0).any() else np.ones(len(w))
    return wide / wide.sum()


def hist_cdf(p, edges, x, left=False):
    """P(Y <= x), or P(Y < x)."""
    out = 0.0
    for q, a, b in zip(p, edges[:-1], edges[1:]):
        if b > a:
            out += q * min(max((x - a) / (b - a), 0.0), 1.0)
        elif (a < x) if left else (a <= x):
            out += q
    return out


def hist_masses(p, edges, target):
    f = [hist_cdf(p, edges, t, left=True) for t in target[:-1]] + [hist_cdf(p, edges, target[-1])]
    return np.diff(f), f[0] + 1 - f[-1]


def hist_ppf(p, edges, level):
    held = [i for i, q in enumerate(p) if q > 0]
    if level <= 0:
        return edges[held[0]]
    if level >= 1:
        return edges[held[-1] + 1]
    below = 0.0
    for i in held:
        if below + p[i] >= level or i == held[-1]:
            return edges[i] + min(max((level - below) / p[i], 0), 1) * (edges[i + 1] - edges[i])
        below += p[i]


def knots(q, v):
    v = np.maximum.accumulate(np.asarray(v, float))
    gaps = [g for g in np.diff(v) if g > 0]
    lo, hi = (gaps[0], gaps[-1]) if gaps else (0.0, 0.0)
    levels, values = list(q), list(v)
    if q[0] > 0:
        levels, values = [0.0] + levels, [v[0] - lo] + values
    if q[-1] < 1:
        levels, values = levels + [1.0], values + [v[-1] + hi]
    return np.array(levels), np.array(values)


def pieces(levels, values):
    """The knots as a histogram: per-row buckets, shared masses."""
    return np.diff(levels), values


def node_weights(edges, histogram):
    c = 0.5 * (edges[1:] + edges[:-1])
    if histogram:
        return np.diff(edges)
    w = np.zeros(len(c))
    w[:-1] += 0.5 * np.diff(c)
    w[1:] += 0.5 * np.diff(c)
    return w


def normalize(pdf, edges, histogram):
    d = np.where(np.isfinite(pdf), np.clip(pdf, 0, None), 0.0)
    w = node_weights(edges, histogram)
    return d / (d @ w) if d @ w > 0 else np.full(len(d), 1 / w.sum())


def grid_masses(d, edges, histogram):
    c = 0.5 * (edges[1:] + edges[:-1])
    if histogram:
        return d * np.diff(edges), edges
    return 0.5 * (d[1:] + d[:-1]) * np.diff(c), c


def crps(masses, nodes, y, steps=4000):
    """Numerical integration of (F - step)^2 on a fine mesh that holds every corner."""
    lo, hi = min(nodes[0], y), max(nodes[-1], y)
    x = np.unique(np.concatenate([np.linspace(lo, hi, steps), nodes, [y]]))
    f = np.interp(x, nodes, np.concatenate([[0], np.cumsum(masses)]))
    out = 0.0
    for a, b, fa, fb in zip(x[:-1], x[1:], f[:-1], f[1:]):
        s = 1.0 if a >= y else 0.0
        u, v = fa - s, fb - s
        out += (b - a) * (u * u + u * v + v * v) / 3
    return out


def peak_mean(d, edges, histogram, frac=0.05):
    c = 0.5 * (edges[1:] + edges[:-1])
    k = int(np.argmax(d))
    i, j = k, k
    while i > 0 and d[i - 1] >= frac * d[k]:
        i -= 1
    while j < len(d) - 1 and d[j + 1] >= frac * d[k]:
        j += 1
    w = node_weights(edges, histogram)
    m = d[i:j + 1] * w[i:j + 1]
    return (m @ c[i:j + 1]) / m.sum() if m.sum() > 0 else c[k]


def peaks(d, share=0.1):
    top, n, out = max(d), len(d), 0
    i = 1
    while i < n - 1:
        j = i
        while j + 1 < n and d[j + 1] == d[i]:
            j += 1
        if j < n - 1 and d[i - 1] < d[i] and d[j + 1] < d[i]:
            left, right = [], []
            for k in range(i - 1, -1, -1):
                if d[k] > d[i]:
                    break
                left.append(d[k])
            for k in range(j + 1, n):
                if d[k] > d[i]:
                    break
                right.append(d[k])
            prominence = d[i] - max(min(left + [d[i]]), min(right + [d[i]]))
            if d[i] >= share * top and prominence >= share * top:
                out += 1
        i = j + 1
    return out
