"""Length patterns and how often to use each: non-negative least squares over a histogram of lengths.

Works on the histogram alone (a count for each length up to the sequence length), so its size and time do not
depend on the number of documents.
"""

from __future__ import annotations

import numpy as np

#: Steps of the projected gradient method.
STEPS = 300


def patterns(histogram: np.ndarray) -> np.ndarray:
    """All ways to fill a sequence exactly with one, two or three of the lengths that occur: rows of three lengths, 0 for none."""
    full = histogram.size - 1
    has = np.flatnonzero(histogram)
    has = has[has > 0]
    rows = [np.array([[0, 0, full]])] if histogram[full] else []
    two = has[(2 * has <= full) & (histogram[full - has] > 0)]
    rows.append(np.stack([np.zeros_like(two), two, full - two], 1))
    small = has[3 * has <= full]
    a, b = (x.ravel() for x in np.meshgrid(small, has, indexing="ij"))
    c = full - a - b
    ok = (b >= a) & (c >= b)
    ok[ok] = histogram[c[ok]] > 0
    rows.append(np.stack([a[ok], b[ok], c[ok]], 1))
    return np.concatenate(rows)


def fit(histogram: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts x of the patterns that minimise the squared error of their lengths against the
    histogram, each length weighted by its tokens: long documents are the hard ones to place. Accelerated projected
    gradients, with steps scaled by how many patterns share a length."""
    size = histogram.size
    weight = np.arange(size, dtype=float) / (size - 1)
    weight[0] = 0
    target = histogram.astype(float)
    used = np.bincount(rows.ravel(), minlength=size)
    scale = np.maximum(1e-12, 3 * (weight * used)[rows].max(1))
    x = np.zeros(len(rows))
    y, t = x, 1.0
    for _ in range(STEPS):
        made = np.bincount(rows.ravel(), np.repeat(y, 3), size)
        new = np.maximum(0, y - (weight * (made - target))[rows].sum(1) / scale)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def rounded(histogram: np.ndarray, rows: np.ndarray, x: np.ndarray) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Whole repeat counts, those of the largest fit first, and what is left of the histogram. A pattern fills a sequence
    exactly, so one that the fit uses at all is taken once at least, as far as what is left covers it: where many lengths
    are rare, the fit spreads a document over many patterns and rounding down would take none of them."""
    left, out = histogram.tolist(), []
    order = np.argsort(-x, kind="stable")
    order = order[x[order] > 0]
    for lengths, wish in zip(rows[order].tolist(), np.maximum(1, np.floor(x[order] + 0.5)).astype(np.int64).tolist()):
        need = {v: lengths.count(v) for v in lengths if v}
        n = min(wish, *(left[v] // m for v, m in need.items()))
        if n > 0:
            out.append((need, n))
            for v, m in need.items():
                left[v] -= n * m
    return out, np.array(left, np.int64)


def best_fit(left: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Packs what is left, longest first, each into the fullest sequences that still have room; like sequences are
    handled together, so time depends on how many kinds there are."""
    full = left.size - 1
    room: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(full + 1)]
    open_at = np.zeros(full + 1, bool)
    for length in range(full, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(open_at[length:])
            if fits.size:
                space = int(fits[0]) + length
                kind, count = room[space].pop()
                open_at[space] = bool(room[space])
                # as many of this length per sequence as fit, but no fewer sequences than documents allow
                each = min(space // length, n)
                take = min(count, n // each)
            else:
                space, kind, count = full, {}, 1 << 62
                each = min(full // length, n)
                take = n // each
            if count > take and fits.size:
                room[space].append((kind, count - take))
                open_at[space] = True
            after = space - each * length
            room[after].append((kind | {length: kind.get(length, 0) + each}, take))
            open_at[after] = True
            n -= each * take
        open_at[0] = False
    return [kind for kinds in room for kind in kinds]


def plan(histogram: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """(length -> how many of it, repeats): sequences for all documents. ``histogram[n]`` counts length n; the last is full."""
    rows = patterns(histogram)
    fitted, left = rounded(histogram, rows, fit(histogram, rows)) if len(rows) else ([], histogram.copy())
    return fitted + best_fit(left)
