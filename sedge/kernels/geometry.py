"""Polygons as rings of points: areas, clipping to boxes, unions, points inside. numpy only."""

from __future__ import annotations

import numpy as np


def area(ring: np.ndarray) -> float:
    """Unsigned area of a ring, closed or not."""
    x, y = np.asarray(ring, float).T
    return float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)


def clip(ring: np.ndarray, west: float, south: float, east: float, north: float) -> np.ndarray:
    """The part of a ring inside a box, edge by edge; may touch itself along the box where the ring is not convex."""
    pts = [tuple(p) for p in np.asarray(ring, float)]
    for axis, bound, sign in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
        out = []
        for a, b in zip(pts, pts[1:] + pts[:1], strict=True):
            ina, inb = sign * (a[axis] - bound) >= 0, sign * (b[axis] - bound) >= 0
            if ina:
                out.append(a)
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        pts = out
        if not pts:
            break
    return np.array(pts).reshape(-1, 2)


def inside(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points are inside, by the parity of edges to their right."""
    ring = np.asarray(ring, float)
    x, y = np.atleast_1d(np.asarray(x, float)), np.atleast_1d(np.asarray(y, float))
    x1, y1 = ring.T
    x2, y2 = np.roll(ring, -1, axis=0).T
    straddles = (y1 > y[:, None]) != (y2 > y[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x1 + (y[:, None] - y1) * (x2 - x1) / (y2 - y1)
    return (straddles & (x[:, None] < at)).sum(1) % 2 == 1


def union_area(rings: list[np.ndarray]) -> float:
    """Area covered by any ring, each counted once: between neighbouring heights of vertices and crossings the covered width is linear."""
    edges = []
    for k, r in enumerate(rings):
        r = np.asarray(r, float)
        for a, b in zip(r, np.roll(r, -1, axis=0), strict=True):
            if a[1] != b[1]:
                edges.append((*a, *b, k) if a[1] < b[1] else (*b, *a, k))
    if not edges:
        return 0.0
    e = np.array(edges)
    cuts = set(e[:, 1]) | set(e[:, 3])
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    for i in range(len(e)):
        with np.errstate(divide="ignore", invalid="ignore"):
            det = dx[i] * dy - dy[i] * dx
            t = ((e[:, 0] - e[i, 0]) * dy - (e[:, 1] - e[i, 1]) * dx) / det
            u = ((e[:, 0] - e[i, 0]) * dy[i] - (e[:, 1] - e[i, 1]) * dx[i]) / det
        ok = (det != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        cuts |= set((e[i, 1] + t[ok] * dy[i]).tolist())
    heights, total = sorted(cuts), 0.0
    for lo, hi in zip(heights, heights[1:], strict=False):
        mid = (lo + hi) / 2
        live = e[(e[:, 1] <= lo) & (e[:, 3] >= hi)]
        x = live[:, 0] + (mid - live[:, 1]) * (live[:, 2] - live[:, 0]) / (live[:, 3] - live[:, 1])
        spans = []
        for k in np.unique(live[:, 4]):
            xs = np.sort(x[live[:, 4] == k])
            spans += list(zip(xs[::2], xs[1::2], strict=False))
        width, end = 0.0, -np.inf
        for a, b in sorted(spans):
            if b > end:
                width += b - max(a, end)
                end = b
        total += width * (hi - lo)
    return float(total)
