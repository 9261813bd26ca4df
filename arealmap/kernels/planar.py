"""Polygons as lists of (part, sign, points); points are closed rings."""

from __future__ import annotations

import math

import numpy as np

Ring = tuple[int, int, np.ndarray]


def rings_of(geom: dict | None) -> list[Ring]:
    if not geom:
        return []
    return [(x["part"], x["sign"], np.array([(p["x"], p["y"]) for p in x["pts"]], float).reshape(-1, 2)) for x in geom["rings"]]


def to_geom(rings: list[Ring], kind: str | None = None) -> dict:
    kind = kind or ("MultiPolygon" if len({p for p, _, _ in rings}) > 1 else "Polygon")
    return {"kind": kind, "rings": [{"part": int(p), "sign": int(s), "pts": [{"x": float(x), "y": float(y)} for x, y in pts]} for p, s, pts in rings]}


def ring_area(pts: np.ndarray) -> float:
    if len(pts) < 3:
        return 0.0
    x, y = pts[:, 0] - pts[0, 0], pts[:, 1] - pts[0, 1]
    return abs(float(x @ np.roll(y, -1) - np.roll(x, -1) @ y)) / 2


def area(rings: list[Ring]) -> float:
    return sum(s * ring_area(p) for _, s, p in rings)


def centroid(rings: list[Ring]) -> np.ndarray:
    top, whole = np.zeros(2), 0.0
    for _, s, p in rings:
        q = np.roll(p, -1, axis=0)
        cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
        twice = cross.sum()
        if twice:
            top += s * np.sign(twice) * ((p + q) * cross[:, None]).sum(0) / 6
            whole += s * abs(twice) / 2
    if whole:
        return top / whole
    return np.concatenate([p for _, _, p in rings]).mean(0) if rings else np.zeros(2)


def bounds(rings: list[Ring]) -> tuple[float, float, float, float]:
    pts = np.concatenate([p for _, _, p in rings])
    return (*pts.min(0), *pts.max(0))


def edges(rings: list[Ring]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([p[:-1] for _, _, p in rings]), np.concatenate([p[1:] for _, _, p in rings])


def contains(rings: list[Ring], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings; holes need no special care."""
    inside = np.zeros(np.broadcast(x, y).shape, bool)
    for _, _, p in rings:
        for (x0, y0), (x1, y1) in zip(p[:-1], p[1:], strict=True):
            if y0 != y1:
                inside ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return inside


def clip(rings: list[Ring], a: float, b: float, c: float) -> list[Ring]:
    """What lies in a x + b y <= c.  Concave rings may keep edges along the cut, which add no area."""
    out = []
    for part, sign, p in rings:
        d = a * p[:, 0] + b * p[:, 1] - c
        if (d <= 1e-15).all():
            out.append((part, sign, p))
            continue
        kept: list[np.ndarray] = []
        for i in range(len(p) - 1):
            if d[i] <= 0:
                kept.append(p[i])
            if (d[i] < 0 < d[i + 1]) or (d[i + 1] < 0 < d[i]):
                kept.append(p[i] + (p[i + 1] - p[i]) * (d[i] / (d[i] - d[i + 1])))
        if len(kept) >= 3:
            ring = np.array([*kept, kept[0]])
            if ring_area(ring) > 0:
                out.append((part, sign, ring))
    return out if any(s > 0 for _, s, _ in out) else []


def nearest_on(rings: list[Ring], pts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest boundary points, and their distances."""
    a, b = edges(rings)
    d = b - a
    size = np.maximum((d * d).sum(1), 1e-300)
    t = np.clip(((pts[:, None] - a) * d).sum(2) / size, 0, 1)
    q = a + t[..., None] * d
    far = ((pts[:, None] - q) ** 2).sum(2)
    k = far.argmin(1)
    i = np.arange(len(pts))
    return q[i, k], np.sqrt(far[i, k])


def _within(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, r: float) -> tuple[float, float] | None:
    """The stretch of p-q, as shares of it, within r of a-b: a capsule is convex, so it is one stretch."""
    d, found = q - p, []
    size = float(d @ d)
    if not size:
        return None
    for c in (a, b):  # the ends' discs
        f = p - c
        m, k = float(f @ d) / size, (float(f @ f) - r * r) / size
        if (root := m * m - k) >= 0:
            found += [-m - math.sqrt(root), -m + math.sqrt(root)]
    e = b - a
    length = float(np.hypot(*e))
    if length:
        e = e / length
        n, lo, hi = np.array([-e[1], e[0]]), -math.inf, math.inf
        for v, low, high in ((e, 0.0, length), (n, -r, r)):
            at, by = float((p - a) @ v), float(d @ v)
            if abs(by) < 1e-300:
                if not low - 1e-12 <= at <= high + 1e-12:
                    lo, hi = 1.0, -1.0
            else:
                t0, t1 = sorted(((low - at) / by, (high - at) / by))
                lo, hi = max(lo, t0), min(hi, t1)
        if lo <= hi:
            found += [lo, hi]
    if not found:
        return None
    lo, hi = max(0.0, min(found)), min(1.0, max(found))
    return (lo, hi) if lo < hi else None


def boundary_within(ga: dict, gb: dict, r: float) -> float:
    """Length of a's boundary inside b grown by r."""
    ra, rb = rings_of(ga), rings_of(gb)
    if not ra or not rb:
        return 0.0
    b0, b1 = edges(rb)
    total = 0.0
    for p, q in zip(*edges(ra), strict=True):
        near = (np.minimum(b0, b1) - r <= np.maximum(p, q)).all(1) & (np.maximum(b0, b1) + r >= np.minimum(p, q)).all(1)
        spans = sorted(x for i in np.flatnonzero(near) if (x := _within(p, q, b0[i], b1[i], r)))
        # Between the stretches near b's boundary the segment is all inside b or all outside.
        at, length = 0.0, float(np.hypot(*(q - p)))
        for lo, hi in [*spans, (1.0, 1.0)]:
            if lo > at:
                mid = p + (q - p) * (at + lo) / 2
                if contains(rb, mid[:1], mid[1:])[0]:
                    total += (lo - at) * length
                at = lo
            if hi > at:
                total += (hi - at) * length
                at = hi
    return total


def is_convex(p: np.ndarray) -> bool:
    d = np.diff(p, axis=0)
    d = d[np.hypot(d[:, 0], d[:, 1]) > 0]
    n = np.roll(d, -1, axis=0)
    cross = d[:, 0] * n[:, 1] - d[:, 1] * n[:, 0]
    return bool((cross >= -1e-12).all() or (cross <= 1e-12).all())


def hull(pts: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise and closed."""
    pts = np.unique(pts, axis=0)
    if len(pts) < 3:
        return np.concatenate([pts, pts[:1]])

    def half(seq):
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(half(pts) + half(pts[::-1]))
    return np.concatenate([ring, ring[:1]])


def crossing_segments(rings: list[Ring]) -> bool:
    """Whether any two edges that aren't neighbours cross or touch."""
    a, b = edges(rings)
    of = np.concatenate([np.full(len(p) - 1, i) for i, (_, _, p) in enumerate(rings)])
    at = np.concatenate([np.arange(len(p) - 1) for _, _, p in rings])
    last = np.concatenate([np.full(len(p) - 1, len(p) - 2) for _, _, p in rings])
    i, j = np.triu_indices(len(a), 1)
    near = (of[i] == of[j]) & ((np.abs(at[i] - at[j]) <= 1) | (np.abs(at[i] - at[j]) == last[i]))
    i, j = i[~near], j[~near]
    turn = lambda p, q, s: (q[:, 0] - p[:, 0]) * (s[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (s[:, 0] - p[:, 0])
    return bool(((turn(a[i], b[i], a[j]) * turn(a[i], b[i], b[j]) < 0) & (turn(a[j], b[j], a[i]) * turn(a[j], b[j], b[i]) < 0)).any())
