"""Coverage simplification and blending of shapes that differ in their points."""

from __future__ import annotations

import heapq

import numpy as np

from . import planar as P


def thin(pts: np.ndarray, least: float) -> np.ndarray:
    """Visvalingam's method on an open line: the point whose triangle is smallest goes, while that is under ``least``; ends stay."""
    n = len(pts)
    if n < 3:
        return pts
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    cross = lambda u, v: abs(u[0] * v[1] - u[1] * v[0]) / 2
    size = lambda i: cross(pts[i] - pts[before[i]], pts[after[i]] - pts[before[i]]) if 0 < i < n - 1 else np.inf
    sizes = np.array([size(i) for i in range(n)])
    heap, alive = [(s, i) for i, s in enumerate(sizes)], np.ones(n, bool)
    heapq.heapify(heap)
    while heap:
        s, i = heapq.heappop(heap)
        if not alive[i] or s != sizes[i]:
            continue
        if s >= least:
            break
        alive[i] = False
        a, b = before[i], after[i]
        after[a], before[b] = b, a
        for k in (a, b):
            if 0 < k < n - 1:
                sizes[k] = max(size(k), s)  # what hides behind a small triangle isn't smaller
                heapq.heappush(heap, (sizes[k], k))
    return pts[alive]


def simplify_coverage(shapes: list[list[P.Ring]], tolerance: float, outer: bool = True, digits: int = 9) -> list[list[P.Ring]]:
    """Every border simplified once, whichever regions share it, so neighbours still fit.

    Rings are cut at nodes, the points where the set of regions along a border changes;
    each stretch between nodes is thinned in one direction only, and rings put together again.
    """
    owners: dict[tuple, set[int]] = {}
    key = lambda p: (round(float(p[0]), digits), round(float(p[1]), digits))
    rings = [[(part, sign, [key(p) for p in pts[:-1]]) for part, sign, pts in s] for s in shapes]
    for k, s in enumerate(rings):
        for _, _, ring in s:
            for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
                owners.setdefault((min(a, b), max(a, b)), set()).add(k)
    around: dict[tuple, set[frozenset]] = {}
    degree: dict[tuple, int] = {}
    for (a, b), who in owners.items():
        for p in (a, b):
            around.setdefault(p, set()).add(frozenset(who))
            degree[p] = degree.get(p, 0) + 1
    nodes = {p for p in degree if degree[p] != 2 or len(around[p]) > 1}
    done: dict[tuple, list[tuple]] = {}

    def stretch(line: list[tuple]) -> list[tuple]:
        back = line[::-1] < line
        way = line[::-1] if back else line
        if tuple(way) not in done:
            border = len(owners[(min(way[0], way[1]), max(way[0], way[1]))]) == 1
            done[tuple(way)] = way if border and not outer else [key(p) for p in thin(np.array(way), tolerance**2)]
        return done[tuple(way)][::-1] if back else done[tuple(way)]

    out = []
    for s in rings:
        held = []
        for part, sign, ring in s:
            at = [i for i, p in enumerate(ring) if p in nodes]
            if not at:  # a ring alone: its least point and the one farthest from it stay
                first = ring.index(min(ring))
                ring = ring[first:] + ring[:first]
                far = max(range(len(ring)), key=lambda i: (ring[i][0] - ring[0][0]) ** 2 + (ring[i][1] - ring[0][1]) ** 2)
                at = [0, far] if far else [0]
            else:
                ring = ring[at[0] :] + ring[: at[0]]
                at = [i - at[0] for i in at]
            line: list[tuple] = []
            for a, b in zip(at, at[1:] + [len(ring)], strict=True):
                line += stretch([*ring[a:b], ring[b % len(ring)]])[:-1]
            if len(line) >= 3:
                held.append((part, sign, np.array([*line, line[0]], float)))
        out.append(held)
    return out


def resample(pts: np.ndarray, n: int) -> np.ndarray:
    """A closed ring with ``n`` points: its own, and others on its edges, on the longest pieces first."""
    step = np.hypot(*np.diff(pts, axis=0).T)
    pieces = np.ones(len(step), int)
    heap = [(-s, e) for e, s in enumerate(step)]
    heapq.heapify(heap)
    for _ in range(n - len(pts)):
        _, e = heapq.heappop(heap)
        pieces[e] += 1
        heapq.heappush(heap, (-step[e] / pieces[e], e))
    out = [a + (b - a) * (np.arange(k) / k)[:, None] for a, b, k in zip(pts[:-1], pts[1:], pieces, strict=True)]
    return np.concatenate([*out, pts[-1:]])


def blend(a: list[P.Ring], b: list[P.Ring], t: float) -> list[P.Ring]:
    """A share ``t`` of the way between two shapes; rings are matched in order, those without a partner shrink to their centre."""
    out = []
    for sign in (1, -1):
        one, two = [x for x in a if x[1] == sign], [x for x in b if x[1] == sign]
        for k in range(max(len(one), len(two))):
            p, q = one[k] if k < len(one) else None, two[k] if k < len(two) else None
            part = (p or q)[0]
            if p is None or q is None:
                lone, share = (p[2], 1 - t) if q is None else (q[2], t)
                middle = lone[:-1].mean(0)
                if share > 0:
                    out.append((part, sign, middle + share * (lone - middle)))
                continue
            n = max(len(p[2]), len(q[2]))
            x, y = (v if len(v) == n else resample(v, n) for v in (p[2], q[2]))
            out.append((part, sign, x + t * (y - x)))
    return out


def spline(points: np.ndarray, n: int = 100) -> np.ndarray:
    """Natural cubic spline through points, by the share of their number along it."""
    m = len(points)
    if m < 3:
        return np.column_stack([np.interp(np.linspace(0, m - 1, n), np.arange(m), points[:, k]) for k in (0, 1)])
    system = np.diag(np.full(m, 4.0)) + np.diag(np.ones(m - 1), 1) + np.diag(np.ones(m - 1), -1)
    right = np.zeros((m, 2))
    right[1:-1] = 6 * (points[2:] - 2 * points[1:-1] + points[:-2])
    system[0], system[-1] = np.eye(m)[0], np.eye(m)[-1]
    bend = np.linalg.solve(system, right)
    at = np.linspace(0, m - 1, n)
    i = np.minimum(at.astype(int), m - 2)
    u, v = (at - i)[:, None], (1 - at + i)[:, None]
    return v * points[i] + u * points[i + 1] + ((v**3 - v) * bend[i] + (u**3 - u) * bend[i + 1]) / 6
