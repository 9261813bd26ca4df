"""Regions cut into parts of wanted areas, shrunk in shells, and filled with dots."""

from __future__ import annotations

import numpy as np

from . import planar as P

AXES = {"vertical": (1.0, 0.0), "horizontal": (0.0, 1.0)}
OTHER = {"vertical": "horizontal", "horizontal": "vertical"}


def cut(rings: list[P.Ring], share: float, direction: str = "vertical") -> tuple[list[P.Ring], list[P.Ring]]:
    """Left (or lower) part with ``share`` of the area, and the rest; shares stay between a thousandth and the rest of it."""
    if direction not in AXES:
        raise ValueError(f"direction must be one of {tuple(AXES)}")
    if share <= 1e-9:
        return [], rings
    if share >= 1 - 1e-9:
        return rings, []
    share = min(max(share, 0.001), 0.999)
    a, b = AXES[direction]
    x0, y0, x1, y1 = P.bounds(rings)
    lo, hi = (x0, x1) if a else (y0, y1)
    goal = share * P.area(rings)
    for _ in range(60):
        mid = (lo + hi) / 2
        if P.area(P.clip(rings, a, b, mid)) < goal:
            lo = mid
        else:
            hi = mid
    at = (lo + hi) / 2
    return P.clip(rings, a, b, at), P.clip(rings, -a, -b, -at)


def balanced(shares: list[float]) -> int:
    """Items of the first of two groups whose sums come closest; the first such split counts."""
    sums = np.cumsum(shares)
    return int(np.argmin(np.abs(sums[:-1] - sums[-1] / 2))) + 1


def split(rings: list[P.Ring], shares: list[float] | float, direction: str = "vertical", alternate: bool = True, strategy: str = "sequential", reference: list[float] | None = None) -> list[list[P.Ring]]:
    """One part for each share; a single number gives two parts.

    Sequential cuts take each share off what is left, along alternating axes if asked.  A
    treemap halves the list again and again, by ``reference`` where one fixes the tree.
    """
    if isinstance(shares, int | float):
        shares = [float(shares), 1 - float(shares)]
    if strategy == "treemap":
        return _treemap(rings, list(shares), direction, list(reference or shares))
    if strategy != "sequential":
        raise ValueError("strategy is sequential or treemap")
    out, left, rest = [], rings, sum(shares)
    for k, share in enumerate(shares):
        if k == len(shares) - 1:
            out.append(left)
        else:
            part, left = cut(left, share / rest if rest > 0 else 0.0, direction) if left else ([], [])
            out.append(part)
            rest -= share
            direction = OTHER[direction] if alternate else direction
    return out


def _treemap(rings: list[P.Ring], shares: list[float], direction: str, reference: list[float]) -> list[list[P.Ring]]:
    if len(shares) == 1:
        return [rings]
    k = balanced(reference)
    whole = sum(shares)
    one, two = cut(rings, sum(shares[:k]) / whole, direction) if rings and whole > 0 else ([], [])
    turned = OTHER[direction]
    return _treemap(one, shares[:k], turned, reference[:k]) + _treemap(two, shares[k:], turned, reference[k:])


def inset(rings: list[P.Ring], d: float, cells: int = 128) -> list[P.Ring]:
    """Points farther than ``d`` from the boundary: exact for convex regions without holes, else rows of a raster."""
    if d <= 0:
        return rings
    if len(rings) == 1 and P.is_convex(rings[0][2]):
        out, p = rings, rings[0][2]
        inner = P.centroid(rings)
        for a, b in zip(p[:-1], p[1:], strict=True):
            n = np.array([b[1] - a[1], a[0] - b[0]])
            if not (size := np.hypot(*n)):
                continue
            n = n / size
            n = n if n @ (inner - a) < 0 else -n
            out = P.clip(out, n[0], n[1], float(n @ a) - d) if out else []
        return out
    x0, y0, x1, y1 = P.bounds(rings)
    step = max(x1 - x0, y1 - y0) / cells
    xs, ys = np.arange(x0 + step / 2, x1, step), np.arange(y0 + step / 2, y1, step)
    gx, gy = np.meshgrid(xs, ys)
    pts = np.column_stack([gx.ravel(), gy.ravel()])
    kept = P.contains(rings, pts[:, 0], pts[:, 1])
    kept[kept] = P.nearest_on(rings, pts[kept])[1] > d
    rows, out = kept.reshape(gx.shape), []
    for k, row in enumerate(rows):
        turns = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(int), [0]])))
        for a, b in zip(turns[::2], turns[1::2], strict=True):
            lo, hi, y = x0 + a * step, x0 + b * step, ys[k]
            out.append((len(out), 1, np.array([(lo, y - step / 2), (hi, y - step / 2), (hi, y + step / 2), (lo, y + step / 2), (lo, y - step / 2)])))
    return out


def core(rings: list[P.Ring], share: float, tol: float = 0.05) -> list[P.Ring]:
    """The inset with ``share`` of the area; ``tol`` is relative to the distance."""
    share = min(max(share, 0.001), 0.999)
    x0, y0, x1, y1 = P.bounds(rings)
    lo, hi, goal = 0.0, min(x1 - x0, y1 - y0) / 2, share * P.area(rings)
    for _ in range(60):
        mid = (lo + hi) / 2
        if P.area(inset(rings, mid)) > goal:
            lo = mid
        else:
            hi = mid
        if hi - lo <= tol * hi:
            break
    return inset(rings, (lo + hi) / 2)


def without(outer: list[P.Ring], inner: list[P.Ring]) -> list[P.Ring]:
    """A shell: the outer region with the inner one as holes of it."""
    return outer + [(outer[0][0], -s, p) for _, s, p in inner] if outer else []


def shrink(rings: list[P.Ring], shares: list[float] | float, mode: str = "area", tol: float = 0.05) -> list[list[P.Ring]]:
    """Concentric parts, innermost first; ``shell`` takes shares of width, so squares them."""
    if mode not in ("area", "shell"):
        raise ValueError("mode is area or shell")
    if isinstance(shares, int | float):
        shares = [float(shares), 1 - float(shares)]
    whole = sum(shares)
    if whole <= 0:
        raise ValueError("shares must not all be zero")
    shares = [x / whole for x in shares]
    out, left, rest = [], rings, 1.0
    for share in reversed(shares[1:]):  # outermost shell first
        if share < 1e-9 or not left:
            out.append([])
            continue
        ratio = min(max((rest - share) / rest, 0.001), 0.999)
        inner = core(left, ratio**2 if mode == "shell" else ratio, tol)
        out.append(without(left, inner))
        left, rest = inner, rest - share
    return [left if shares[0] >= 1e-9 else [], *reversed(out)]


def parts(rings: list[P.Ring], shares: list[float], method: str = "split", **options) -> list[list[P.Ring]]:
    """Parts by either method; what can't be cut is the first part whole."""
    try:
        if not rings or P.area(rings) <= 0:
            raise ValueError("no area")
        return shrink(rings, shares, **options) if method == "shrink" else split(rings, shares, **options)
    except (ValueError, ZeroDivisionError, FloatingPointError):
        return [rings] + [[] for _ in shares[1:]]


def dots(rings: list[P.Ring], n: int, seed: int, rounds: int = 200) -> np.ndarray:
    """``n`` uniform points inside, by rejection; a region without area gives none."""
    if n <= 0 or not rings or P.area(rings) <= 0:
        return np.empty((0, 2))
    rng, out, found = np.random.default_rng(seed), [], 0
    x0, y0, x1, y1 = P.bounds(rings)
    for _ in range(rounds):
        pts = rng.uniform((x0, y0), (x1, y1), (max(4 * n, 100), 2))
        pts = pts[P.contains(rings, pts[:, 0], pts[:, 1])]
        out.append(pts)
        found += len(pts)
        if found >= n:
            break
    return np.concatenate(out)[:n]
