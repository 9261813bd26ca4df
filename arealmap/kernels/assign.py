"""Regions put on tiles: least-cost assignment, and repairs of what it leaves."""

from __future__ import annotations

from collections import deque

import numpy as np


def least_cost(cost: np.ndarray) -> np.ndarray:
    """Column of each row of a least-cost assignment; rows enter one by one along shortest augmenting paths."""
    n, m = cost.shape
    if n > m:
        raise ValueError("more regions than tiles")
    row_of, u, v = np.full(m, -1), np.zeros(n), np.zeros(m)
    for start in range(n):
        best, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, at, base = start, -1, 0.0
        while True:
            reach = base + cost[row] - u[row] - v
            better = ~done & (reach < best)
            best[better], came[better] = reach[better], at
            at = int(np.where(done, np.inf, best).argmin())
            done[at], base = True, best[at]
            if row_of[at] < 0:
                break
            row = row_of[at]
        seen = np.flatnonzero(done)
        seen = seen[seen != at]
        u[row_of[seen]] += base - best[seen]
        u[start] += base
        v[seen] -= base - best[seen]
        while at >= 0:
            back = came[at]
            row_of[at] = start if back < 0 else row_of[back]
            at = back
    out = np.empty(n, np.int64)
    taken = np.flatnonzero(row_of >= 0)
    out[row_of[taken]] = taken
    return out


def hops(edges: np.ndarray) -> np.ndarray:
    """Numbers of steps between all tiles; what can't be reached is as far as there are tiles."""
    m = len(edges)
    out, front, seen = np.full((m, m), m), np.eye(m, dtype=bool), np.eye(m, dtype=bool)
    step, links = 0, edges.astype(np.float32)
    while front.any():
        out[front] = step
        front = (front.astype(np.float32) @ links > 0) & ~seen
        seen |= front
        step += 1
    return out


def to_tiles(centroids, tiles, adjacency=None, edges=None, corners=None, origin_weight=1.0, neighbor_weight=0.3, topology_weight=0.0, compactness=0.0, rounds=10) -> np.ndarray:
    """Tile of each region: near its place, next to its neighbours, in their directions, near the middle.

    The first assignment knows only places; each round then costs tiles by where the neighbours
    are now, until nothing moves.
    """
    n, m = len(centroids), len(tiles)
    scaled = lambda c: c / c.max() if c.max() > 0 else c
    origin = scaled(((centroids[:, None] - tiles) ** 2).sum(2))
    middle = scaled(np.broadcast_to(((tiles - centroids.mean(0)) ** 2).sum(1), (n, m)).copy())
    if adjacency is None or (neighbor_weight <= 0 and topology_weight <= 0):
        return least_cost(origin_weight * origin + compactness * middle)
    near = np.array(adjacency, float)
    np.fill_diagonal(near, 0)
    found = least_cost(max(origin_weight, 1.0) * origin + compactness * middle)
    penalty = None
    if neighbor_weight > 0:
        penalty = np.ones((m, m)) if edges is None else np.maximum(hops(edges) - 1.0, 0) ** 2
        if corners is not None:
            penalty[corners] = 0.2
        if edges is not None:
            penalty[edges] = 0.0
        np.fill_diagonal(penalty, 0)
    i, j = np.nonzero(near)
    turn = np.arctan2(*(centroids[j] - centroids[i]).T[::-1])
    for _ in range(rounds):
        cost = origin_weight * origin + compactness * middle
        if penalty is not None:
            cost = cost + neighbor_weight * (near @ penalty[:, found].T)
            if edges is not None:
                stranger = (near <= 0).astype(float)
                np.fill_diagonal(stranger, 0)
                cost = cost + neighbor_weight * (stranger @ edges[:, found].T.astype(float))
        if topology_weight > 0:
            v = tiles[found[j]][:, None] - tiles
            off = np.abs(turn[:, None] - np.arctan2(v[..., 1], v[..., 0]))
            off = np.minimum(off, 2 * np.pi - off) / np.pi
            off[np.hypot(v[..., 0], v[..., 1]) < 1e-12] = 1.0
            angles = np.zeros((n, m))
            np.add.at(angles, i, near[i, j][:, None] * off)
            cost = cost + topology_weight * scaled(angles)
        again = least_cost(cost)
        if (again == found).all():
            break
        found = again
    return found


def _components(members: set[int], links: list[list[int]]) -> list[list[int]]:
    out, left = [], set(members)
    for seed in sorted(members):
        if seed in left:
            left.discard(seed)
            held, queue = [], deque([seed])
            while queue:
                t = queue.popleft()
                held.append(t)
                for k in links[t]:
                    if k in left:
                        left.discard(k)
                        queue.append(k)
            out.append(held)
    return out


def holes(found: np.ndarray, edges: np.ndarray) -> list[list[int]]:
    """Groups of free tiles that aren't open to the border, small ones first."""
    links = [np.flatnonzero(x).tolist() for x in edges]
    free = set(range(len(edges))) - set(found.tolist())
    most = max(map(len, links), default=0)
    return sorted((c for c in _components(free, links) if all(len(links[t]) == most for t in c)), key=lambda c: (len(c), c))


def fill_holes(found: np.ndarray, edges: np.ndarray, real_holes: int = 0) -> np.ndarray:
    """Shift regions along shortest chains into enclosed free tiles, beyond as many holes as the map itself has."""
    found, links = found.copy(), [np.flatnonzero(x).tolist() for x in edges]
    most = max(map(len, links), default=0)
    for _ in range(len(found)):
        inner = holes(found, edges)
        if len(inner) <= real_holes:
            return found
        closed = {t for c in inner for t in c}
        region = {int(t): k for k, t in enumerate(found)}
        moved = False
        for hole in (t for c in inner[: len(inner) - real_holes] for t in c):
            came, queue, end = {hole: -1}, deque([hole]), -1
            while queue and end < 0:
                t = queue.popleft()
                for k in links[t]:
                    if k in came or k in closed:
                        continue
                    if k in region:
                        came[k] = t
                        queue.append(k)
                        if len(links[k]) < most:
                            end = k
                            break
                    elif t != hole:  # open ground next to an occupied tile
                        end = t
                        break
            if end < 0:
                continue
            chain = [end]
            while came[chain[-1]] >= 0:
                chain.append(came[chain[-1]])
            # From the hole outwards each region moves one tile inwards.
            chain = chain[::-1]
            for into, out in zip(chain[:-1], chain[1:], strict=True):
                found[region[out]] = into
            moved = True
            break
        if not moved:
            return found
    return found


def join_islands(found: np.ndarray, edges: np.ndarray, tiles: np.ndarray, adjacency: np.ndarray) -> np.ndarray:
    """Regions cut off from the mainland on tiles, though not on the map, move to the free tile next to a neighbour that is nearest."""
    found, links = found.copy(), [np.flatnonzero(x).tolist() for x in edges]
    land = _components(set(range(len(found))), [np.flatnonzero(x > 0).tolist() for x in (adjacency + adjacency.T)])
    for mainland in land:
        members = set(mainland)
        for _ in range(len(mainland)):
            at = {int(found[k]): k for k in members}
            parts = sorted(_components(set(at), links), key=len, reverse=True)
            if len(parts) <= 1:
                break
            main, moved = set(parts[0]), False
            for part in parts[1:]:
                for t in part:
                    k = at[t]
                    goals = {int(found[x]) for x in members if adjacency[k, x] > 0 or adjacency[x, k] > 0} & main or main
                    free = {y for g in goals for y in links[g]} - set(found.tolist())
                    if free:
                        found[k] = min(free, key=lambda y: (float(((tiles[y] - tiles[t]) ** 2).sum()), y))
                        moved = True
                        break
                if moved:
                    break
            if not moved:
                break
    return found
