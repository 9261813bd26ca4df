"""Permutations of regions among cells that mend what the cells tore: groups, compactness, neighbours, directions."""

from __future__ import annotations

from collections import deque

import numpy as np


def links_of(n: int, pairs) -> list[set[int]]:
    out: list[set[int]] = [set() for _ in range(n)]
    for i, j in pairs:
        out[i].add(int(j))
        out[j].add(int(i))
    return out


def parts(cells: set[int], links: list[set[int]]) -> list[list[int]]:
    left, out = set(cells), []
    for seed in sorted(cells):
        if seed in left:
            left.discard(seed)
            held, queue = [seed], deque([seed])
            while queue:
                for k in sorted(links[queue.popleft()] & left):
                    left.discard(k)
                    held.append(k)
                    queue.append(k)
            out.append(held)
    return sorted(out, key=lambda p: (-len(p), p))


def satellites(groups: np.ndarray, links: list[set[int]]) -> list[int]:
    """Cells apart from the largest part of their group."""
    return [c for g in sorted(set(groups.tolist())) for p in parts(set(np.flatnonzero(groups == g).tolist()), links)[1:] for c in p]


def contiguity(slot: np.ndarray, groups: np.ndarray, links: list[set[int]], passes: int = 20) -> np.ndarray:
    """Regions change cells along shortest paths from a satellite to its group's main part, as long as satellites get fewer."""
    slot = slot.copy()
    for _ in range(passes):
        by_cell = np.empty(len(slot), int)
        by_cell[slot] = np.arange(len(slot))
        here = groups[by_cell]
        lone = satellites(here, links)
        if not lone:
            break
        best = None
        for cell in lone:
            main = set(parts(set(np.flatnonzero(here == here[cell]).tolist()), links)[0])
            came, queue, end = {cell: -1}, deque([cell]), None
            while queue and end is None:
                t = queue.popleft()
                for k in sorted(links[t]):
                    if k not in came:
                        came[k] = t
                        if k in main:
                            end = k
                            break
                        queue.append(k)
            if end is None:
                continue
            path = [end]
            while came[path[-1]] >= 0:
                path.append(came[path[-1]])
            # The satellite's region walks next to the main part; those on the way step back one cell.
            chain = path[1:][::-1]
            trial = by_cell.copy()
            trial[chain[:-1]], trial[chain[-1]] = by_cell[chain[1:]], by_cell[chain[0]]
            count = len(satellites(groups[trial], links))
            if count < len(lone) and (best is None or count < best[0]):
                best = (count, trial)
        if best is None:
            break
        slot[best[1]] = np.arange(len(slot))
    return slot


def _swaps(slot: np.ndarray, links: list[set[int]], passes: int, gain, groups: np.ndarray | None = None) -> np.ndarray:
    """Swap neighbouring cells' regions while that gains, best first; within groups, or where groups stay whole."""
    slot = slot.copy()
    for _ in range(passes):
        by_cell = np.empty(len(slot), int)
        by_cell[slot] = np.arange(len(slot))
        found = []
        for a in range(len(slot)):
            for b in links[a]:
                if a < b and (g := gain(slot, by_cell, a, b)) > 1e-12:
                    found.append((-g, a, b))
        locked: set[int] = set()
        moved = False
        base = len(satellites(groups[by_cell], links)) if groups is not None else 0
        for _, a, b in sorted(found):
            if a in locked or b in locked or gain(slot, by_cell, a, b) <= 1e-12:
                continue
            trial = by_cell.copy()
            trial[a], trial[b] = by_cell[b], by_cell[a]
            if groups is not None and groups[by_cell[a]] != groups[by_cell[b]] and len(satellites(groups[trial], links)) > base:
                continue
            by_cell = trial
            slot[by_cell] = np.arange(len(slot))
            locked |= {a, b}
            moved = True
        if not moved:
            break
    return slot


def adjacency(slot: np.ndarray, pairs, links: list[set[int]], passes: int = 3, groups=None) -> np.ndarray:
    """More of the map's neighbours next to each other."""
    near = links_of(len(slot), pairs)

    def kept(slot, i, at, other, place):
        return sum((place if k == other else slot[k]) in links[at] for k in near[i])

    def gain(slot, by_cell, a, b):
        i, j = by_cell[a], by_cell[b]
        return kept(slot, i, b, j, a) + kept(slot, j, a, i, b) - kept(slot, i, a, j, b) - kept(slot, j, b, i, a)

    return _swaps(slot, links, passes, gain, groups)


def orientation(slot: np.ndarray, places: np.ndarray, centers: np.ndarray, pairs, links: list[set[int]], passes: int = 3, groups=None) -> np.ndarray:
    """Neighbours more in their old directions, as long as no neighbourhood is lost."""
    near = links_of(len(slot), pairs)

    def score(slot, i, at, other, place):
        total, held = 0.0, 0
        for k in near[i]:
            p, q = places[k] - places[i], centers[place if k == other else slot[k]] - centers[at]
            size = np.hypot(*p) * np.hypot(*q)
            total += float(p @ q) / size if size > 0 else 0.0
            held += (place if k == other else slot[k]) in links[at]
        return total, held

    def gain(slot, by_cell, a, b):
        i, j = by_cell[a], by_cell[b]
        new, old = (score(slot, i, b, j, a), score(slot, j, a, i, b)), (score(slot, i, a, j, b), score(slot, j, b, i, a))
        if sum(x[1] for x in new) < sum(x[1] for x in old):
            return 0.0
        return sum(x[0] for x in new) - sum(x[0] for x in old)

    return _swaps(slot, links, passes, gain, groups)


def compactness(slot: np.ndarray, groups: np.ndarray, centers: np.ndarray, links: list[set[int]], passes: int = 10) -> np.ndarray:
    """Groups drawn together: swaps that lower the sum of squared distances to group centres."""

    def spread(where):
        return ((centers[where] - centers[where].mean(0)) ** 2).sum()

    def gain(slot, by_cell, a, b):
        g, h = groups[by_cell[a]], groups[by_cell[b]]
        if g == h:
            return 0.0
        here = groups[by_cell]
        one, two = np.flatnonzero(here == g), np.flatnonzero(here == h)
        return spread(one) + spread(two) - spread(np.append(one[one != a], b)) - spread(np.append(two[two != b], a))

    return _swaps(slot, links, passes, gain, groups)


def repair(n: int, cell_pairs, map_pairs, groups=None, places=None, centers=None, stages=None, passes: int = 3) -> np.ndarray:
    """Cell of each region after the wanted stages, in order; with groups contiguity and compactness, else neighbours and directions."""
    stages = stages or (("contiguity", "compactness") if groups is not None else ("adjacency", "orientation"))
    slot, links = np.arange(n), links_of(n, cell_pairs)
    for stage in ("contiguity", "compactness", "adjacency", "orientation"):
        if stage not in stages:
            continue
        if stage == "contiguity" and groups is not None:
            slot = contiguity(slot, groups, links, max(passes, 20))
        elif stage == "compactness" and groups is not None:
            slot = compactness(slot, groups, centers, links, passes)
        elif stage == "adjacency":
            slot = adjacency(slot, map_pairs, links, passes, groups)
        elif stage == "orientation":
            slot = orientation(slot, places, centers, map_pairs, links, passes, groups)
    return slot
