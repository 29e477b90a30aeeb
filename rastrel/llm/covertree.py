"""A cover tree over a bounded block of unit vectors, and the dual traversal of two of them (numpy only).

Levels are nested and their radii halve. A tree is built once and kept as an order of its points with marks
where nodes begin. Every node of a level lies within that level's radius of its
parent; nodes of a level are further than its radius from each other inside one parent. A pair of
nodes is dropped when even their nearest points, by the covering radii, are further apart than the
threshold. What is left at the bottom is compared exactly.
"""

from __future__ import annotations

import numpy as np

#: Radii of the levels in a block, as distances on the unit sphere; above these, in many dimensions, no bound prunes, and cells are parted by nearest pivots.
RADII = (0.5, 0.25, 0.125)
BLOCK, PAIRS = 2048, 250_000
#: First members of parts that are held against all that is left at once.
CHUNK = 256
#: Slack for rounding in bounds, of single precision; the exact comparison in double precision decides.
SLACK = 1e-3


def _cover(points: np.ndarray, own: np.ndarray, radius: float) -> list[np.ndarray]:
    """Parts of own, each within about radius of its first member, by greedy choice in the order given. points: single precision."""
    parts = []
    close = np.float32(1 - radius * radius / 2)
    while len(own):
        near = points[own[:CHUNK]] @ points[own].T >= close
        left = np.ones(len(own), dtype=bool)
        for k in range(min(CHUNK, len(own))):
            if left[k]:
                mine = near[k] & left
                mine[k] = True
                parts.append(own[mine])
                left &= ~mine
        own = own[left]
    return parts


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the points in the tree, and for each place and level whether a node begins there."""
    order, points = np.arange(len(points)), points.astype(np.float32)
    starts = np.zeros((len(points), len(RADII)), dtype=bool)
    nodes = [(0, len(points))] if len(points) else []
    for depth, radius in enumerate(RADII):
        below = []
        for a, b in nodes:
            if b - a == 1:
                below.append((a, b))
                continue
            for own in _cover(points, order[a:b].copy(), radius):
                order[a : a + len(own)] = own
                below.append((a, a + len(own)))
                a += len(own)
        nodes = below
        starts[[a for a, _ in nodes], depth] = True
    return order, starts


class CoverTree:
    """points in the order of the tree; levels[l]: first and last place, centre (the first point), covering radius, and children."""

    def __init__(self, points: np.ndarray, starts: np.ndarray):
        self.points = points
        self.levels: list[dict[str, np.ndarray]] = []
        for depth in range(starts.shape[1]):
            first = np.flatnonzero(starts[:, depth])
            last = np.append(first[1:], len(points))
            dots = np.einsum("ij,ij->i", points, points[np.repeat(first, last - first)])
            radius = np.maximum.reduceat(np.sqrt(np.maximum(0, 2 - 2 * dots)), first) if len(first) else np.zeros(0)
            radius[last - first == 1] = 0
            self.levels.append({"first": first, "last": last, "radius": radius.astype(np.float32), "centre": points[first].astype(np.float32)})
        for level, below in zip(self.levels, self.levels[1:], strict=False):
            level["child"] = np.append(np.searchsorted(below["first"], level["first"]), len(below["first"]))


def close_pairs(a: CoverTree, b: CoverTree, cosine: float, distance: float):
    """Yields (places in a, places in b) of pairs with cosine or more. One tree with itself gives both orders, and loops."""
    if not len(a.points) or not len(b.points):
        return
    la, lb = a.levels[0], b.levels[0]
    xs, ys = [], []
    for p in range(0, len(la["first"]), BLOCK):
        for q in range(0, len(lb["first"]), BLOCK):
            dots = la["centre"][p : p + BLOCK] @ lb["centre"][q : q + BLOCK].T
            ra, rb = la["radius"][p : p + BLOCK], lb["radius"][q : q + BLOCK]
            # nearer than any bound here admits is rare; those few are held against their own bound
            loose = 1 - (ra + rb.max() + distance + SLACK) ** 2 / 2
            s, t = np.nonzero(dots >= loose[:, None])
            keep = 2 - 2 * dots[s, t] <= (ra[s] + rb[t] + distance + SLACK) ** 2
            xs.append(s[keep] + p)
            ys.append(t[keep] + q)
    x, y = np.concatenate(xs), np.concatenate(ys)
    for depth in range(1, len(a.levels)):
        ka, kb = a.levels[depth - 1]["child"], b.levels[depth - 1]["child"]
        la, lb = a.levels[depth], b.levels[depth]
        na, nb = ka[x + 1] - ka[x], kb[y + 1] - kb[y]
        every = na * nb
        # all pairs of children of the pairs that are left, a bounded number at a time
        cuts = np.searchsorted(np.cumsum(every), np.arange(PAIRS, every.sum() + PAIRS, PAIRS)) if len(x) else []
        xs, ys, start = [x[:0]], [y[:0]], 0
        for cut in dict.fromkeys(min(int(c) + 1, len(x)) for c in cuts):
            own = slice(start, cut)
            start = cut
            k = np.arange(every[own].sum()) - np.repeat(np.cumsum(every[own]) - every[own], every[own])
            width = np.repeat(nb[own], every[own])
            s, t = np.repeat(ka[x[own]], every[own]) + k // width, np.repeat(kb[y[own]], every[own]) + k % width
            dots = np.einsum("ij,ij->i", la["centre"][s], lb["centre"][t])
            keep = 2 - 2 * dots <= (la["radius"][s] + lb["radius"][t] + distance + SLACK) ** 2
            xs.append(s[keep])
            ys.append(t[keep])
        x, y = np.concatenate(xs), np.concatenate(ys)
    la, lb = a.levels[-1], b.levels[-1]
    for p, q, r, s in zip(la["first"][x], la["last"][x], lb["first"][y], lb["last"][y], strict=True):
        i, j = np.nonzero(a.points[p:q] @ b.points[r:s].T >= cosine)
        if len(i):
            yield i + p, j + r
