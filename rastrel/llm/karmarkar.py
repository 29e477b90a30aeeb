"""Karmarkar-Karp differencing for many-way number partitioning (the numeric part, numpy only)."""

from __future__ import annotations

import heapq

import numpy as np


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions until one is left.

    sums: one row for each partial partition, one column for each of its parts. The two with the
    largest spread are added, one ordered up and the other down, again and again. Returns the parts'
    totals and, for each row of sums, the part that each of its columns went to. Ties go to the
    smaller row number, so the result depends on the rows alone.
    """
    n, k = sums.shape
    if n == 0:
        return np.zeros(k, dtype=np.int64), np.zeros((0, k), dtype=np.int32)
    order = np.argsort(-sums, axis=1, kind="stable").astype(np.int32)
    state = {i: np.take_along_axis(sums[i], order[i], 0) for i in range(n)}
    slots = {i: order[i] for i in range(n)}  # slots[i][p]: the column, as node i numbers it, that is p-th by size
    heap = [(-int(s[0] - s[-1]), i) for i, s in state.items()]
    heapq.heapify(heap)
    children: list[tuple[int, int]] = []
    following = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = state.pop(a) + state.pop(b)[::-1]
        rank = np.argsort(-total, kind="stable").astype(np.int32)
        state[following], slots[following] = total[rank], rank
        children.append((a, b))
        heapq.heappush(heap, (-int(total[rank[0]] - total[rank[-1]]), following))
        following += 1
    root = following - 1
    # walk back: at[node][p] is the final part of the node's p-th largest column
    at = {root: np.arange(k, dtype=np.int32)}
    out = np.empty((n, k), dtype=np.int32)
    for node in range(root, -1, -1):
        final = at.pop(node)
        if node < n:
            out[node][slots[node]] = final
            continue
        a, b = children[node - n]
        place = np.empty(k, dtype=np.int32)
        place[slots[node]] = final  # the part of each column before it was ordered by size
        at[a], at[b] = place, place[::-1]
    return state[root], out
