"""Models that are found by search, a group at a time: clusters of histograms, copies in streams, decision trees for contexts.

A group (the histograms of one image, one stream, the samples of one image) is one task's work in numpy; groups run side by side.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rastrel.operators.trees import Leaf, Split, describe

#: Histograms nearer to each other than so many bits are not told apart.
LEAST_DISTANCE = 48.0


def entropy(counts: np.ndarray) -> np.ndarray:
    """Bits that the symbols of each histogram (last axis) take in all."""
    counts = np.asarray(counts, dtype=np.float64)
    total = counts.sum(axis=-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.where(counts > 0, -counts * np.log2(counts / total), 0.0)
    return bits.sum(axis=-1)


def cluster(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The cluster of each histogram (rows), and the clusters' histograms.

    The largest is the first seed, then each time the one furthest from all seeds, until none is LEAST_DISTANCE away; the
    others join the seed that they cost least together with, which grows as they do. Empty ones are in cluster 0.
    """
    counts = np.asarray(counts, dtype=np.float64)
    n = len(counts)
    total, own = counts.sum(axis=1), entropy(counts)
    to = np.full(n, -1)
    to[total == 0] = 0
    far = np.where(total > 0, np.inf, 0.0)
    at, seeds = int(total.argmax()) if n else 0, []
    while n and len(seeds) < most:
        to[at] = len(seeds)
        seeds.append(counts[at].copy())
        far[at] = 0.0
        open_ = far > 0
        far[open_] = np.minimum(far[open_], entropy(counts[open_] + seeds[-1]) - own[open_] - entropy(seeds[-1]))
        at = int(far.argmax())
        if far[at] < LEAST_DISTANCE:
            break
    groups = np.array(seeds).reshape(len(seeds), counts.shape[1])
    for i in np.flatnonzero(to < 0):
        best = int((entropy(counts[i] + groups) - own[i] - entropy(groups)).argmin())
        groups[best] += counts[i]
        to[i] = best
    return to, groups


def merge(to: np.ndarray, groups: np.ndarray, overhead: float) -> tuple[np.ndarray, np.ndarray]:
    """Clusters paired up, the best pair first, as long as a pair costs less than both; a cluster costs its entropy and overhead for each symbol it has."""
    groups = groups.copy()
    cost = lambda g: entropy(g) + overhead * (g > 0).sum(axis=-1)
    alive, version, each = np.ones(len(groups), dtype=bool), np.zeros(len(groups), dtype=int), cost(groups)
    queue: list[tuple[float, int, int, int, int]] = []

    def offer(i: int, others: np.ndarray) -> None:
        gains = cost(groups[i] + groups[others]) - each[i] - each[others]
        for j, gain in zip(others.tolist(), gains.tolist(), strict=True):
            if gain < 0:
                a, b = min(i, j), max(i, j)
                heapq.heappush(queue, (gain, a, b, int(version[a]), int(version[b])))

    for i in range(len(groups)):
        offer(i, np.arange(i + 1, len(groups)))
    name = np.arange(len(groups))
    while queue:
        _, a, b, va, vb = heapq.heappop(queue)
        if not (alive[a] and alive[b] and version[a] == va and version[b] == vb):
            continue
        groups[a] += groups[b]
        alive[b] = False
        version[a] += 1
        each[a] = cost(groups[a])
        name[name == b] = a
        offer(a, np.flatnonzero(alive & (np.arange(len(groups)) != a)))
    number = np.cumsum(alive) - 1
    return number[name[to]], groups[alive]


def histogram_clusters(histograms: DataFrame, most: int = 128, overhead: float | None = 4.0) -> DataFrame:
    """(grp, ctx, symbol, n) to (grp, ctx, cluster), clusters numbered by first use; overhead None leaves the merging out."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot_table(index="ctx", columns="symbol", values="n", aggfunc="sum", fill_value=0).sort_index()
        to, groups = cluster(table.to_numpy(), most)
        if overhead is not None:
            to, _ = merge(to, groups, overhead)
        _, first, again = np.unique(to, return_index=True, return_inverse=True)
        rank = np.argsort(np.argsort(first))
        return pd.DataFrame({"grp": frame["grp"].iloc[0], "ctx": table.index.to_numpy(), "cluster": rank[again]})

    return histograms.select("grp", "ctx", "symbol", "n").groupBy("grp").applyInPandas(run, "grp long, ctx long, cluster long")


def copies(values: np.ndarray, least: int, window: int, tries: int) -> list[tuple[int, int, int]]:
    """(place, length, distance) of runs that repeat earlier ones, greedily: the longest of the last `tries` places whose `least` values agree, the nearer of equals."""
    values = np.asarray(values)
    chains: dict[bytes, list[int]] = {}
    out, i, n = [], 0, len(values)

    def key(k: int) -> bytes:
        return values[k : k + least].tobytes()

    while i < n:
        length = distance = 0
        if i + least <= n:
            for j in reversed(chains.get(key(i), ())[-tries:]):
                if i - j > window:
                    break
                differ = np.flatnonzero(values[i:n] != values[j : j + n - i])
                run = int(differ[0]) if len(differ) else n - i
                if run > length:
                    length, distance = run, i - j
        for k in range(i, min(i + max(length, 1), n - least + 1)):
            chains.setdefault(key(k), []).append(k)
        if length:
            out.append((i, length, distance))
        i += max(length, 1)
    return out


def code_copies(streams: DataFrame, least: int = 3, window: int = 1 << 20, tries: int = 16) -> DataFrame:
    """(stream, pos, v) to (stream, pos, v, length, distance): a row for each value that stays, with length 1 and distance 0, and for each copy."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame.sort_values("pos")["v"].to_numpy()
        length, distance, keep = np.ones(len(v), dtype=np.int64), np.zeros(len(v), dtype=np.int64), np.ones(len(v), dtype=bool)
        for i, size, back in copies(v, least, window, tries):
            length[i], distance[i] = size, back
            keep[i + 1 : i + size] = False
        return pd.DataFrame({"stream": frame["stream"].iloc[0], "pos": np.arange(len(v)), "v": v, "length": length, "distance": distance})[keep]

    return streams.select("stream", "pos", "v").groupBy("stream").applyInPandas(run, "stream long, pos long, v long, length long, distance long")


def restore_copies(coded: DataFrame) -> DataFrame:
    """(stream, pos, v) from what code_copies leaves; values of copies are not looked at."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[int] = []
        for v, length, distance in frame.sort_values("pos")[["v", "length", "distance"]].itertuples(index=False):
            if not distance:
                out.append(v)
            for _ in range(length if distance else 0):
                out.append(out[-distance])
        return pd.DataFrame({"stream": frame["stream"].iloc[0], "pos": np.arange(len(out)), "v": out})

    return coded.groupBy("stream").applyInPandas(run, "stream long, pos long, v long")


def _tokens(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token and extra bits of residuals, signs folded in, by the scheme that keeps four values apart and two bits of larger ones."""
    packed = np.where(residual >= 0, 2 * residual, -2 * residual - 1)
    top = np.frexp(np.maximum(packed, 1).astype(np.float64))[1] - 1
    large = packed >= 16
    token = np.where(large, 16 + (top - 4) * 4 + ((packed - (1 << top)) >> np.maximum(top - 2, 0)), packed)
    return token, np.where(large, top - 2, 0)


def best_tree(properties: dict[str, np.ndarray], token: np.ndarray, predictor: str, gain: float, depth: int) -> Split | Leaf:
    """Splits that save most bits, from the root on, while one saves more than gain: all bounds of a property by running sums of token counts."""
    symbols = int(token.max(initial=0)) + 1

    def grow(rows: np.ndarray, level: int) -> Split | Leaf:
        whole = entropy(np.bincount(token[rows], minlength=symbols))
        best = (gain, "", 0)
        for name, values in properties.items() if level < depth else ():
            own = values[rows]
            bounds, place = np.unique(own, return_inverse=True)
            if len(bounds) < 2:
                continue
            counts = np.zeros((len(bounds), symbols))
            np.add.at(counts, (place, token[rows]), 1)
            low = counts.cumsum(axis=0)[:-1]
            saved = whole - entropy(low) - entropy(counts.sum(axis=0) - low)
            k = int(saved.argmax())
            if saved[k] > best[0]:
                best = (float(saved[k]), name, int(bounds[k]))
        if not best[1]:
            return Leaf(predictor, 0)
        above = properties[best[1]][rows] > best[2]
        return Split(best[1], best[2], grow(rows[above], level + 1), grow(rows[~above], level + 1))

    return grow(np.arange(len(token)), 0)


def learn_trees(samples: DataFrame, predictor: str = "Gradient", gain: float = 100.0, depth: int = 6) -> DataFrame:
    """(image_id, leaves, bits, tree) for samples with their neighbours: a tree of contexts for each image, as the text that trees.parse reads, and what its tokens take.

    Samples are those of neighbourhood.NEIGHBOURS; all of them take part.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["c", "y", "x"])
        w, n, nw, ne, ww, nn, v = (frame[k].to_numpy() for k in ("w", "n", "nw", "ne", "ww", "nn", "v"))
        guess = {"Gradient": np.maximum(np.minimum(n, w), np.minimum(np.maximum(n, w), n + w - nw)), "W": w, "N": n, "Set": np.zeros_like(v)}[predictor]
        token, extra = _tokens(v - guess)
        properties = {"c": frame["c"].to_numpy(), "y": frame["y"].to_numpy(), "x": frame["x"].to_numpy(), "|N|": abs(n), "|W|": abs(w), "N": n, "W": w, "W+N-NW": w + n - nw, "W-NW": w - nw, "NW-N": nw - n, "N-NE": n - ne, "N-NN": n - nn, "W-WW": w - ww}
        tree = best_tree(properties, token, predictor, gain, depth)
        bits, leaves = 0.0, 0
        todo = [(tree, np.arange(len(v)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, Leaf):
                bits, leaves = bits + float(entropy(np.bincount(token[rows]))) if len(rows) else bits, leaves + 1
                continue
            above = properties[node.name][rows] > node.above
            todo += [(node.greater, rows[above]), (node.other, rows[~above])]
        return pd.DataFrame({"image_id": [frame["image_id"].iloc[0]], "leaves": [leaves], "bits": [round(bits + float(extra.sum()), 4)], "tree": [describe(tree)]})

    return samples.select("image_id", "c", "y", "x", "v", "w", "n", "nw", "ne", "ww", "nn").groupBy("image_id").applyInPandas(run, "image_id long, leaves long, bits double, tree string")
