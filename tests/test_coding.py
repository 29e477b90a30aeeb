"""Searched models: what they promise, and inverses."""

import numpy as np
import pytest

from rastrel.operators import coding as C
from rastrel.operators import neighbourhood as N
from rastrel.operators import trees as T


def test_entropy():
    assert C.entropy([4, 0, 0]) == 0 and C.entropy([1, 1, 1, 1]) == 8 and C.entropy([0, 0]) == 0
    assert np.allclose(C.entropy([[2, 2], [3, 1]]), [4, 3 * np.log2(4 / 3) + 2])


def _kinds(rng, n=40):
    kinds = np.array([[90, 5, 5, 0], [0, 5, 5, 90], [25, 25, 25, 25]])
    which = rng.integers(0, 3, n)
    counts = np.array([rng.multinomial(rng.integers(200, 900), kinds[k] / kinds[k].sum()) for k in which])
    return which, counts


def test_clusters_find_the_kinds():
    which, counts = _kinds(np.random.default_rng(1))
    counts[7] = 0
    to, groups = C.cluster(counts, 10)
    rest = np.arange(40) != 7
    assert to[7] == 0 and np.array_equal(groups.sum(axis=0), counts.sum(axis=0))
    merged, fewer = C.merge(to, groups, 4.0)
    assert len(fewer) == 3 and len({(a, b) for a, b in zip(which[rest], merged[rest], strict=True)}) == 3
    cost = lambda g: (C.entropy(g) + 4.0 * (g > 0).sum(axis=1)).sum()
    assert cost(fewer) <= cost(groups)
    for a in range(3):
        for b in range(a):
            assert cost((fewer[a] + fewer[b])[None]) >= cost(fewer[[a, b]])  # no pair is left that would pay
    assert len(C.cluster(counts, 2)[1]) == 2


def test_seeds_are_the_furthest():
    counts = np.array([[100, 0, 0], [99, 1, 0], [0, 80, 0], [0, 0, 90], [50, 0, 0]])
    to, groups = C.cluster(counts, 3)
    assert to.tolist() == [0, 0, 2, 1, 0] or to.tolist() == [0, 0, 1, 2, 0]
    assert groups[0].tolist() == [249, 1, 0]


def test_clusters_by_group(spark):
    which, counts = _kinds(np.random.default_rng(2), 20)
    rows = [(g, i, s, int(c)) for g in (0, 1) for i, row in enumerate(counts) for s, c in enumerate(row) if c]
    got: dict = {}
    for r in C.histogram_clusters(spark.createDataFrame(rows, "grp long, ctx long, symbol long, n long")).collect():
        got.setdefault(r.grp, {})[r.ctx] = r.cluster
    assert got[0] == got[1] and len({(which[i], c) for i, c in got[0].items()}) == len(set(which))
    seen = list(dict.fromkeys(got[0][i] for i in range(20)))
    assert seen == sorted(seen)  # numbered by first use


@pytest.mark.parametrize("window", [5, 1000])
def test_copies(spark, window):
    rng = np.random.default_rng(3)
    streams = [[7] * 50, [1, 2, 3, 4] * 9 + [9], rng.integers(0, 3, 200).tolist(), [5], [1, 2, 3, 9, 1, 2, 3]]
    frame = spark.createDataFrame([(k, i, int(v)) for k, s in enumerate(streams) for i, v in enumerate(s)], "stream long, pos long, v long")
    coded = C.code_copies(frame, 3, window)
    rows = coded.collect()
    assert all(r.distance <= window and (r.distance == 0) == (r.length == 1) for r in rows)
    assert sum(r.length for r in rows) == sum(map(len, streams)) and sum(r.stream == 0 for r in rows) == 2
    assert window == 5 or sum(r.stream == 4 for r in rows) == 5
    back: dict = {}
    for r in C.restore_copies(coded).orderBy("stream", "pos").collect():
        back.setdefault(r.stream, []).append(r.v)
    assert [back[k] for k in range(5)] == streams


def test_tree_splits_where_the_tokens_change(spark):
    rng = np.random.default_rng(4)
    plane = np.where(np.arange(32)[None, :] > 15, rng.integers(0, 200, (24, 32)), rng.integers(0, 3, (24, 32)))
    near = N.NEIGHBOURS(spark.createDataFrame([(0, 0, 0, y, x, int(v)) for (y, x), v in np.ndenumerate(plane)], "image_id long, label long, c long, y long, x long, v long"))
    one = C.learn_trees(near, depth=0).first()
    row = C.learn_trees(near, depth=1).first()
    tree = T.parse(row.tree)
    assert one.leaves == 1 and row.leaves == 2 and one.bits - row.bits > 100
    assert isinstance(tree, T.Split) and (tree.name in ("|W|", "W", "|N|", "N") or (tree.name, tree.above) == ("x", 15))
    deep = C.learn_trees(near).first()
    assert deep.bits <= row.bits and len(T.leaves(T.parse(deep.tree))) == deep.leaves
    by_leaf = T.apply(T.parse(row.tree))(near).groupBy("leaf").count().collect()
    assert sum(r["count"] for r in by_leaf) == plane.size and len(by_leaf) == 2


def test_best_bound_by_trying_all():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    token = rng.integers(0, 3, 300) + 4 * (b > 5)
    whole = C.entropy(np.bincount(token))
    saved = {(n, int(t)): whole - C.entropy(np.bincount(token[p <= t])) - C.entropy(np.bincount(token[p > t])) for n, p in (("N", a), ("W", b)) for t in np.unique(p)[:-1]}
    tree = C.best_tree({"N": a, "W": b}, token, "W", 1.0, 1)
    assert (tree.name, tree.above) == max(saved, key=saved.get) == ("W", 5)
