"""Trees as text, and recurrences against their inverses."""

from pathlib import Path

import numpy as np
import pytest

from rastrel.operators import modelling as L
from rastrel.operators import neighbourhood as N
from rastrel.operators import recurrences as R
from rastrel.operators import trees as T
from rastrel.plans.catalogue import QUERIES, TREE


def _frame(spark, planes):
    return spark.createDataFrame([(i, 0, 0, y, x, int(v)) for i, plane in enumerate(planes) for (y, x), v in np.ndenumerate(plane)], "image_id long, label long, c long, y long, x long, v long")


def _values(rows):
    return {(r.image_id, r.y, r.x): r.v for r in rows}


def test_tree_text_round_trip():
    tree = T.parse(TREE)
    assert T.parse(T.describe(tree)) == tree and len(T.leaves(tree)) == 6


@pytest.mark.parametrize("text", ["", "if N > 3 - Set 0", "if Q > 3 - Set 0 - Set 1", "if N < 3 - Set 0 - Set 1", "- Nowhere 0", "- Set x", "- Set 0 - Set 1"])
def test_broken_trees_are_refused(text):
    with pytest.raises(ValueError):
        T.parse(text)


def test_tree_leaves(spark):
    got = {(r.y, r.x): (r.leaf, r.guess) for r in T.apply(T.parse("if x > 0 if W > 5 - W 0 - N + 1 - Set 9"))(N.NEIGHBOURS(_frame(spark, [[[3, 9, 4], [8, 2, 1]]]))).collect()}
    assert got == {(0, 0): (2, 9), (0, 1): (1, 4), (0, 2): (0, 9), (1, 0): (2, 9), (1, 1): (0, 8), (1, 2): (1, 5)}


@pytest.mark.parametrize("shapes", [[(1, 1), (1, 9), (9, 2)], [(7, 5), (7, 5), (16, 16)]])
def test_weighted_predictor_round_trip(spark, shapes):
    rng = np.random.default_rng(2)
    planes = [rng.integers(-300, 4000, s) for s in shapes]
    pixels = _frame(spark, planes)
    assert _values(R.weighted_restore(R.weighted_residuals(pixels)).collect()) == _values(pixels.collect())


def test_weighted_predictor_learns(spark):
    """A slope is learnt: far less is left than of the first pixel of each row."""
    slope = np.add.outer(np.arange(24) * 3, np.arange(24) * 5)
    rest = _values(R.weighted_residuals(_frame(spark, [slope])).collect())
    assert rest[0, 0, 0] == 0 and max(abs(v) for (_, y, x), v in rest.items() if y > 4 and 4 < x < 20) <= 1


@pytest.mark.parametrize("width", [2, 6, 8])
def test_unsqueeze(spark, width):
    pixels = _frame(spark, np.random.default_rng(width).integers(-99, 99, (3, 4, width)))
    assert _values(R.unsqueeze(N.SQUEEZE(pixels)).collect()) == _values(pixels.collect())


def test_unsqueeze_with_a_single_last_average():
    out = R.unsqueeze_planes(np.array([[[5, 7]]]), np.array([[[0]]]))
    assert out.shape == (1, 1, 3) and out[0, 0, 2] == 7


@pytest.mark.parametrize("most", [4, 6, 15])
def test_code_lengths(most):
    for counts in ([1], [5, 5], [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144], [7] * 16):
        depths = L.code_lengths(counts, most)
        assert max(depths) <= most
        assert len(counts) == 1 or sum(2.0**-k for k in depths) == 1


def test_code_lengths_are_optimal_without_a_limit():
    assert sorted(L.code_lengths([1, 1, 2, 4], 15)) == [1, 2, 3, 3]


def test_components(spark):
    image = ["##..#", "#..##", "..#..", "#...#", "##.##"]
    pixels = _frame(spark, [[[5 if ch == "#" else 0 for ch in row] for row in image], [[9, 0, 5]] * 2])
    labels = _values(L.components(pixels, 1, 4).collect())
    assert {labels[0, y, x] for y, x in ((0, 0), (0, 1), (1, 0))} == {0}
    assert {labels[0, y, x] for y, x in ((0, 4), (1, 3), (1, 4), (2, 2))} == {4}
    assert {labels[0, y, x] for y, x in ((3, 0), (4, 0), (4, 1))} == {15} and labels[0, 2, 0] == -1
    weak = _values(L.components(pixels, 1, 8).collect())
    assert weak[1, 0, 0] == 0 and weak[1, 0, 2] == -1 and weak[0, 0, 0] == -1


def test_move_to_front(spark):
    rng = np.random.default_rng(1)
    stream = [3, 3, 0, 5, 3, *rng.integers(0, 6, 60).tolist()]
    order, places = list(range(6)), []
    for v in stream:
        places.append(order.index(v))
        order.insert(0, order.pop(places[-1]))
    coded = L.move_to_front(6)(spark.createDataFrame([(0, i, v) for i, v in enumerate(stream)], "stream long, pos long, v long"))
    assert [r.place for r in coded.orderBy("pos").collect()] == places
    assert [r.v for r in L.restore_moved(coded, 6).orderBy("pos").collect()] == stream


def test_spline_goes_through_its_points(spark):
    points = [(0.0, 0.0), (4.0, 9.0), (10.0, 2.0), (11.0, 3.0)]
    rows = L.catmull_rom()(spark.createDataFrame([(0, i, *p) for i, p in enumerate(points)], "stream long, pos long, px double, py double")).orderBy("pos", "step").collect()
    assert len(rows) == 48 and [(r.x, r.y) for r in rows if r.step == 0] == points[:3]
    straight = L.catmull_rom()(spark.createDataFrame([(0, i, 2.0 * i, 3.0 * i) for i in range(4)], "stream long, pos long, px double, py double")).collect()
    assert all(r.y == pytest.approx(1.5 * r.x, abs=2e-6) for r in straight)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_splines_sample_every_event(spark):
    users = spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy("user_id").count().collect()
    assert QUERIES["spline_samples"](spark, "/root/testdata/sf0.001").count() == sum(16 * (u["count"] - 1) for u in users)
