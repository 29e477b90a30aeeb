"""Window forms against plain loops over arrays, at sizes that are not whole blocks."""

import numpy as np
import pytest

from rastrel.operators import neighbourhood as N


def _frame(spark, image):
    return spark.createDataFrame([(0, 0, 0, y, x, float(v)) for (y, x), v in np.ndenumerate(image)], "image_id long, label long, c long, y long, x long, v double")


def _array(rows, shape, column="v"):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.y, r.x] = r[column]
    return out


def _mirrored(image, reach):
    return np.pad(image, ((reach, reach), (reach, reach)), mode="symmetric")


@pytest.mark.parametrize("shape", [(9, 11), (3, 4), (16, 8)])
@pytest.mark.parametrize("kernel", [N.GABORISH, N.GABORISH_INVERSE, N.LAPLACIAN, N.gaussian(1.2, 2)])
def test_convolve(spark, shape, kernel):
    image = np.random.default_rng(3).normal(size=shape)
    big = _mirrored(image, 2)
    expected = sum(w * big[2 + dy : 2 + dy + shape[0], 2 + dx : 2 + dx + shape[1]] for (dy, dx), w in kernel.items())
    assert np.allclose(_array(N.convolve(kernel)(_frame(spark, image)).collect(), shape), expected, atol=2e-6)


def test_convolve_keeps_a_single_pixel(spark):
    assert N.convolve(N.GABORISH)(_frame(spark, np.array([[7.0]]))).first().v == pytest.approx(7.0)


@pytest.mark.parametrize("step", [0, 1, 2])
def test_edge_preserving(spark, step):
    shape = (9, 12)
    image = np.random.default_rng(step).random((*shape, 3)) / 4
    src = spark.createDataFrame([(0, y, x, *map(float, image[y, x])) for y in range(shape[0]) for x in range(shape[1])], "image_id long, y long, x long, r double, g double, b double")
    big = np.stack([_mirrored(image[..., k], 3) for k in range(3)], axis=2)
    reach = 2 if step == 0 else 1
    plus = [(0, 0)] if step == 2 else [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    expected = np.empty_like(image)
    for y in range(shape[0]):
        for x in range(shape[1]):
            border = y % 8 in (0, 7) or x % 8 in (0, 7)
            strength = -1.1715728752538099 / 30 * 1.65 * (0.9, 1.0, 6.5)[step] * (2 / 3 if border else 1)
            total, mean = 1.0, image[y, x].copy()
            for a in range(-reach, reach + 1):
                for b in range(-reach, reach + 1):
                    if 0 < abs(a) + abs(b) <= reach:
                        sad = sum(np.abs(big[y + 3 + p, x + 3 + q] - big[y + 3 + a + p, x + 3 + b + q]) @ (40.0, 5.0, 3.5) for p, q in plus)
                        weight = max(0.0, 1 + sad * strength)
                        total, mean = total + weight, mean + weight * big[y + 3 + a, x + 3 + b]
            expected[y, x] = mean / total
    rows = N.edge_preserving(step, 30.0)(src).collect()
    for k, n in enumerate("rgb"):
        assert np.allclose(_array(rows, shape, n), expected[..., k], atol=2e-6)
    assert not np.allclose(expected, image)


def test_fuzzy_erosion(spark):
    image = np.random.default_rng(5).integers(0, 99, (6, 8)).astype(float)
    big = np.pad(image, 1, mode="edge")
    weights = np.array([0.125, 0.05, 0.045, 0.03]) * 0.29959705784054957 / 0.25
    each = np.array([[np.sort(big[y : y + 3, x : x + 3].ravel())[:4] @ weights for x in range(8)] for y in range(6)])
    assert np.allclose(_array(N.fuzzy_erosion()(_frame(spark, image)).collect(), (3, 4)), each.reshape(3, 2, 4, 2).sum(axis=(1, 3)), atol=2e-6)
