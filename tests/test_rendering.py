"""Upsampling, encodings and the rest of rendering against numpy."""

import math

import numpy as np
import pytest

from rastrel.operators import rendering as V


def _plane(spark, plane):
    return spark.createDataFrame([(0, 0, 0, y, x, float(v)) for (y, x), v in np.ndenumerate(plane)], "image_id long, label long, c long, y long, x long, v double")


def _colours(spark, image):
    return spark.createDataFrame([(0, y, x, *map(float, image[y, x])) for y, x in np.ndindex(image.shape[:2])], "image_id long, y long, x long, r double, g double, b double")


def _image(rows, shape, names):
    out = np.full((*shape, len(names)), np.nan)
    for r in rows:
        out[r.y, r.x] = [r[n] for n in names]
    return out


@pytest.mark.parametrize(("weights", "n"), [(V.UPSAMPLE_2, 2), (V.UPSAMPLE_4, 4)])
def test_upsample(spark, weights, n):
    own = V.kernels(weights)
    assert len(own) == n * n and all(k.sum() == pytest.approx(1, abs=2e-3) for k in own.values())
    # a quarter's kernels stand in one symmetric table; the first is symmetric itself
    assert np.allclose(own[0, 0], own[0, 0].T) and np.allclose(own[0, n - 1], own[0, 0][:, ::-1]) and np.allclose(own[n - 1, 0], own[0, 0][::-1]) and own[0, 0][0, 1] == weights[1] and own[0, 0][1, 1] == weights[5 * n // 2]
    plane = np.random.default_rng(1).random((6, 9))
    big = np.pad(plane, 2, mode="symmetric")
    want = np.empty((6 * n, 9 * n))
    for y, x in np.ndindex(6, 9):
        near = big[y : y + 5, x : x + 5]
        for (i, j), k in own.items():
            want[n * y + i, n * x + j] = min(near.max(), max(near.min(), (k * near).sum()))
    assert np.allclose(_image(V.upsample(weights)(_plane(spark, plane)).collect(), want.shape, ["v"])[..., 0], want, atol=2e-6)


def test_encodings(spark):
    assert np.allclose(V.to_xyz(V.Encoding("linear")), [[0.4360, 0.3851, 0.1431], [0.2225, 0.7169, 0.0606], [0.0139, 0.0971, 0.7141]], atol=2e-4)
    for e in (V.Encoding("linear", V.WIDE), V.Encoding("linear", V.CINEMA, (0.314, 0.351))):
        assert np.allclose(V.to_xyz(e) @ [1, 1, 1], [0.9642, 1, 0.8249])
    image = np.random.default_rng(2).random((4, 5, 3))
    src = _colours(spark, image)
    for a, b in ((V.Encoding("srgb"), V.Encoding("pq", V.WIDE)), (V.Encoding("709", V.WIDE), V.Encoding("linear", V.CINEMA, (0.314, 0.351))), (V.Encoding("hlg"), V.Encoding("gamma22"))):
        back = _image(V.convert(b, a)(V.convert(a, b)(src)).collect(), (4, 5), "rgb")
        assert np.allclose(back, image, atol=3e-4)
    got = _image(V.convert(V.Encoding("srgb"), V.Encoding("linear", V.WIDE))(src).collect(), (4, 5), "rgb")
    light = np.where(image <= 0.04045, image / 12.92, ((image + 0.055) / 1.055) ** 2.4)
    assert np.allclose(got, light @ np.array([[0.6274, 0.3293, 0.0433], [0.0691, 0.9195, 0.0114], [0.0164, 0.0880, 0.8956]]).T, atol=2e-4)


def test_ranges_keep_grey_and_order(spark):
    grey = np.repeat(np.linspace(0.05, 0.7, 12), 3).reshape(1, 12, 3)
    for rendered in (V.pq_to_hlg(_colours(spark, grey)), V.render_hlg(_colours(spark, grey))):
        out = _image(rendered.collect(), (1, 12), "rgb")[0]
        assert np.allclose(out, out[:, :1], atol=1e-5) and (np.diff(out[:, 0]) > 0).all() and out.min() >= 0 and out.max() <= 1


def test_asymmetric_difference(spark):
    a, b = np.random.default_rng(3).normal(size=(2, 50))
    total = 0.0
    for p, q in zip(a, b, strict=True):
        p, q = (p, q) if p >= 0 else (-p, -q)
        v = 0.4 * p - q if q < 0.4 * p else q - p if q > p else 0.0
        total += 0.8 * 1.2 * (p - q) ** 2 + 0.8 * 0.7 * v**2
    r = V.asymmetric_l2(1.2, 0.7)(spark.createDataFrame([(0, 0, i, float(p), float(q)) for i, (p, q) in enumerate(zip(a, b, strict=True))], "image_id long, y long, x long, a double, b double")).first()
    assert r.l2 == pytest.approx(((a - b) ** 2).sum(), abs=2e-6) and r.asymmetric == pytest.approx(total, abs=2e-6)


def test_sensitivity(spark):
    image = np.random.default_rng(4).random((6, 7, 3))
    w = np.exp(-(np.arange(-2, 3) ** 2) / 2.88)
    w /= w.sum()
    big = np.pad(image, ((2, 2), (2, 2), (0, 0)), mode="symmetric")
    mean = np.array([[np.einsum("i,j,ijc->c", w, w, big[y : y + 5, x : x + 5]) for x in range(7)] for y in range(6)])
    mix, bias = np.array([r[:3] for r in V._RECEPTORS]), np.array([r[3] for r in V._RECEPTORS])
    before = np.maximum(80 * mean @ mix.T + bias, bias)
    now = np.maximum((80 * image @ mix.T + bias) * np.maximum((19.245013259874995 * np.log(before + 9.9710635769299145) - 23.16046239805755) / before, 1e-4), bias)
    want = np.stack([now[..., 0] - now[..., 1], now[..., 0] + now[..., 1], now[..., 2]], 2)
    assert np.allclose(_image(V.sensitivity()(_colours(spark, image)).collect(), (6, 7), ("ox", "oy", "ob")), want, atol=2e-6)


def test_quant_table(spark):
    bands = ((100.0, 0.5, -0.5), (50.0, -1.0, 0.0))
    steps = ([100.0, 150.0, 100.0], [50.0, 25.0, 25.0])
    rows = V.quant_table(bands, 8, 4)(spark.range(1)).collect()
    assert len(rows) == 64
    for r in rows:
        far = math.hypot(r.u / 7, r.w / 3) * 2 / (math.sqrt(2) + 1e-6)
        k = int(far)
        a, b = steps[r.c][k : k + 2]
        assert r.weight == pytest.approx(a * (b / a) ** (far - k), abs=2e-6)


def test_newton_finds_the_slope_of_chroma():
    rng = np.random.default_rng(5)
    m = rng.normal(size=400) * 40
    for slope in (-40, -9, 0, 25, 60):
        got = V.cfl_newton(m, m * slope / 84 + rng.normal(size=400) * 0.1)
        assert got == pytest.approx(0 if slope == 0 else slope - math.copysign(2.6, slope), abs=5)
    assert V.cfl_newton(np.zeros(0), np.zeros(0)) == 0


def test_tiles_and_choice(spark):
    plane = np.zeros((37, 20))
    got = {(r.ty, r.tx): (r.height, r.width, r.samples) for r in V.tiles(19)(_plane(spark, plane)).collect()}
    assert got == {(0, 0): (16, 16, 256), (0, 1): (16, 4, 64), (1, 0): (16, 16, 256), (1, 1): (16, 4, 64), (2, 0): (5, 16, 80), (2, 1): (5, 4, 20)}
    four = spark.createDataFrame([(0, 0, y, x, 5.0) for y in range(2) for x in range(4)], "image_id long, c long, cy long, cx long, cost double")
    one = spark.createDataFrame([(0, 0, 0, 0, 31.0), (0, 0, 0, 1, 33.0)], "image_id long, c long, cy long, cx long, cost double")
    assert {(r.cx, r.transforms, r.cost) for r in V.best_transform(4.0)(four, large=one).collect()} == {(0, 1, 35.0), (1, 4, 36.0)}
