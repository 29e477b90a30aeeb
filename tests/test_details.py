"""The smaller operators against plain loops."""

import math

import numpy as np
import pytest

from rastrel.operators import details as D
from rastrel.operators import neighbourhood as N


def _plane(spark, plane):
    return spark.createDataFrame([(0, 0, 0, y, x, float(v)) for (y, x), v in np.ndenumerate(plane)], "image_id long, label long, c long, y long, x long, v double")


def _array(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.y, r.x] = r.v
    return out


def test_noise_levels(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((2, 17, 27))
    got = {(r.cy, r.cx): r for r in D.NOISE_LEVELS(spark.createDataFrame([(0, y, x, float(a[y, x]), float(b[y, x])) for y, x in np.ndindex(17, 27)], "image_id long, y long, x long, a double, b double")).collect()}
    assert set(got) == {(y, x) for y in range(2) for x in range(3)}
    kernel = np.array([[-0.25, -1, -0.25], [-1, 5, -1], [-0.25, -1, -0.25]])
    for (cy, cx), r in got.items():
        p = ((a + b) / 2)[8 * cy : 8 * cy + 8, 8 * cx : 8 * cx + 8]
        sads = sorted(np.abs(p[2:6, 2:5] - p[y : y + 4, x : x + 3]).sum() for y in range(4) for x in range(5))
        inside = lambda i, k: i + k if 0 <= i + k < 8 else i - k
        noise = np.mean([abs(sum(kernel[i + 1, j + 1] * p[inside(y, i), inside(x, j)] for i in (-1, 0, 1) for j in (-1, 0, 1))) for y in range(8) for x in range(8)])
        assert (r.texture, r.intensity, r.noise) == pytest.approx((sum(sads[:10]) / 10, p.mean(), noise), abs=2e-6)


def test_noise_quantiles(spark):
    rng = np.random.default_rng(2)
    for trial in range(12):
        bins = np.where(rng.random(256) < (0.02, 0.3, 1)[trial % 3], rng.integers(1, 9, 256), 0)
        bins[rng.integers(0, 256)] += 1
        rows = [(trial, int(i), int(n)) for i, n in enumerate(bins) if n]
        for r in D.noise_quantiles((0.1, 0.25, 0.5, 0.75, 0.95))(spark.createDataFrame(rows, "ctx long, symbol long, n long")).collect() if trial < 6 else []:
            target, run = int(r.share * (bins.sum() + 1)), np.cumsum(bins)
            i = int(np.argmax(run >= target)) if target else 0
            if run[i] == target and target:
                want = i + 0.5
            elif target == 0:
                continue  # before any count
            else:
                following = next((k for k in range(i + 1, 256) if bins[k]), 256)
                weight = bins[min(following, 255)] / (target - run[i])
                want = min(255, max(0, following * weight + i * (1 - weight)))
            assert r.quantile == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("shape", [(1, 1), (4, 9), (11, 7)])
def test_windows(spark, shape):
    plane = np.random.default_rng(shape[1]).random(shape)
    eroded = np.empty(shape)
    for y, x in np.ndindex(shape):
        near = [plane[p, q] for p in (y - 3, y, y + 3) for q in (x - 3, x, x + 3) if (p, q) != (y, x) and 0 <= p < shape[0] and 0 <= q < shape[1]]
        low = sorted([plane[y, x], 2 * plane[y, x], 2 * plane[y, x], *near])
        eroded[y, x] = 0.45 * low[0] + 0.3 * low[1] + 0.25 * low[2]
    assert np.allclose(_array(D.erode_far()(_plane(spark, plane)).collect(), shape), eroded, atol=2e-6)

    def between(p):
        big = np.pad(p, ((0, 0), (1, 2)), mode="edge")
        out = np.empty((p.shape[0], 2 * p.shape[1]))
        out[:, ::2], out[:, 1::2] = p, 0.5625 * (big[:, 1:-2] + big[:, 2:-1]) - 0.0625 * (big[:, :-3] + big[:, 3:])
        return out

    assert np.allclose(_array(D.UPSAMPLE_V(D.UPSAMPLE_H(_plane(spark, plane))).collect(), (2 * shape[0], 2 * shape[1])), between(between(plane).T).T)


def test_kernels(spark):
    assert sum(D.MASK_BLUR.values()) == pytest.approx(1) and len(D.MASK_BLUR) == 25
    assert D.MASK_BLUR[0, 1] / D.MASK_BLUR[0, 0] == pytest.approx(0.364911248) and D.MASK_BLUR[2, -1] / D.MASK_BLUR[0, 0] == pytest.approx(0.221069183) and D.MASK_BLUR[-2, 0] / D.MASK_BLUR[0, 0] == pytest.approx(0.1688888021)
    plane = np.random.default_rng(5).random((6, 9))
    big = np.pad(plane, 2, mode="symmetric")
    along, across = np.array([0.1, 0.2, 0.4, 0.2, 0.1]), np.array([0.05, 0.2, 0.5, 0.2, 0.05])
    want = np.array([[across @ big[y : y + 5, x : x + 5] @ along for x in range(9)] for y in range(6)])
    assert np.allclose(_array(N.convolve(D.separable((0.4, 0.2, 0.1), (0.5, 0.2, 0.05)))(_plane(spark, plane)).collect(), (6, 9)), want, atol=2e-6)


def test_streams(spark):
    stream = lambda *values: spark.createDataFrame([(k, i, v) for k, vs in enumerate(values) for i, v in enumerate(vs)], "stream long, pos long, v long")
    runs = [[1, 2, -3, 3, 0, -9], [-1, -2], [0, 0], [5], [-2, 2, 1]]
    for r in D.SUM_MAXIMUM(stream(*runs)).collect():
        total = best = first = last = 0
        for i, v in enumerate(runs[r.stream]):
            total += v
            if total > best:
                best, first = total, i
            if total == best:
                last = i
        assert (r.idx, r.sum) == ((first + last + 1) >> 1, best)
    bits = {r.v: r.bits for r in D.field_bits((0, (4, 1), (8, 17), (15, 273)))(stream([0, 1, 16, 17, 272, 273, 33040, 33041])).collect()}
    assert bits == {0: 2, 1: 6, 16: 6, 17: 10, 272: 10, 273: 17, 33040: 17, 33041: None}
    for n in (1, 4, 11, 12):
        data, out, height = list(range(100, 100 + n)), [], -(-n // 4)
        start = j = 0
        for _ in range(n):
            out.append(data[j])
            j += height
            if j >= n:
                start += 1
                j = start
        assert [r.v for r in D.byte_planes(4)(stream(data)).orderBy("pos").collect()] == out
    codes = [[0, 0, 3, 0, 9, 0, 0], [0, 0, 0], [1, 2]]
    context = lambda v: 0 if v == 0 else min(7, v.bit_length())
    for skip in (0, 1):
        got: dict = {}
        for r in D.permutation_tokens(skip)(stream(*codes).withColumnRenamed("v", "code")).orderBy("stream", "pos").collect():
            got.setdefault(r.stream, []).append((r.ctx, r.value))
        for k, code in enumerate(codes):
            end = len(code)
            while end > skip and code[end - 1] == 0:
                end -= 1
            want, last = [(context(len(code)), end - skip)], 0
            for c in code[skip:end]:
                want.append((context(last), c))
                last = c
            assert got[k] == want


def test_palette_of_cubes_and_differences(spark):
    deltas = ((0, 0, 0), (4, 5, -6), (11, 0, 2))
    rows = [(0, 0, i, i) for i in range(-12, 230)]
    palette = spark.createDataFrame([(0, i, 10 * i, 20 * i, 30 * i) for i in range(5)], "image_id long, idx long, p0 long, p1 long, p2 long")
    for r in D.palette_expand(5, 8, deltas)(spark.createDataFrame(rows, "image_id long, y long, x long, idx long"), palette=palette).collect():
        i = r.idx
        if i < 0:
            k = -(i + 1) % 5
            want = [v * (-1, 1)[k & 1] for v in deltas[(k + 1) >> 1]]
        elif i < 5:
            want = [10 * i, 20 * i, 30 * i]
        elif i < 69:
            want = [((i - 5) // 4**c % 4 * 255 >> 2) + 32 for c in range(3)]
        else:
            want = [(i - 69) // 5**c % 5 * 255 >> 2 for c in range(3)]
        assert [r.v0, r.v1, r.v2] == want


def test_blocks_frames_and_tables(spark):
    quant = spark.createDataFrame([(0, 0, 0, 0, 3.0), (0, 0, 0, 1, 5.0), (0, 0, 1, 0, 1.0), (0, 0, 1, 1, 7.0), (0, 1, 0, 2, 2.0), (0, 1, 1, 2, 4.0)], "image_id long, part long, cy long, cx long, quant double")
    mix = 1 - (2.0 - 1.54138) * 0.56391
    assert {(r.part, r.quant) for r in D.adjust_quant(2.0)(quant).collect()} == {(0, round(7 * mix + 4 * (1 - mix), 6)), (1, 4.0)}
    assert {r.quant for r in D.adjust_quant(1.0)(quant).collect()} == {7.0, 4.0}
    sigma = {r.cy: r.inv_sigma for r in D.filter_sigma(0.02)(spark.createDataFrame([(0, 0, 0, 5, 7), (0, 1, 0, 5, 0)], "image_id long, cy long, cx long, quant long, sharpness long")).collect()}
    assert sigma[0] == pytest.approx(0.02 * 5 * -1.1715728752538099 / 0.46, abs=1e-5) and sigma[1] == -10000
    boxes = spark.createDataFrame([(0, 2, 3), (1, 0, 9), (2, 8, 9), (3, 3, 6)], "id long, lo long, hi long")
    assert {(r.id, r.relation) for r in D.BOX_RELATION(boxes, box=spark.createDataFrame([(0, 2, 5)], "box long, low long, high long")).collect()} == {(0, "inside"), (1, "partial"), (2, "none"), (3, "partial")}
    frames = spark.createDataFrame([(0, 0, 0, 0, 0, 0), (0, 1, 0, 2, 0, 0), (0, 2, 1, 2, 1, 1), (0, 3, 3, 0, 1, 0), (0, 4, 0, 0, 0, 1)], "image_id long, frame long, kind long, mode long, part long, extra long")
    assert [r.blended for r in D.NEEDS_BLENDING(frames).orderBy("frame").collect()] == [0, 1, 0, 1, 1]
    texts = ["RGB_D65_SRG_Rel_SRG", "Gra_D65_Per_g0.45", "RGB_D65_SRG", "", None]
    got = {r.id: (r.space, r.white, r.primaries, r.intent, r.curve) for r in D.COLOUR_DESCRIPTION(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    assert got == {0: ("RGB", "D65", "SRG", "Rel", "SRG"), 1: ("Gra", "D65", None, "Per", "g0.45"), 2: (None,) * 5, 3: (None,) * 5, 4: (None,) * 5}


def test_photon_noise_grows_with_sensitivity(spark):
    got: dict = {}
    for r in D.photon_noise()(spark.createDataFrame([(0, 640, 480, 100.0), (1, 640, 480, 6400.0)], "image_id long, width long, height long, iso double")).orderBy("point").collect():
        got.setdefault(r.image_id, []).append(r.strength)
    assert len(got[0]) == 8 and all(a < b for a, b in zip(got[0], got[1], strict=True))
    bias, k = 0.0037930732552754493, 4
    grey = 0.2 * 11260 * 10 / 100 * 36000 * 24000 / (640 * 480)
    light = (2 * k / 6 - np.cbrt(bias)) ** 3 + bias
    electrons = grey * light / 0.18
    noise = math.sqrt(9 + electrons + (0.005 * electrons) ** 2) * 0.18 / grey / 3 / np.cbrt(light - bias) ** 2
    assert got[0][k] == pytest.approx(noise / (0.22 * 2**0.5 * 1.13), abs=1e-6)


def test_components_stand_out(spark):
    plane = np.random.default_rng(3).integers(0, 50, (9, 12))
    plane[3:5, 4:7] = 90
    plane[4, 5] = 99
    label = spark.createDataFrame([(0, y, x, 1) for y in (3, 4) for x in (4, 5, 6)], "image_id long, y long, x long, part long")
    r = D.component_stats(2)(spark.createDataFrame([(0, y, x, int(v)) for (y, x), v in np.ndenumerate(plane)], "image_id long, y long, x long, v long"), label=label).first()
    around = plane[1:7, 2:9].astype(float)
    inside = np.zeros((6, 7), dtype=bool)
    inside[2:4, 2:5] = True
    assert (r.y0, r.x0, r.y1, r.x1, r.top, r.at) == (3, 4, 4, 6, 99, 4 * 12 + 5)
    assert (r.mean, r.variance) == pytest.approx((around[inside].mean(), around[inside].var()), abs=1e-4)
    assert r.score == pytest.approx((around[inside].mean() - around[~inside].mean()) / around[~inside].std(), abs=1e-3)


def test_squeeze_schedule():
    assert D.squeeze_schedule(8, 8, 1) == []
    assert D.squeeze_schedule(9, 20, 3) == [(True, False, 1, 2), (False, False, 1, 2), (False, True, 0, 3), (True, True, 0, 3), (False, True, 0, 3)]
    assert D.squeeze_schedule(20, 9, 1) == [(True, True, 0, 1), (False, True, 0, 1), (True, True, 0, 1)]


def test_noise_image(spark):
    word = 2**64 - 1

    def split(z):
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & word
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & word
        return z ^ (z >> 31)

    def stream(a, b, c, e):
        s0, s1 = [split((a << 32) + b + 0x9E3779B97F4A7C15 & word)], [split((c << 32) + e + 0x9E3779B97F4A7C15 & word)]
        for _ in range(7):
            s0.append(split(s0[-1]))
            s1.append(split(s1[-1]))
        while True:
            out = []
            for i in range(8):
                p, q = s0[i], s1[i]
                bits = p + q & word
                p = p ^ (p << 23) & word
                s0[i], s1[i] = q, p ^ q ^ (p >> 18) ^ (q >> 5)
                out += [bits & 0xFFFFFFFF, bits >> 32]
            yield [1 + (v >> 9) / 2**23 for v in out]

    got = {(r.y, r.x): (r.n0, r.n1, r.shared) for r in D.noise_image(spark.createDataFrame([(5, 3, 1, 6, 37)], "image_id long, shown int, hidden int, height int, width int"), 32).collect()}
    assert len(got) == 6 * 37
    for x0, width in ((0, 32), (32, 5)):
        draw = stream(3, 1, x0, 0)
        for plane in range(3):
            for y in range(6):
                row = sum((next(draw) for _ in range(-(-width // 16))), [])
                assert [got[y, x0 + x][plane] for x in range(width)] == row[:width]
