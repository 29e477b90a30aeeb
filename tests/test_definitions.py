"""Formulas stated a second time in plain Python and numpy, on small planes that are neither 8x8 nor square."""

import math

import numpy as np
import pytest

from rastrel.functions import pointwise as P
from rastrel.operators import entropy as E
from rastrel.operators import measures as M
from rastrel.operators import modelling as L
from rastrel.operators import neighbourhood as N

SHAPES = [(1, 1), (1, 9), (9, 2), (33, 17)]


def _rng(shape):
    return np.random.default_rng(shape[0] * 100 + shape[1])


def _pixels(spark, planes, c=0):
    rows = [(i, 0, c, y, x, v.item()) for i, plane in enumerate(planes) for (y, x), v in np.ndenumerate(plane)]
    return spark.createDataFrame(rows, "image_id long, label long, c long, y long, x long, v " + ("long" if planes[0].dtype.kind in "iu" else "double"))


def _colours(spark, images, names="r g b"):
    names = names.split()
    rows = [(i, y, x, *map(float, im[y, x])) for i, im in enumerate(images) for y in range(im.shape[0]) for x in range(im.shape[1])]
    return spark.createDataFrame(rows, "image_id long, y long, x long, " + ", ".join(f"{n} double" for n in names))


def _image(rows, shape, names):
    out = np.full((*shape, len(names)), np.nan)
    for r in rows:
        out[r.y, r.x] = [r[n] for n in names]
    return out


@pytest.mark.parametrize("shape", SHAPES)
def test_psnr_and_distance(spark, shape):
    a, b = _rng(shape).random((2, *shape, 3))
    yuv = np.array([[0.299, 0.587, 0.114], [-0.14713, -0.28886, 0.436], [0.615, -0.51499, -0.10001]])
    square = (((a - b) @ yuv.T) ** 2).reshape(-1, 3).sum(0)
    got = M.PSNR(_colours(spark, [np.concatenate([a, b], 2)], "r1 g1 b1 r2 g2 b2")).first()
    assert got.psnr == pytest.approx((20 * np.log10(1 / np.sqrt(square / (shape[0] * shape[1])))) @ [0.75, 0.125, 0.125], abs=2e-6)
    assert got.distance2 == pytest.approx((np.sqrt(square) @ [0.75, 0.125, 0.125]) ** 2, abs=2e-6)
    assert M.PSNR(_colours(spark, [np.concatenate([a, a], 2)], "r1 g1 b1 r2 g2 b2")).first().psnr == 99.99


def test_gamut_map(spark):
    image = np.random.default_rng(1).random((7, 9, 3)) * 2.2 - 0.6
    image[0, 0] = [0.4, 0.4, 0.4]
    want = np.empty_like(image)
    for at in np.ndindex(7, 9):
        rgb = image[at]
        light = float(rgb @ [0.2627, 0.678, 0.0593])
        saturation = luminance = 0.0
        for v in rgb:
            over = v - light
            ratio = v / (over if over else 1.0)
            if over < 0:
                saturation = max(saturation, ratio)
            luminance = max(luminance, saturation if over <= 0 else ratio - 1 / over)
        mix = min(1.0, max(0.0, 0.1 * (saturation - luminance) + luminance))
        out = mix * (light - rgb) + rgb
        want[at] = out / max(1.0, out.max())
    got = _image(P.gamut_map()(_colours(spark, [image])).collect(), (7, 9), "rgb")
    assert np.allclose(got, want, atol=2e-6) and got.max() <= 1


def test_alpha(spark):
    image = np.random.default_rng(2).random((5, 4, 4))
    image[0, :, 3] = [0.0, 2.0**-30, 2.0**-26, 1.0]
    src = _colours(spark, [image], "r g b a")
    floor = np.maximum(image[..., 3:], 2.0**-26)
    assert np.allclose(_image(P.PREMULTIPLY(src).collect(), (5, 4), "rgb"), image[..., :3] * floor, rtol=1e-12, atol=0)
    assert np.allclose(_image(P.UNPREMULTIPLY(P.PREMULTIPLY(src)).collect(), (5, 4), "rgb"), image[..., :3])
    want = image[..., :3] * image[..., 3:] + np.array([0.2, 0.5, 0.8]) * (1 - image[..., 3:])
    assert np.allclose(_image(P.flatten((0.2, 0.5, 0.8))(src).collect(), (5, 4), "rgb"), want, atol=2e-6)


@pytest.mark.parametrize(("fg_alpha", "premultiplied", "clamp", "colours", "alpha"), [
    (15420 / 65535, False, False, (77.2, 83.0, 90.6), 3174 / 4095), (15420 / 65535, True, False, (101.5, 105.1, 114.8), 3174 / 4095), (2.0, False, True, (25, 21, 23), 1.0),
])
def test_blending_of_known_colours(spark, fg_alpha, premultiplied, clamp, colours, alpha):
    bottom, top = _colours(spark, [np.array([[[100, 110, 120, 180 / 255]]])], "r g b a"), _colours(spark, [np.array([[[25, 21, 23, fg_alpha]]])], "r g b a")
    place = spark.createDataFrame([(0, 2, 0, 0)], "image_id long, mode int, dy int, dx int")
    got = M.blend(premultiplied, clamp)(bottom, top=top, place=place).first()
    assert [got.r, got.g, got.b] == pytest.approx(colours, abs=0.05) and got.a == pytest.approx(alpha, abs=1e-5)


def test_multiplying_layers_and_offsets(spark):
    place = lambda mode, dy=0, dx=0: spark.createDataFrame([(0, mode, dy, dx)], "image_id long, mode int, dy int, dx int")
    one = lambda v: _colours(spark, [np.full((1, 1, 4), v)], "r g b a")
    assert M.blend()(one(100.0), top=one(25.0), place=place(4)).first().r == 2500 and M.blend(clamp=True)(one(100.0), top=one(25.0), place=place(4)).first().r == 100
    bottom, top = np.random.default_rng(3).random((2, 4, 6, 4))
    for mode in range(5):
        want = bottom.copy()
        for y, x in np.ndindex(4, 6):
            if 0 <= y + 2 < 4 and 0 <= x - 1 < 6:
                p, f = bottom[y + 2, x - 1], top[y, x]
                a = 1 - (1 - f[3]) * (1 - p[3])
                want[y + 2, x - 1] = [f, p + f, np.append((f[:3] * f[3] + p[:3] * p[3] * (1 - f[3])) / a, a), np.append(p[:3] + f[:3] * f[3], p[3]), p * f][mode]
        got = M.blend()(_colours(spark, [bottom], "r g b a"), top=_colours(spark, [top], "r g b a"), place=place(mode, 2, -1))
        assert np.allclose(_image(got.collect(), (4, 6), "rgba"), want, atol=2e-6)


def test_patches_in_order_and_pixels_without(spark):
    plane = np.arange(35).reshape(5, 7)
    patches = [(3, 0, 1, 1, 3, 2, 2, 10), (1, 0, 0, 0, 2, 2, 1, 5), (2, 0, 1, 1, 2, 2, 0, 7), (9, 5, 0, 0, 9, 9, 0, 1)]  # id, image, x0, y0, w, h, mode, value
    want = plane.astype(float)
    for _, image, x0, y0, w, h, mode, value in sorted(patches):
        if image == 0:
            own = want[y0 : y0 + h, x0 : x0 + w]
            own[:] = [value, own + value, own * value][mode]
    rows = M.PATCH_APPLY(_pixels(spark, [plane]), patches=spark.createDataFrame(patches, "id long, image_id long, x0 long, y0 long, w long, h long, mode int, value long")).collect()
    assert len(rows) == 35 and np.array_equal(_image(rows, (5, 7), ["v"])[..., 0], want)


def test_chroma_from_luma(spark):
    rng = np.random.default_rng(4)
    for k, slope in enumerate((0.0, 0.02, 0.5, -0.4, 3.0)):
        m = rng.normal(size=60) * 40
        s = m * slope + rng.normal(size=60)
        a, b = m / 84, -s
        x = -(a * b).sum() / ((a * a).sum() + 60 * 0.0005)
        drawn = x - 2.6 if x >= 2.6 else x + 2.6 if x <= -2.6 else 0.0
        want = min(127, max(-128, math.floor(abs(drawn) + 0.5) * (1 if drawn > 0 else -1)))
        got = M.cfl_fit()(spark.createDataFrame([(k, float(p), float(q)) for p, q in zip(m, s, strict=True)], "image_id long, m double, s double")).first()
        assert got.x == pytest.approx(x, abs=2e-6) and got.multiplier == want


def test_speed_summary(spark):
    runs = {1: [3.0], 2: [9.0, 4.0], 3: [8.0, 2.0, 4.0], 4: [1e60, 3.0, 2.0, 5.0], 5: [2.0, *[1e-200] * 4], 6: [1.5, 2.5, 0.5, 3.5]}
    src = spark.createDataFrame([(k, i, t) for k, ts in runs.items() for i, t in enumerate(ts)], "stream long, pos long, t double")
    got = {r.stream: r for r in M.SPEED_SUMMARY(src).collect()}
    assert [got[k].kind for k in range(1, 7)] == ["single", "second", "geomean", "median", "median", "geomean"]
    assert got[1].central == 3 and got[2].central == 4 and got[3].central == pytest.approx(8**0.5, abs=1e-6) and got[6].central == pytest.approx((2.5 * 0.5 * 3.5) ** (1 / 3), abs=1e-6)
    assert got[4].central == 5 and got[4].high == 1e60 and got[3].low == 2


def _places(rows, columns):
    """Diagonals of the square over the longer side, walked in turns, the lowest coefficients first."""
    step, side, out = columns // rows, 8 * columns, []
    for i in range(2 * side - 1):
        for j in range(side):
            x, y = (j, i - j) if i % 2 == 0 else (i - j, j)
            if 0 <= x < side and 0 <= y < side and y % step == 0 and not (x < columns and y // step < rows):
                out.append((y // step, x))
    return [(y, x) for y in range(rows) for x in range(columns)] + out


@pytest.mark.parametrize("blocks", [(1, 1), (1, 2), (2, 2), (1, 4)])
def test_natural_order(spark, blocks):
    got = M.zigzag(*blocks)(spark.range(1)).orderBy("place").collect()
    assert [(r.u, r.w) for r in got] == _places(*blocks)


def test_coefficient_order_and_scan(spark):
    rng = np.random.default_rng(5)
    blocks = rng.integers(-2, 3, (30, 8, 8)) * (rng.random((30, 8, 8)) < np.linspace(1, 0, 64).reshape(8, 8))
    src = spark.createDataFrame([(b, 0, 0, 0, u, w, int(v)) for b, block in enumerate(blocks) for (u, w), v in np.ndenumerate(block)], "image_id long, c long, cy long, cx long, u long, w long, q long")
    places = _places(1, 1)
    zeros = {p: int((blocks[:, p[0], p[1]] == 0).sum()) for p in places}
    want = sorted(places, key=lambda p: (int(zeros[p] / 8 + 0.1), places.index(p)))
    assert [(r.u, r.w) for r in M.COEFFICIENT_ORDER(src).orderBy("place").collect()] == want
    tokens: dict = {}
    for r in M.SCAN_TOKENS(src).orderBy("place").collect():
        tokens.setdefault(r.image_id, []).append((r.place, r.q, r.remaining))
    for b, block in enumerate(blocks):
        values = [int(block[p]) for p in places][1:]
        last = max((i for i, v in enumerate(values) if v), default=-1)
        assert tokens.get(b, []) == [(i + 1, values[i], sum(v != 0 for v in values[i:])) for i in range(last + 1)]


def _distance(a, b):
    mean = sum(a[:3]) * 0 + (sum(a[:3]) + sum(b[:3])) * 1.21 / 3
    total = 0.0
    for c in range(3):
        weight = (3, 5, 2)[c]
        if a[c] + b[c] >= mean:
            weight += (1.15, 1.15, 1.12)[c]
            if c == 2 and a[2] + b[2] < 1.22 * mean:
                weight -= 0.5
        total += (a[c] - b[c]) ** 2 * weight**2
    return 4 * total + sum((p - q) * w for p, q, w in zip(a, b, (3, 5, 1), strict=True)) ** 2


def test_top_deltas_and_nearest_colours(spark):
    rng = np.random.default_rng(6)
    deltas = rng.choice([-9, -4, -1, 0, 1, 2, 5, 30], size=(80, 3))
    far = rng.random(80) * 5e6
    src = spark.createDataFrame([(0, *map(int, v), float(f)) for v, f in zip(deltas, far, strict=True)], "image_id long, d0 long, d1 long, d2 long, distance double")
    near = lambda v: -((-v + 1) // 3) if v < 0 else (v + 1) // 3
    score: dict = {}
    for v, f in zip(deltas.tolist(), far, strict=True):
        key = tuple(near(x) for x in v)
        if any(key):
            score[key] = score.get(key, 0.0) + f**0.25
    score = {k: v * (_distance((0, 0, 0), k) ** 0.5 + 1) / 80 for k, v in score.items()}
    want = {tuple(3 * x for x in k): v for k, v in score.items() if v >= 17}
    got = {(r.d0, r.d1, r.d2): r.score for r in M.top_deltas()(src).collect()}
    assert set(got) == set(want) and 0 < len(want) < len(score) and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)
    image, palette = rng.integers(0, 256, (3, 5, 3)), rng.integers(0, 256, (6, 3))
    rows = M.PALETTE_NEAREST(_colours(spark, [image], "v0 v1 v2"), palette=spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(palette)], "image_id long, idx long, p0 double, p1 double, p2 double")).collect()
    for r in rows:
        assert r.idx == min(range(6), key=lambda i, r=r: (_distance(palette[i].tolist(), image[r.y, r.x].tolist()), i))


@pytest.mark.parametrize("kind", range(42))
def test_colour_transforms_restore(kind):
    """In plain Python by evaluating the texts, as all 42 are integer arithmetic."""
    columns = lambda op: {c.split(" AS ")[1].strip(): c.split(" AS ")[0] for c in P._columns(op(kind).sql)}
    there, back = columns(P.rct), columns(P.unrct)
    for v in np.random.default_rng(kind).integers(-300, 300, (20, 3)).tolist():
        values = dict(zip(("v0", "v1", "v2"), v, strict=True))
        moved = {n: eval(e, {}, values) for n, e in there.items()}
        assert [eval(back[n], {}, moved) for n in ("v0", "v1", "v2")] == v


def test_all_colour_transforms_at_once(spark):
    rows = [(k, 0, x, k, *map(int, np.random.default_rng(x).integers(-99, 99, 3))) for k in range(42) for x in range(4)]
    src = spark.createDataFrame(rows, "image_id long, y long, x long, kind int, v0 long, v1 long, v2 long")
    got = {(r.image_id, r.x): (r.v0, r.v1, r.v2) for r in P.UNRCT_BY_KIND(P.RCT_BY_KIND(src)).collect()}
    assert got == {(r[0], r[2]): r[4:] for r in rows}
    cost = M.Operator("SELECT * FROM {src}")(P.RCT_COSTS(src.drop("kind"))).first()
    assert cost.cost <= sum(abs(a) + abs(b) + abs(c) for *_, a, b, c in rows if _[0] == cost.image_id)


@pytest.mark.parametrize("shape", SHAPES)
def test_block_transform_of_any_size(spark, shape):
    plane = _rng(shape).normal(size=shape)
    big = np.pad(plane, ((0, -shape[0] % 8), (0, -shape[1] % 8)), mode="edge")
    k = np.arange(8)
    basis = np.cos((k[None, :] + 0.5) * k[:, None] * np.pi / 8) * np.sqrt(2) / 8 * np.where(k[:, None] == 0, 1 / np.sqrt(2), 1)
    coefficients = M.DCT8(_pixels(spark, [plane]))
    rows = coefficients.collect()
    assert len(rows) == big.size
    for r in rows:
        block = big[8 * r.cy : 8 * r.cy + 8, 8 * r.cx : 8 * r.cx + 8]
        assert r.v == pytest.approx(basis[r.u] @ block @ basis[r.w], abs=1e-9)
    back = _image(M.IDCT8(coefficients).collect(), big.shape, ["v"])[..., 0]
    assert np.allclose(back, big)


def test_block_transform_of_other_sides(spark):
    plane = np.random.default_rng(9).normal(size=(35, 18))
    rows = M.dct(16, 4)(_pixels(spark, [plane])).collect()
    assert len(rows) == 2 * 4 * 64
    b = {n: np.array(M.basis(n)) for n in (16, 4)}
    for r in rows:
        assert r.v == pytest.approx(b[16][r.u] @ plane[16 * r.cy : 16 * r.cy + 16, 4 * r.cx : 4 * r.cx + 4] @ b[4][r.w], abs=1e-9)


def test_quantisation(spark):
    values = [0.0, 1.0, -1.2, 2.4, 2.5, 3.5, -2.5, 10.0, 6.0, -14.0]
    src = spark.createDataFrame([(i, c, 0, 0, u, w, v) for i, v in enumerate(values) for c in range(3) for u, w in ((0, 1), (5, 6))], "image_id long, c long, cy long, cx long, u long, w long, v double")
    quantised = M.deadzone(1.0)(src)
    for r in quantised.collect():
        v = values[r.image_id]
        assert r.q == (round(v) if abs(v) >= (0.58 if r.u < 4 else 0.64) else 0)
    for r in M.dequantise(4.0)(quantised).collect():
        q = round(values[r.image_id])
        one = (1 - 0.05465007330715401, 1 - 0.07005449891748593, 1 - 0.049935103337343655)[r.c]
        assert r.v == pytest.approx(4 * (0 if q == 0 else q * one if abs(q) == 1 else q - 0.145 / q), abs=2e-6)


@pytest.mark.parametrize("shape", SHAPES)
def test_sizes_come_from_the_data(spark, shape):
    plane = _rng(shape).integers(-50, 200, shape)
    src = _pixels(spark, [plane])
    for factor in (2, 3):
        h, w = -(-shape[0] // factor), -(-shape[1] // factor)
        cell = lambda a, y, x, f=factor: a[y * f : (y + 1) * f, x * f : (x + 1) * f].mean()
        big = np.pad(plane, ((0, h * factor - shape[0]), (0, w * factor - shape[1])), mode="edge")
        for op, of in ((N.downsample_mean, plane), (N.downsample_edge, big)):
            want = np.array([[cell(of, y, x) for x in range(w)] for y in range(h)])
            assert np.allclose(_image(op(factor)(src).collect(), (h, w), ["v"])[..., 0], want, atol=2e-6)
    stats = M.MINMAX_STATS(src).first()
    assert (stats.low, stats.high, stats.at_low, stats.at_high) == (plane.min(), plane.max(), plane.argmin(), plane.argmax())
    med = np.sort(plane.ravel())[plane.size // 2]
    row = M.MEDIAN_MAD(src).first()
    assert (row.med, row.mad) == (med, np.sort(np.abs(plane - med).ravel())[plane.size // 2])
    turned = {1: plane, 2: plane[:, ::-1], 3: plane[::-1, ::-1], 4: plane[::-1], 5: plane.T, 6: np.rot90(plane, -1), 7: plane[::-1, ::-1].T, 8: np.rot90(plane)}
    for o, want in turned.items():
        got = P.ORIENT(src, turn=spark.createDataFrame([(0, o)], "image_id long, orientation int")).collect()
        assert np.array_equal(_image(got, want.shape, ["v"])[..., 0], want)
    got = N.crop(-1, 1, 5, 3)(src).collect()
    assert {(r.y, r.x): r.v for r in got} == {(y + 1, x - 1): plane[y, x] for y, x in np.ndindex(shape) if y < 4 and 1 <= x < 4}


def test_external_samples(spark):
    image = np.array([[[0.5, -1.0, 2.0], [1 / 510, 3 / 510, 0.25]]])
    assert _image(P.external(8)(_colours(spark, [image])).collect(), (1, 2), "rgb").tolist() == [[[128, 0, 255], [0, 2, 64]]]
    assert np.allclose(_image(P.planar(16)(P.external(16)(_colours(spark, [image]))).collect(), (1, 2), "rgb"), np.clip(image, 0, 1), atol=1e-5)


def test_masked_block_distance(spark):
    rng = np.random.default_rng(8)
    a, b, mask = rng.random((11, 9, 3)), rng.random((11, 9, 3)), rng.random((11, 9))
    square = ((a - b) ** 2 * (mask**2)[..., None]) @ [12.339445295782363, 1.0, 0.2]
    for r in M.BLOCK_L2(_colours(spark, [np.concatenate([a, b], 2)], "r1 g1 b1 r2 g2 b2"), mask=_colours(spark, [mask[..., None]], "mask")).collect():
        assert r.l2 == pytest.approx(square[8 * r.by : 8 * r.by + 8, 8 * r.bx : 8 * r.bx + 8].sum(), abs=2e-6)


@pytest.mark.parametrize(("size", "shape"), [(4, (19, 13)), (8, (33, 70)), (5, (5, 5))])
def test_groups_from_the_centre(spark, size, shape):
    h, w = shape
    cy, cx = (h // 2) // size * size + size // 2, (w // 2) // size * size + size // 2
    direction = -math.atan2(h // 2 - cy, w // 2 - cx)
    side = int(math.fmod(direction + 5 * math.pi / 4, 2 * math.pi) * 2 / math.pi)

    def key(g):
        dy, dx = g[0] * size + size // 2 - cy, g[1] * size + size // 2 - cx
        return max(abs(dx), abs(dy)), round(math.remainder(math.atan2(dy, dx) + math.pi / 4 + side * (math.pi / 2), 2 * math.pi), 9)

    want = sorted(np.ndindex(-(-h // size), -(-w // size)), key=key)
    assert [(r.gy, r.gx) for r in M.centre_first(size)(_pixels(spark, [np.zeros(shape)])).orderBy("place").collect()] == want


def test_flat_cells(spark):
    image = np.random.default_rng(11).random((21, 26, 3))
    image[3:18, 4:21] = 0.5
    image[8, 8] = 0.5 + 5e-5
    want = set()
    for cy in range(1, 21 // 4 - 1):
        for cx in range(1, 26 // 4 - 1):
            base = image[4 * cy, 4 * cx]
            flat = np.abs(image[4 * cy : 4 * cy + 4, 4 * cx : 4 * cx + 4] - base).max() <= 1e-4
            same = sum(np.abs(image[4 * y, 4 * x] - base).max() <= 1e-4 for y in range(cy - 1, cy + 2) for x in range(cx - 1, cx + 2))
            if flat and same >= 8:
                want.add((cy, cx))
    assert {(r.cy, r.cx) for r in N.flat_cells()(_colours(spark, [image])).collect()} == want and want


def test_corners_parts_and_repeated_points(spark):
    parts = spark.createDataFrame([(0, y, x) for y in range(3) for x in range(4) if (y, x) != (1, 2)], "image_id long, y long, x long")
    got = {(r.y, r.x) for r in L.ready_corners(3, 4)(parts).collect()}
    assert got == {(y, x) for y in range(4) for x in range(5) if not (y in (1, 2) and x in (2, 3))}
    numbers = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 3), (2, 1)], "image_id long, part long")
    assert [(r.image_id, r.ready) for r in M.READY_PARTS(numbers).collect()] == [(1, 2)]
    points = spark.createDataFrame([(0, i, *p) for i, p in enumerate([(0.0, 0.0), (4.0, 9.0), (4.0, 9.0), (10.0, 2.0)])], "stream long, pos long, px double, py double")
    assert L.catmull_rom()(points).count() == 32


def test_hlg_and_tone_mapping(spark):
    image = np.random.default_rng(12).random((4, 5, 3))
    image[0, 0] = 0
    gamma = 1.2 * 1.111 ** math.log2(0.4) * 0.98 ** math.log2(4)
    light = image @ [0.2627, 0.678, 0.0593]
    want = image * np.where(light > 0, np.maximum(light, 1e-30) ** (gamma - 1), 1)[..., None]
    assert P.hlg_gamma(400, 20) == pytest.approx(gamma)
    assert np.allclose(_image(P.hlg_ootf(gamma)(_colours(spark, [image])).collect(), (4, 5), "rgb"), want, atol=2e-6)

    def pq(nits):
        p = (np.asarray(nits) / 10000) ** (2610 / 16384)
        return ((3424 / 4096 + 2413 / 128 * p) / (1 + 2392 / 128 * p)) ** (2523 / 32)

    def nits(code):
        p = code ** (32 / 2523)
        return (np.maximum(p - 3424 / 4096, 0) / (2413 / 128 - 2392 / 128 * p)) ** (16384 / 2610) * 10000

    (s0, s1), (t0, t1) = (0.005, 1000.0), (0.05, 250.0)
    low, reach = pq(s0), pq(s1) - pq(s0)
    least, most = (pq(t0) - low) / reach, (pq(t1) - low) / reach
    knee = 1.5 * most - 0.5
    e = np.minimum(1, (pq(light * s1) - low) / reach)
    t = (e - knee) / (1 - knee)
    e = np.where(e < knee, e, (2 * t**3 - 3 * t**2 + 1) * knee + (t**3 - 2 * t**2 + t) * (1 - knee) + (-2 * t**3 + 3 * t**2) * most)
    shown = np.clip(nits((e + least * (1 - e) ** 4) * reach + low), 0, t1)
    want = np.where(light[..., None] * s1 <= 1e-6, shown[..., None] / t1, image * (shown / np.maximum(light * s1, 1e-6) * s1 / t1)[..., None])
    assert np.allclose(_image(P.tone_map((s0, s1), (t0, t1))(_colours(spark, [image])).collect(), (4, 5), "rgb"), want, atol=3e-6)


def test_cost_counts_pixels(spark):
    near = N.NEIGHBOURS(_pixels(spark, [np.random.default_rng(13).integers(0, 9, (5, 7))]))
    assert E.IMAGE_COST(N.CONTEXT(near)).first().pixels == 35
