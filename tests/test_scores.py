"""Scores over several scales against numpy."""

import numpy as np
import pytest

from rastrel.functions.pointwise import ABSORB, BIAS
from rastrel.operators import scores as Q

SHAPES = [(20, 13), (33, 40)]


def _pair(spark, a, b):
    rows = [(k, y, x, *map(float, np.stack([p[y, x], q[y, x]], 1).ravel())) for k, (p, q) in enumerate(zip(a, b, strict=True)) for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, "image_id long, y long, x long, r1 double, r2 double, g1 double, g2 double, b1 double, b2 double")


def _blur(p):
    w = np.exp(-(np.arange(-5, 6) ** 2) / 4.5)
    w /= w.sum()
    for axis in (0, 1):
        p = np.apply_along_axis(lambda v: np.convolve(v, w)[5 : 5 + len(v)], axis, p)
    return p


def _halve(p, f=2):
    h, w = -(-p.shape[0] // f), -(-p.shape[1] // f)
    big = np.pad(p, ((0, h * f - p.shape[0]), (0, w * f - p.shape[1]), (0, 0)), mode="edge")
    return big.reshape(h, f, w, f, -1).mean(axis=(1, 3))


def _opponent(p):
    l, m, s = np.moveaxis(np.cbrt(np.maximum(p @ np.array(ABSORB).T + BIAS, 0)) - np.cbrt(BIAS), 2, 0)  # noqa: E741
    return np.stack([(l - m) * 7 + 0.42, (l + m) / 2 + 0.01, s - (l + m) / 2 + 0.55], 2)


def _lab(p):
    mix = np.array([[0.43393624408206207, 0.3761977906365071, 0.1898342977380344], [0.2126729, 0.7151522, 0.072175], [0.017753810835629014, 0.10945087235996327, 0.8726392102846648]])
    f = p @ mix.T
    f = np.where(f > 0.008856451679035631, np.cbrt(np.maximum(f, 0)) - 0.13793103448275862, 7.787037037037037 * f)
    return np.stack([1.16 * f[..., 1], 0.3918181818181818 + 2.272727272727273 * (f[..., 0] - f[..., 1]), 0.49045454545454545 + 0.9090909090909091 * (f[..., 1] - f[..., 2])], 2)


def _moments(a, b):
    return [np.stack([_blur(v[..., c]) for c in range(3)], 2) for v in (a, b, a * a, b * b, a * b)]


def _multiscale(a, b):
    scales, first = [], True
    while len(scales) < 6 and min(a.shape[:2]) >= 8:
        if not first:
            a, b = _halve(a), _halve(b)
        first = False
        p, q = _opponent(a), _opponent(b)
        ma, mb, aa, bb, ab = _moments(p, q)
        e = np.maximum(0, 1 - (1 - (ma - mb) ** 2) * (2 * (ab - ma * mb) + 0.0009) / ((aa - ma**2) + (bb - mb**2) + 0.0009))
        edge = (1 + np.abs(q - mb)) / (1 + np.abs(p - ma)) - 1
        scales.append([e, np.maximum(edge, 0), np.maximum(-edge, 0)])
    total, i = 0.0, 0
    for c in range(3):
        for maps in scales:
            for power in (1, 4):
                for m in maps:
                    total += Q.WEIGHTS[i] * (m[..., c] ** power).mean() ** (1 / power)
                    i += 1
    total *= 0.9562382616834844
    total = 2.326765642916932 * total - 0.020884521182843837 * total**2 + 6.248496625763138e-05 * total**3
    return len(scales), 100 - 10 * total**0.6276336467831387 if total > 0 else 100.0


def _structure(a, b):
    got = most = 0.0
    a, b = _lab(a), _lab(b)
    scale, first = 0, True
    while scale < 6 and min(a.shape[:2]) >= 8:
        if not first:
            a, b = _halve(a), _halve(b)
        first = False
        ma, mb, aa, bb, ab = _moments(a, b)
        s = (2 * ma * mb + 0.0001) * (2 * (ab - ma * mb) + 0.0004) / ((ma**2 + mb**2 + 0.0001) * ((aa - ma**2) + (bb - mb**2) + 0.0004))
        cells = _halve(s, 4)
        for c in range(3):
            got += Q.OLD_MEAN[scale][c] * s[..., c].mean() + Q.OLD_LEAST[scale][c] * cells[..., c].min()
            most += Q.OLD_MEAN[scale][c] + Q.OLD_LEAST[scale][c]
        if scale == 0:
            edge = 1 - np.maximum(0, np.abs(b - mb) - np.abs(a - ma))
            for c in range(3):
                got += Q.OLD_EDGE[c] * edge[..., c].mean()
                for plane in (cells[..., c], edge[..., c]):
                    for axis in (0, 1):
                        lines = np.sort(plane.mean(axis=axis))
                        got += Q.OLD_GRID[c] * lines[len(lines) // 50]
                most += Q.OLD_EDGE[c] + 4 * Q.OLD_GRID[c]
        scale += 1
    return scale, min(1.0, max(0.0, most / got - 1))


@pytest.mark.parametrize(("query", "want", "slack"), [(Q.multiscale_score, _multiscale, 2e-4), (Q.structure_score, _structure, 2e-6)])
def test_scores(spark, query, want, slack):
    rng = np.random.default_rng(1)
    images = [rng.random((*s, 3)) for s in SHAPES] + [rng.random((7, 30, 3))]
    other = [np.clip(i + rng.normal(size=i.shape) * 0.05, 0, 1) for i in images]
    got = {r.image_id: (r.scales, r.score) for r in query(_pair(spark, images, other)).collect()}
    assert set(got) == {0, 1}  # the third is too small
    for k in got:
        scales, score = want(images[k], other[k])
        assert got[k][0] == scales and got[k][1] == pytest.approx(score, abs=slack)
