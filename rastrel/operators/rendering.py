"""Between stored and shown images: upsampling, colour encodings, dynamic range, sensitivity, quantisation tables, choices of transform."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rastrel.functions import pointwise as P
from rastrel.functions.pointwise import d, dot, half_even
from rastrel.operators.neighbourhood import _COLUMNS, _IMAGE_COLUMNS, _IMAGE_ROWS, _ROWS, one_pass, shifted
from rastrel.plans.steps import Operator

# The upper half of a symmetric table, row by row, of the kernels of one quarter of a pixel's children.
UPSAMPLE_2 = (
    -0.01716200, -0.03452303, -0.04022174, -0.02921014, -0.00624645, 0.14111091, 0.28896755, 0.00278718, -0.01610267, 0.56661550, 0.03777607, -0.01986694, -0.03144731, -0.01185068, -0.00213539,
)
UPSAMPLE_4 = (
    -0.02419067, -0.03491987, -0.03693351, -0.03094285, -0.00529785, -0.01663432, -0.03556863, -0.03888905, -0.03516850, -0.00989469, 0.23651958, 0.33392945, -0.01073543, -0.01313181, -0.03556694,
    0.13048175, 0.40103025, 0.03951150, -0.02077584, 0.46914198, -0.00209270, -0.01484589, -0.04064806, 0.18942530, 0.56279892, 0.06674400, -0.02335494, -0.03551682, -0.00754830, -0.02267919,
    -0.02363578, 0.00315804, -0.03399098, -0.01359519, -0.00091653, -0.00335467, -0.01163294, -0.01610294, -0.00974088, -0.00191622, -0.01095446, -0.03198464, -0.04455121, -0.02799790, -0.00645912,
    0.06390599, 0.22963888, 0.00630981, -0.01897349, 0.67537268, 0.08483369, -0.02534994, -0.02205197, -0.01667999, -0.00384443,
)


def kernels(weights: tuple[float, ...]) -> dict[tuple[int, int], np.ndarray]:
    """The 5x5 kernel of each child pixel (row, column) from the table; mirrored in the other three quarters."""
    half = next(h for h in (1, 2, 4) if len(weights) == 5 * h * (5 * h + 1) // 2)
    table = np.zeros((5 * half, 5 * half))
    table[np.triu_indices(5 * half)] = weights
    table = table + np.triu(table, 1).T
    quarter = {(y, x): table[5 * y : 5 * y + 5, 5 * x : 5 * x + 5] for y in range(half) for x in range(half)}
    n = 2 * half
    return {(y, x): quarter[min(y, n - 1 - y), min(x, n - 1 - x)][:: 1 if y < half else -1, :: 1 if x < half else -1] for y in range(n) for x in range(n)}


def upsample(weights: tuple[float, ...] = UPSAMPLE_2) -> Operator:
    """Two, four or eight times the size by the table's kernels over the 5x5 pixels around, mirrored at borders, held between their least and greatest."""
    own = kernels(weights)
    n = math.isqrt(len(own))
    rows = [f"t{i}" for i in range(5)]
    down = ", ".join(f"{shifted('v', i - 2, 'k')} AS t{i}" for i in range(5))
    along = ", ".join(f"{shifted(t, j - 2, 'r')} AS {t}{j}" for t in rows for j in range(5))
    near = [f"{t}{j}" for t in rows for j in range(5)]
    source = f"({one_pass(f'image_id, c, y, x, {along}', f'({one_pass(f"image_id, c, y, x, {down}", "{src}", _COLUMNS)})', _ROWS)})"
    sums = " ".join(f"WHEN {y * n + x} THEN " + " + ".join(f"{d(float(k[i][j]))} * t{i}{j}" for i in range(5) for j in range(5)) for (y, x), k in own.items())
    return Operator(f"""
SELECT image_id, c, y * {n} + k.k DIV {n} AS y, x * {n} + k.k % {n} AS x, ROUND(GREATEST(LEAST({', '.join(near)}), LEAST(GREATEST({', '.join(near)}), CASE k.k {sums} END)), 6) AS v
FROM {source} CROSS JOIN (VALUES {', '.join(f'({k})' for k in range(n * n))}) k(k)""")


@dataclass(frozen=True)
class Encoding:
    """White point and primaries as chromaticities, and the transfer function by name."""

    curve: str
    primaries: tuple[tuple[float, float], ...] = ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06))
    white: tuple[float, float] = (0.3127, 0.3290)


# Chromaticities of common spaces, and the cone responses that white points are adapted by.
WIDE = ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046))
CINEMA = ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060))
CONES = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])
CURVES: dict[str, tuple[Callable[[str], str], Callable[[str], str]]] = {
    "linear": (lambda x: x, lambda x: x), "srgb": (P.srgb_encode, P.srgb_decode), "709": (P.bt709_encode, P.bt709_decode), "pq": (P.pq_encode, P.pq_decode), "hlg": (P.hlg_encode, P.hlg_decode),
    "gamma22": (lambda x: f"(SIGN({x}) * POWER(ABS({x}), {d(1 / 2.2)}))", lambda x: f"(SIGN({x}) * POWER(ABS({x}), 2.2D))"),
}


def to_xyz(e: Encoding) -> np.ndarray:
    """The matrix from the space's linear light to tristimulus values of white (0.9642, 1, 0.8249)."""
    xyz = lambda c: np.array([c[0] / c[1], 1.0, (1 - c[0] - c[1]) / c[1]])
    columns = np.stack([xyz(p) for p in e.primaries], axis=1)
    own = columns * np.linalg.solve(columns, xyz(e.white))
    to = CONES @ np.array([0.9642, 1.0, 0.8249]) / (CONES @ xyz(e.white))
    return np.linalg.inv(CONES) @ np.diag(to) @ CONES @ own


def to_linear(curve: str) -> Operator:
    return Operator("SELECT image_id, y, x, " + ", ".join(f"{CURVES[curve][1](n)} AS {n}" for n in "rgb") + " FROM {src}")


def from_linear(curve: str) -> Operator:
    return Operator("SELECT image_id, y, x, " + ", ".join(f"{CURVES[curve][0](n)} AS {n}" for n in "rgb") + " FROM {src}")


def convert(src: Encoding, dst: Encoding) -> Operator:
    """Colours from one encoding to another: to linear light, one matrix, and on to the other curve; what needs no step has none."""
    matrix = np.linalg.solve(to_xyz(dst), to_xyz(src))
    light = "{src}" if src.curve == "linear" else f"({to_linear(src.curve).sql})"
    mixed = light if np.allclose(matrix, np.eye(3), atol=1e-12) else f"(SELECT image_id, y, x, {', '.join(f'{dot(map(float, row), 'rgb')} AS {n}' for row, n in zip(matrix, 'rgb', strict=True))} FROM {light})"
    return Operator("SELECT image_id, y, x, " + ", ".join(f"ROUND({CURVES[dst.curve][0](n)}, 6) AS {n}" for n in "rgb") + f" FROM {mixed}")


def pq_to_hlg(pixels, peak: float = 1000.0, source: float = 4000.0):
    """PQ-coded wide-gamut images for HLG displays: light relative to the source's peak, tone-mapped, back to the scene, into gamut, coded."""
    light = Operator("SELECT image_id, y, x, " + ", ".join(f"{P.pq_decode(n)} * {d(10000 / source)} AS {n}" for n in "rgb") + " FROM {src}")(pixels)
    return P.ROUNDED(from_linear("hlg")(P.gamut_map()(P.hlg_ootf(1 / P.hlg_gamma(peak))(P.tone_map((0.0, source), (0.0, peak))(light)))))


def render_hlg(pixels, peak: float = 1000.0):
    """HLG-coded images as display light of that peak, into gamut and PQ-coded."""
    shown = P.gamut_map()(P.hlg_ootf(P.hlg_gamma(peak))(to_linear("hlg")(pixels)))
    return Operator("SELECT image_id, y, x, " + ", ".join(f"ROUND({P.pq_encode(f'({n} * {d(peak / 10000)})')}, 6) AS {n}" for n in "rgb") + " FROM {src}")(shown)


def asymmetric_l2(above: float, below: float) -> Operator:
    """Weighted squared difference of planes (image_id, y, x, a, b): a part for any, and one for b being weaker than 0.4 of a, stronger than a, or of the other sign."""
    far = "CASE WHEN a < 0D THEN CASE WHEN b > -0.4D * ABS(a) THEN b + 0.4D * ABS(a) WHEN b < -ABS(a) THEN -b - ABS(a) ELSE 0D END ELSE CASE WHEN b < 0.4D * ABS(a) THEN 0.4D * ABS(a) - b WHEN b > ABS(a) THEN b - ABS(a) ELSE 0D END END"
    return Operator(f"SELECT image_id, ROUND(SUM((a - b) * (a - b)), 6) AS l2, ROUND(SUM({d(0.8 * above)} * (a - b) * (a - b) + {d(0.8 * below)} * POWER({far}, 2D)), 6) AS asymmetric FROM {{src}} GROUP BY image_id")


# What the three receptors absorb of linear light, with their bias, and the curve of their response.
_RECEPTORS = ((0.29956550340058319, 0.63373087833825936, 0.077705617820981968, 1.7557483643287353), (0.22158691104574774, 0.69391388044116142, 0.0987313588422, 1.7557483643287353), (0.02, 0.02, 0.20480129041026129, 12.226454707163354))
_RESPONSE = (19.245013259874995, 9.9710635769299145, -23.16046239805755)


def sensitivity(peak: float = 80.0) -> Operator:
    """Opponent colours by receptors whose sensitivity follows the light around, a mirrored 5x5 Gaussian of 1.2."""
    w = [math.exp(-k * k / (2 * 1.2 * 1.2)) for k in range(-2, 3)]
    w = [v / sum(w) for v in w]
    mean = lambda n, win: " + ".join(f"{d(v)} * {shifted(n, k, win)}" for k, v in zip(range(-2, 3), w, strict=True))
    first = one_pass("image_id, y, x, r, g, b, " + ", ".join(f"{mean(n, 'k')} AS {n}_" for n in "rgb"), "{src}", _IMAGE_COLUMNS)
    second = one_pass("image_id, y, x, r, g, b, " + ", ".join(f"{mean(f'{n}_', 'r')} AS {n}m" for n in "rgb"), f"({first})", _IMAGE_ROWS)
    absorb = lambda row, names: f"({dot([v * peak for v in row[:3]], names)} + {d(row[3])})"
    parts = []
    for i, row in enumerate(_RECEPTORS):
        before = f"GREATEST({absorb(row, ['rm', 'gm', 'bm'])}, {d(row[3])})"
        curve = f"({d(_RESPONSE[0])} * LN({before} + {d(_RESPONSE[1])}) + {d(_RESPONSE[2])})"
        parts.append(f"GREATEST({d(row[3])}, {absorb(row, 'rgb')} * GREATEST(1e-4D, {curve} / {before})) AS m{i}")
    return Operator(f"SELECT image_id, y, x, ROUND(m0 - m1, 6) AS ox, ROUND(m0 + m1, 6) AS oy, ROUND(m2, 6) AS ob FROM (SELECT image_id, y, x, {', '.join(parts)} FROM ({second}))")


def quant_table(bands: tuple[tuple[float, ...], ...], rows: int = 8, columns: int = 8) -> Operator:
    """Weights of coefficients by their distance from the mean: bands a channel, the first a weight, each other the step to it; straight in the logarithm between."""
    grow = lambda v: 1 + v if v > 0 else 1 / (1 - v)
    values = []
    for own in bands:
        values.append([own[0]])
        for v in own[1:]:
            values[-1].append(values[-1][-1] * grow(v))
    reach = (len(bands[0]) - 1) / (math.sqrt(2) + 1e-6)
    pick = lambda k: "CASE c " + " ".join(f"WHEN {c} THEN ELEMENT_AT(ARRAY({', '.join(d(v) for v in own)}), CAST({k} AS INT))" for c, own in enumerate(values)) + " END"
    grid = f"(SELECT c.k AS c, a.k AS u, b.k AS w FROM (VALUES {', '.join(f'({k})' for k in range(len(bands)))}) c(k) CROSS JOIN (VALUES {', '.join(f'({k})' for k in range(rows))}) a(k) CROSS JOIN (VALUES {', '.join(f'({k})' for k in range(columns))}) b(k))"
    return Operator(f"""
SELECT c, u, w, ROUND({pick('k + 1')} * POWER({pick('k + 2')} / {pick('k + 1')}, far - k), 6) AS weight FROM (
  SELECT c, u, w, far, FLOOR(far) AS k FROM (SELECT c, u, w, SQRT(POWER(u * {d(reach / (rows - 1))}, 2D) + POWER(w * {d(reach / (columns - 1))}, 2D)) AS far FROM {grid})) CROSS JOIN (SELECT COUNT(*) AS n FROM {{src}})""")


def root_cost(step: float) -> Operator:
    """Sum of the roots of quantised coefficients of each block of a transform, and how many are not zero."""
    q = half_even(f"(v / {d(step)})")
    return Operator(f"SELECT image_id, c, cy, cx, ROUND(SUM(SQRT(ABS(q))), 4) AS cost, CAST(SUM(CASE WHEN q <> 0D THEN 1 ELSE 0 END) AS BIGINT) AS nonzeros FROM (SELECT image_id, c, cy, cx, {q} AS q FROM {{src}}) GROUP BY image_id, c, cy, cx")


def best_transform(overhead: float = 4.0) -> Operator:
    """For each square of two by two blocks the cheaper of one transform ({large}) and four ({src}), each with a cost of its own; costs as root_cost gives them, channels added up."""
    return Operator(f"""
SELECT p.image_id, p.cy, p.cx, CASE WHEN q.cost + {d(overhead)} < p.cost + {d(4 * overhead)} THEN 1 ELSE 4 END AS transforms, ROUND(LEAST(q.cost + {d(overhead)}, p.cost + {d(4 * overhead)}), 4) AS cost FROM (
  SELECT image_id, cy DIV 2 AS cy, cx DIV 2 AS cx, SUM(cost) AS cost FROM {{src}} GROUP BY image_id, cy DIV 2, cx DIV 2) p
JOIN (SELECT image_id, cy, cx, SUM(cost) AS cost FROM {{large}} GROUP BY image_id, cy, cx) q ON q.image_id = p.image_id AND q.cy = p.cy AND q.cx = p.cx""")


#: The channels of a transformed image as planes.
PLANES_OF_THREE = Operator("SELECT image_id, CAST(0 AS BIGINT) AS label, CAST(k.k AS BIGINT) AS c, y, x, CASE k.k WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END AS v FROM {src} CROSS JOIN (VALUES (0), (1), (2)) k(k)")
#: One context for each channel and packed residuals of the clamped gradient, as a fast coder has them.
ONE_CONTEXT = Operator(f"SELECT image_id, label, c AS ctx, {P.pack('(v - GREATEST(LEAST(n, w), LEAST(GREATEST(n, w), n + w - nw)))')} AS packed FROM {{src}}")


def tiles(most: int = 2048, step: int = 8) -> Operator:
    """Which tile of an image each pixel is in, tiles being as large as `most`, a multiple of step, and what is left at the border; one row a tile."""
    side = most // step * step
    return Operator(f"SELECT image_id, y DIV {side} AS ty, x DIV {side} AS tx, MAX(y) - MIN(y) + 1 AS height, MAX(x) - MIN(x) + 1 AS width, COUNT(DISTINCT c) AS channels, COUNT(*) AS samples FROM {{src}} GROUP BY image_id, y DIV {side}, x DIV {side}")


def _slope(x: float, a: np.ndarray, b: np.ndarray, distance: float) -> float:
    v = a * x + b
    return 2 * distance * len(a) * x + float(np.where(np.abs(v) >= 100, 0, 2 / 3 * a * (np.abs(v) + 1) * np.where(v < 0, -1, 1)).sum())


def cfl_newton(m: np.ndarray, s: np.ndarray, base: float = 0.0, distance: float = 1e-3) -> int:
    """How much chroma follows luma by a cost that grows less than the square and stops at large residuals: up to twenty damped Newton steps, then drawn to zero and rounded."""
    a, b, x = m / 84, base * m - s, 0.0
    for _ in range(20 if len(m) else 0):
        curve = (_slope(x + 100, a, b, distance) - _slope(x - 100, a, b, distance)) / 200
        step = _slope(x, a, b, distance) / (curve + 0.85)
        x -= min(20.0, max(-20.0, step))
        if abs(step) < 3e-3:
            break
    x = x - 2.6 if x >= 2.6 else x + 2.6 if x <= -2.6 else 0.0
    return int(min(127, max(-128, math.floor(abs(x) + 0.5) * (1 if x > 0 else -1))))


def cfl_search(tiles_: DataFrame) -> DataFrame:
    """(image_id, multiplier) for tiles (image_id, y, x, m, s); a tile is one task's work."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x"])
        return pd.DataFrame({"image_id": [frame["image_id"].iloc[0]], "multiplier": [cfl_newton(frame["m"].to_numpy(float), frame["s"].to_numpy(float))]})

    return tiles_.select("image_id", "y", "x", "m", "s").groupBy("image_id").applyInPandas(run, "image_id long, multiplier long")
