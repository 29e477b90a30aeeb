"""Smaller operators over pixels, blocks, frames and streams: noise, erosion, fields, orders, tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rastrel.functions.pointwise import BIAS, d
from rastrel.operators.neighbourhood import ring
from rastrel.plans.steps import Operator

_BLOCK = 8
_AT = [(y, x) for y in range(_BLOCK) for x in range(_BLOCK)]
# The filter that noise is measured by.
LAPLACE = ((-0.25, -1.0, -0.25), (-1.0, 5.0, -1.0), (-0.25, -1.0, -0.25))
_MEAN = ", ".join(f"MAX(CASE WHEN y % 8 = {y} AND x % 8 = {x} THEN 0.5D * (a + b) END) AS p{y}_{x}" for y, x in _AT)


def _sad(dy: int, dx: int) -> str:
    """Difference of the 4x3 patch at (dy, dx) from the one at (2, 2)."""
    return "(" + " + ".join(f"ABS(p{2 + y}_{2 + x} - p{dy + y}_{dx + x})" for y in range(4) for x in range(3)) + ")"


def _filtered(y: int, x: int) -> str:
    """The filter at a pixel of the block; beyond the block it reads the pixel on the other side."""
    def at(p: int, k: int) -> int:
        return p + k if 0 <= p + k < _BLOCK else p - k

    return "ABS(" + " + ".join(f"{d(LAPLACE[i + 1][j + 1])} * p{at(y, i)}_{at(x, j)}" for i in (-1, 0, 1) for j in (-1, 0, 1)) + ")"


#: Texture, intensity and noise of the whole 8x8 blocks of two planes' mean (image_id, y, x, a, b): one aggregation, then expressions.
NOISE_LEVELS = Operator(f"""
SELECT image_id, cy, cx, ROUND(({' + '.join(f'ELEMENT_AT(sads, {k})' for k in range(1, 11))}) / 10D, 6) AS texture, ROUND(({' + '.join(f'p{y}_{x}' for y, x in _AT)}) / 64D, 6) AS intensity, ROUND(({' + '.join(_filtered(y, x) for y, x in _AT)}) / 64D, 6) AS noise FROM (
  SELECT *, ARRAY_SORT(ARRAY({', '.join(_sad(y, x) for y in range(4) for x in range(5))})) AS sads FROM (
    SELECT image_id, y DIV 8 AS cy, x DIV 8 AS cx, {_MEAN}, COUNT(*) AS n FROM {{src}} GROUP BY image_id, y DIV 8, x DIV 8) WHERE n = 64)""")


def flat_noise(most: float) -> Operator:
    """Intensity and noise of the blocks without much texture."""
    return Operator(f"SELECT image_id, cy, cx, intensity, noise FROM {{src}} WHERE texture <= {d(most)}")


def noise_quantiles(shares: tuple[float, ...] = (0.25, 0.5, 0.75), bins: int = 256) -> Operator:
    """Quantiles of histograms (ctx, symbol, n) with so many bins. The total counts one more, and the way to the next bin is its count by what the sum misses."""
    return Operator(f"""
SELECT ctx, share, ROUND(CASE WHEN upto = target THEN bin + 0.5D ELSE LEAST({bins - 1}D, GREATEST(0D, following * weight + bin * (1D - weight))) END, 4) AS quantile FROM (
  SELECT *, CASE WHEN upto = target THEN 0D ELSE COALESCE(ahead, CASE WHEN bin = {bins - 1} THEN n ELSE 0 END) * 1D / (target - upto) END AS weight FROM (
    SELECT ctx, share, target, MIN(symbol) AS bin, MIN_BY(upto, symbol) AS upto, MIN_BY(n, symbol) AS n, MIN_BY(following, symbol) AS following, MIN_BY(ahead, symbol) AS ahead FROM (
      SELECT h.ctx, h.symbol, h.n, h.upto, COALESCE(h.following, {bins}) AS following, h.ahead, k.q AS share, CAST(FLOOR(k.q * (h.total + 1)) AS BIGINT) AS target FROM (
        SELECT ctx, symbol, n, SUM(n) OVER (PARTITION BY ctx ORDER BY symbol) AS upto, SUM(n) OVER (PARTITION BY ctx) AS total, LEAD(symbol) OVER (PARTITION BY ctx ORDER BY symbol) AS following, LEAD(n) OVER (PARTITION BY ctx ORDER BY symbol) AS ahead FROM {{src}}) h
      CROSS JOIN (VALUES {', '.join(f'({d(q)})' for q in shares)}) k(q)) WHERE upto >= target GROUP BY ctx, share, target))""")


def erode_far(step: int = 3) -> Operator:
    """The three smallest of a value, twice itself, and its eight neighbours so many pixels away, weighted; what lies outside counts as twice the value."""
    near = [f"{f}({n}, {step}) OVER r" for n in ("v", "up", "down") for f in ("LAG", "LEAD")] + ["up", "down"]
    values = ", ".join(["v", "2 * v", "2 * v", *[f"COALESCE({e}, 2 * v)" for e in near]])
    return Operator(f"""
SELECT image_id, c, y, x, ROUND(0.45D * ELEMENT_AT(low, 1) + 0.3D * ELEMENT_AT(low, 2) + 0.25D * ELEMENT_AT(low, 3), 6) AS v FROM (
  SELECT image_id, c, y, x, ARRAY_SORT(ARRAY({values})) AS low FROM (
    SELECT *, LAG(v, {step}) OVER k AS up, LEAD(v, {step}) OVER k AS down FROM {{src}} WINDOW k AS (PARTITION BY image_id, c, x ORDER BY y)) WINDOW r AS (PARTITION BY image_id, c, y ORDER BY x))""")


# The mask's filter, beside and diagonal to the centre, two away, a knight's move away, and two diagonally.
_MASK = (0.364911248, 0.05, 0.1688888021, 0.221069183, 0.306563504)
MASK_BLUR = {k: v / (1 + 4 * (_MASK[0] + _MASK[1] + _MASK[2] + _MASK[4] + 2 * _MASK[3])) for k, v in ring({(0, 0): 1.0, (0, 1): _MASK[0], (1, 1): _MASK[1], (0, 2): _MASK[2], (1, 2): _MASK[3], (2, 2): _MASK[4]}, normalise=False).items()}


def separable(along: tuple[float, float, float], across: tuple[float, float, float]) -> dict[tuple[int, int], float]:
    """A 5x5 kernel as the product of two symmetric ones, each by its centre and the two weights beside it."""
    return {(dy, dx): across[abs(dy)] * along[abs(dx)] for dy in range(-2, 3) for dx in range(-2, 3)}


def _between(axis: str) -> Operator:
    keep = {"x": "image_id, c, y", "y": "image_id, c, x"}[axis]
    w = f"OVER (PARTITION BY {keep} ORDER BY {axis})"
    last = f"COALESCE(LEAD(v) {w}, v)"
    return Operator(f"""
SELECT {keep}, 2 * {axis} + k.k AS {axis}, CASE k.k WHEN 0 THEN v ELSE mid END AS v FROM (
  SELECT image_id, c, y, x, v, 0.5625D * (v + {last}) - 0.0625D * (COALESCE(LAG(v) {w}, v) + COALESCE(LEAD(v, 2) {w}, {last})) AS mid FROM {{src}}) CROSS JOIN (VALUES (0), (1)) k(k)""")


#: Twice the width, and twice the height, by four taps; the border's pixel goes on.
UPSAMPLE_H, UPSAMPLE_V = _between("x"), _between("y")
# What low frequencies of the opponent colours weigh, how much of blue is luma, and how luma hides colour.
_VALS, _LUMA_IN_BLUE, _HIDE, _STAYS = (33.832837186260, 14.458268100570, 49.87984651440), -0.362267051518, 46.0, 0.653020556257
LOW_VALUES = Operator(f"SELECT image_id, y, x, ROUND(xx * {d(_VALS[0])}, 6) AS vx, ROUND(yy * {d(_VALS[1])}, 6) AS vy, ROUND((bb + {d(_LUMA_IN_BLUE)} * yy) * {d(_VALS[2])}, 6) AS vb FROM {{src}}")
SUPPRESS_BY_LUMA = Operator(f"SELECT image_id, y, x, ROUND(xx * ({d(_HIDE)} / (yy * yy + {d(_HIDE)}) * {d(1 - _STAYS)} + {d(_STAYS)}), 8) AS xx FROM {{src}}")
# Photons, efficiency, unevenness, read noise and area (square micrometres) of a sensor, and what makes a strength of it.
_PHOTONS, _CAUGHT, _UNEVEN, _READ, _AREA, _STRENGTH, _MOST = 11260.0, 0.2, 0.005, 3.0, 36000.0 * 24000.0, 0.22 * 2**0.5 * 1.13, 1.0


def photon_noise(most: float = _MOST) -> Operator:
    """Eight points of noise strength for a camera's sensitivity (image_id, width, height, iso)."""
    root = d(BIAS ** (1 / 3))
    return Operator(f"""
SELECT image_id, k AS point, ROUND(LEAST({d(most)}, GREATEST(0D, SQRT({d(_READ * _READ)} + electrons + POWER({d(_UNEVEN)} * electrons, 2D)) * (0.18D / grey) / 3D / POWER(POWER(ABS(light - {d(BIAS)}), {d(1 / 3)}), 2D) / {d(_STRENGTH)})), 6) AS strength FROM (
  SELECT *, grey * light / 0.18D AS electrons FROM (
    SELECT image_id, k.k AS k, {d(_CAUGHT * _PHOTONS * 10)} / iso * {d(_AREA)} / (width * height) AS grey, GREATEST(0D, POWER(2D * k.k / 6D - {root}, 3D) + {d(BIAS)}) AS light FROM {{src}} CROSS JOIN (VALUES {', '.join(f'({k})' for k in range(8))}) k(k)))""")


def add_noise(to_x: float = 0.0, to_b: float = 1.0) -> Operator:
    """Noise (image_id, y, x, n0, n1, shared) on opponent colours with a strength for each half, nearly all of it shared."""
    own = lambda n, s: f"{s} * (0.0078125D * n.{n} + 0.9921875D * n.shared)"
    red, green = own("n0", "p.strength_r"), own("n1", "p.strength_g")
    return Operator(f"SELECT p.image_id, p.y, p.x, ROUND(p.xx + {d(to_x)} * ({red} + {green}) + ({red} - {green}), 6) AS xx, ROUND(p.yy + {red} + {green}, 6) AS yy, ROUND(p.bb + {d(to_b)} * ({red} + {green}), 6) AS bb FROM {{src}} p JOIN {{noise}} n ON n.image_id = p.image_id AND n.y = p.y AND n.x = p.x")


# What a filter's strength is divided by, and its share of the quantiser's step.
_INV_SIGMA, _QUANT_SHARE, _SHARP = -1.1715728752538099, 0.46, 8


def filter_sigma(scale: float, share: float = _QUANT_SHARE) -> Operator:
    """Inverse strength of the edge-preserving filter of each block (image_id, cy, cx, quant, sharpness 0 to 7)."""
    return Operator(f"SELECT image_id, cy, cx, ROUND(1D / LEAST(-1e-4D, {d(share)} / ({d(scale * _INV_SIGMA)} * quant) * sharpness / {d(_SHARP - 1.0)}), 6) AS inv_sigma FROM {{src}}")


def adjust_quant(target: float) -> Operator:
    """One value for all blocks of a transform (image_id, part, cy, cx, quant): their greatest, for four blocks and more towards their mean the larger the target."""
    mix = 1.0 if target <= 1.54138 else max(0.0, 1 - (target - 1.54138) * 0.56391)
    return Operator(f"SELECT image_id, part, cy, cx, ROUND(CASE WHEN n >= 4 THEN {d(mix)} * top + {d(1 - mix)} * mean ELSE top END, 6) AS quant FROM (SELECT *, COUNT(*) OVER w AS n, MAX(quant) OVER w AS top, AVG(quant) OVER w AS mean FROM {{src}} WINDOW w AS (PARTITION BY image_id, part))")


def distinct_samples(columns: list[str]) -> Operator:
    """Samples that agree in all columns as one, with how many they are."""
    names = ", ".join(columns)
    return Operator(f"SELECT {names}, COUNT(*) AS samples FROM {{src}} GROUP BY {names}")


#: Values (stream, pos, v) as numbers of the buckets between the thresholds of their stream ({at}: ctx, threshold).
BUCKETED = Operator("SELECT p.stream, p.pos, p.v, COUNT(DISTINCT q.threshold) AS bucket FROM {src} p LEFT JOIN {at} q ON q.ctx = p.stream AND p.v > q.threshold GROUP BY p.stream, p.pos, p.v")


def _order_context(v: str) -> str:
    return f"(CASE WHEN {v} = 0 THEN 0 ELSE LEAST(7, LENGTH(BIN({v}))) END)"


def permutation_tokens(skip: int = 0) -> Operator:
    """Lehmer codes (stream, pos, code) as tokens: how many are left to the last that is not zero, then those, each in the context of the one before."""
    return Operator(f"""
SELECT stream, CAST(-1 AS BIGINT) AS pos, {_order_context('size')} AS ctx, GREATEST(ends - {skip}, 0) AS value FROM (SELECT stream, COUNT(*) AS size, COALESCE(MAX(CASE WHEN code > 0 THEN pos + 1 END), 0) AS ends FROM {{src}} GROUP BY stream)
UNION ALL SELECT stream, pos, {_order_context('before')} AS ctx, code AS value FROM (
  SELECT stream, pos, code, CASE WHEN pos = {skip} THEN 0 ELSE COALESCE(LAG(code) OVER (PARTITION BY stream ORDER BY pos), 0) END AS before, MAX(CASE WHEN code > 0 THEN pos + 1 END) OVER (PARTITION BY stream) AS ends FROM {{src}}) WHERE pos >= {skip} AND pos < ends""")


#: The middle of where the running sum of a stream is greatest, and that sum; 0 and 0 where it never exceeds 0.
SUM_MAXIMUM = Operator("""
SELECT stream, (COALESCE(MIN(CASE WHEN run = top AND top > 0 THEN pos END), 0) + COALESCE(MAX(CASE WHEN run = top THEN pos END), 0) + 1) DIV 2 AS idx, CAST(MAX(top) AS BIGINT) AS sum FROM (
  SELECT stream, pos, run, GREATEST(0, MAX(run) OVER (PARTITION BY stream)) AS top FROM (SELECT stream, pos, SUM(v) OVER (PARTITION BY stream ORDER BY pos) AS run FROM {src})) GROUP BY stream""")


def field_bits(choices: tuple[tuple[int, int] | int, ...]) -> Operator:
    """Bits of a header field (v): two for the choice and its own; a choice is a value, or (bits, offset). Null where none holds the value."""
    costs = [f"CASE WHEN v = {c} THEN 2 END" if isinstance(c, int) else f"CASE WHEN v >= {c[1]} AND v - {c[1]} < {1 << c[0]} THEN {2 + c[0]} END" for c in choices]
    return Operator(f"SELECT stream, pos, v, NULLIF(LEAST({', '.join(f'COALESCE({c}, 999)' for c in costs)}), 999) AS bits FROM {{src}}")


def byte_planes(width: int) -> Operator:
    """Values of records of so many bytes by place in the record: the order in which a table of records is easier to predict."""
    return Operator(f"SELECT stream, ROW_NUMBER() OVER (PARTITION BY stream ORDER BY pos % height, pos) - 1 AS pos, v FROM (SELECT stream, pos, v, (COUNT(*) OVER (PARTITION BY stream) + {width - 1}) DIV {width} AS height FROM {{src}})")


#: Values of 8x8 blocks ({field}: image_id, cy, cx, quant) at every pixel.
BLOCK_TO_PIXELS = Operator("SELECT p.image_id, p.c, p.y, p.x, p.v, q.quant FROM {src} p JOIN {field} q ON q.image_id = p.image_id AND q.cy = p.y DIV 8 AND q.cx = p.x DIV 8")
#: How boxes (id, lo, hi) of a property lie to a query's ({box}: box, low, high): inside, partly, or not at all.
BOX_RELATION = Operator("SELECT p.id, q.box, CASE WHEN p.lo >= q.low AND p.hi <= q.high THEN 'inside' WHEN p.lo > q.high OR p.hi < q.low THEN 'none' ELSE 'partial' END AS relation FROM {src} p CROSS JOIN {box} q")
#: Histograms of clusters out of those of contexts, by the map from one to the other ({map}: ctx, cluster).
MERGED_HISTOGRAMS = Operator("SELECT m.cluster, h.symbol, CAST(SUM(h.n) AS BIGINT) AS n FROM {src} h JOIN {map} m ON m.ctx = h.ctx GROUP BY m.cluster, h.symbol")


def palette_expand(size: int, bits: int = 8, deltas: tuple[tuple[int, int, int], ...] = ((0, 0, 0), (4, 4, 4), (11, 0, 0))) -> Operator:
    """Colours of indices (image_id, y, x, idx): of a palette ({palette}: image_id, idx, p0, p1, p2) of so many, of a coarse and a fine colour cube above it, and differences below 0.

    Differences come from a table in turns negative and positive; a user gives the table that the images were made with.
    """
    table = [f"ELEMENT_AT(ARRAY({', '.join(str(row[c] << max(0, bits - 8)) if row[c] >= 0 else str(-(-row[c] << max(0, bits - 8))) for row in deltas)}), CAST((k + 1) DIV 2 + 1 AS INT)) * CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END" for c in range(3)]
    top = (1 << bits) - 1
    small = [f"((idx - {size}) DIV {4**c} % 4 * {top}) DIV 4 + {1 << max(0, bits - 3)}" for c in range(3)]
    large = [f"((idx - {size + 64}) DIV {5**c} % 5 * {top}) DIV 4" for c in range(3)]
    return Operator(f"""
SELECT image_id, y, x, idx, {', '.join(f'CASE WHEN idx < 0 THEN {table[c]} WHEN idx < {size} THEN p{c} WHEN idx < {size + 64} THEN {small[c]} ELSE {large[c]} END AS v{c}' for c in range(3))} FROM (
  SELECT p.image_id, p.y, p.x, p.idx, -(p.idx + 1) % {2 * len(deltas) - 1} AS k, q.p0, q.p1, q.p2 FROM {{src}} p LEFT JOIN {{palette}} q ON q.image_id = p.image_id AND q.idx = p.idx)""")


def implicit_index(size: int, bits: int = 8) -> Operator:
    """The index of the fine colour cube that is nearest to each colour."""
    top, half = (1 << bits) - 1, 1 << (bits - 1) if bits > 1 else 0
    return Operator(f"SELECT image_id, y, x, {size + 64} + " + " + ".join(f"(4 * v{c} + {half}) DIV {top} * {5**c}" for c in range(3)) + " AS idx FROM {src}")


#: Error of each channel of two images (image_id, c, y, x, a, b): root of the mean square, and the greatest.
CHANNEL_ERRORS = Operator("SELECT image_id, c, ROUND(SQRT(AVG((a - b) * (a - b))), 6) AS rmse, ROUND(MAX(ABS(a - b)), 6) AS peak FROM {src} GROUP BY image_id, c")


def component_stats(margin: int) -> Operator:
    """Bounds, greatest value with its first place, mean and variance inside the bounds and in a margin around, and how far the inside stands out.

    {src}: image_id, y, x, v; {label}: image_id, y, x, part.
    """
    return Operator(f"""
SELECT image_id, part, y0, x0, y1, x1, MAX(v) AS top, MIN_BY(y * width + x, -v * width * 100000 + y * width + x) AS at, ROUND(AVG(CASE WHEN inside THEN v END), 6) AS mean, ROUND(AVG(CASE WHEN inside THEN v * v * 1D END) - POWER(AVG(CASE WHEN inside THEN v END), 2D), 4) AS variance,
  ROUND((AVG(CASE WHEN inside THEN v END) - AVG(CASE WHEN NOT inside THEN v END)) / NULLIF(SQRT(GREATEST(0D, AVG(CASE WHEN NOT inside THEN v * v * 1D END) - POWER(AVG(CASE WHEN NOT inside THEN v END), 2D))), 0D), 4) AS score FROM (
  SELECT q.*, p.y, p.x, p.v, p.width, p.y BETWEEN q.y0 AND q.y1 AND p.x BETWEEN q.x0 AND q.x1 AS inside FROM (SELECT image_id, part, MIN(y) AS y0, MIN(x) AS x0, MAX(y) AS y1, MAX(x) AS x1 FROM {{label}} GROUP BY image_id, part) q
  JOIN (SELECT image_id, y, x, v, MAX(x) OVER (PARTITION BY image_id) + 1 AS width FROM {{src}}) p ON p.image_id = q.image_id AND p.y BETWEEN q.y0 - {margin} AND q.y1 + {margin} AND p.x BETWEEN q.x0 - {margin} AND q.x1 + {margin}) GROUP BY image_id, part, y0, x0, y1, x1""")


#: Whether a frame (kind, mode, part: 1 if it covers less than the canvas, extra: mode of its other channels) has to be put on an earlier one.
NEEDS_BLENDING = Operator("SELECT image_id, frame, CAST(kind IN (0, 3) AND (part = 1 OR mode <> 0 OR extra <> 0) AS INT) AS blended FROM {src}")
#: Frames from one on, numbered anew; ticks start again at 0.
def from_frame(first: int) -> Operator:
    return Operator(f"SELECT image_id, frame - {first} AS frame, size, SUM(duration) OVER (PARTITION BY image_id ORDER BY frame) - duration AS tick FROM {{src}} WHERE frame >= {first}")


# Weights of the channels.
_ALIKE = (30.0, 3.0, 1.0)


def alike(most: float) -> Operator:
    """Pairs of colours that differ little in the opponent colours (x1, y1, b1 and x2, y2, b2)."""
    return Operator("SELECT * FROM {src} WHERE " + " + ".join(f"ABS({n}1 - {n}2) * {d(w)}" for n, w in zip(("xx", "yy", "bb"), _ALIKE, strict=True)) + f" <= {d(most)}")


def squeeze_schedule(width: int, height: int, channels: int, preview: int = 8) -> list[tuple[bool, bool, int, int]]:
    """Steps (horizontal, in place, first channel, how many) that halve an image until both sides are small; two chroma channels first, then the longer side."""
    steps = [(True, False, 1, 2), (False, False, 1, 2)] if channels > 2 else []
    if width <= height and height > preview:
        steps.append((False, True, 0, channels))
        height = (height + 1) // 2
    while width > preview or height > preview:
        if width > preview:
            steps.append((True, True, 0, channels))
            width = (width + 1) // 2
        if height > preview:
            steps.append((False, True, 0, channels))
            height = (height + 1) // 2
    return steps


_WORD = 2**64 - 1
LANES = 8


def _mixed(z: int) -> int:
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _WORD
    z = (z ^ z >> 27) * 0x94D049BB133111EB & _WORD
    return z ^ z >> 31


def random_states(a: int, b: int, c: int, e: int) -> np.ndarray:
    """The two words of state of eight generators that four numbers seed."""
    s = [_mixed((a << 32) + b + 0x9E3779B97F4A7C15 & _WORD)], [_mixed((c << 32) + e + 0x9E3779B97F4A7C15 & _WORD)]
    for _ in range(LANES - 1):
        for k in (0, 1):
            s[k].append(_mixed(s[k][-1]))
    return np.array(s, dtype=np.uint64)


def noise_plane(state: np.ndarray, height: int, width: int) -> np.ndarray:
    """Values from 1 to 2 by xorshift generators, sixteen a step; rows begin with a new step. state goes on."""
    steps = max(1, -(-width // (2 * LANES)))
    out = np.empty((height, steps * 2 * LANES), dtype=np.float32)
    for y in range(height):
        for k in range(steps):
            s1, s0 = state[0].copy(), state[1].copy()
            bits = s1 + s0
            s1 ^= s1 << np.uint64(23)
            state[0], state[1] = s0, s1 ^ s0 ^ (s1 >> np.uint64(18)) ^ (s0 >> np.uint64(5))
            words = bits.astype("<u8").view("<u4")
            out[y, 16 * k : 16 * k + 16] = (words >> np.uint32(9) | np.uint32(0x3F800000)).view(np.float32)
    return out[:, :width]


def noise_image(frames: DataFrame, group: int = 256) -> DataFrame:
    """(image_id, y, x, n0, n1, shared) for frames (image_id, shown, hidden, height, width): each group of pixels is seeded by the frame's numbers and its place."""
    groups = frames.selectExpr("image_id", "shown", "hidden", "height", "width", f"explode(sequence(0, height - 1, {group})) AS y0").selectExpr("*", f"explode(sequence(0, width - 1, {group})) AS x0").repartition("image_id", "y0", "x0")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                h, w = min(group, r.height - r.y0), min(group, r.width - r.x0)
                state = random_states(r.shown, r.hidden, r.x0, r.y0)
                y, x = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({"image_id": r.image_id, "y": y + r.y0, "x": x + r.x0} | {n: noise_plane(state, h, w).ravel().astype(np.float64) for n in ("n0", "n1", "shared")})

    return groups.mapInPandas(run, "image_id long, y long, x long, n0 double, n1 double, shared double")


_RGB, _GREY = "'^RGB_([^_]+)_([^_]+)_([^_]+)_([^_]+)$'", "'^Gra_([^_]+)_([^_]+)_([^_]+)$'"
#: Parts of colour descriptions (id, text) such as RGB_D65_SRG_Rel_SRG or Gra_D65_Rel_SRG; a text of another form has none.
COLOUR_DESCRIPTION = Operator(
    "SELECT id, CASE WHEN n > 0 THEN 'RGB' WHEN k > 0 THEN 'Gra' END AS space, " + ", ".join(
        f"NULLIF(CASE WHEN n > 0 THEN {f'REGEXP_EXTRACT(text, {_RGB}, {i})' if i else 'NULL'} ELSE {f'REGEXP_EXTRACT(text, {_GREY}, {j})' if j else 'NULL'} END, '') AS {name}" for name, i, j in (("white", 1, 1), ("primaries", 2, 0), ("intent", 3, 2), ("curve", 4, 3)))
    + f" FROM (SELECT id, text, LENGTH(REGEXP_EXTRACT(text, {_RGB}, 1)) AS n, LENGTH(REGEXP_EXTRACT(text, {_GREY}, 1)) AS k FROM {{src}})")
#: Named counters of runs (name, value) added up.
MERGED_STATISTICS = Operator("SELECT name, COUNT(*) AS runs, CAST(SUM(value) AS BIGINT) AS value FROM {src} GROUP BY name")
