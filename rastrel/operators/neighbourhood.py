"""Operators over a pixel's neighbours: predictors, context properties, convolutions, lifting, resampling.

Two window orders (along rows, along columns) give all neighbours; with pixels routed by image both
run without a shuffle of their own. Kernels are joined as small literal tables where a two-pass form
does not exist; borders mirror including the edge unless the operator says otherwise.
"""

from __future__ import annotations

import re

from rastrel.functions.pointwise import d, pack
from rastrel.plans.steps import Operator

_ROWS = "r AS (PARTITION BY image_id, c, y ORDER BY x)"
_COLUMNS = "k AS (PARTITION BY image_id, c, x ORDER BY y)"
#: w, n, nw, ne, ww, nn, nee by the predictors' fall-back rules at borders.
NEIGHBOURS = Operator(f"""
SELECT image_id, label, c, y, x, v, w, n, COALESCE(nw, w) AS nw, COALESCE(ne, n) AS ne, COALESCE(ww, w) AS ww, COALESCE(nn, n) AS nn, COALESCE(nee, ne, n) AS nee FROM (
  SELECT *, COALESCE(w1, n1, 0) AS w, COALESCE(n1, w1, 0) AS n FROM (
    SELECT *, LAG(v, 1) OVER r AS w1, LAG(v, 2) OVER r AS ww, LAG(n1, 1) OVER r AS nw, LEAD(n1, 1) OVER r AS ne, LEAD(n1, 2) OVER r AS nee FROM (
      SELECT *, LAG(v, 1) OVER k AS n1, LAG(v, 2) OVER k AS nn FROM {{src}} WINDOW {_COLUMNS}) WINDOW {_ROWS}))""")
_GRADIENT = "GREATEST(LEAST(n, w), LEAST(GREATEST(n, w), n + w - nw))"
# The predictors' formulas, by name; division truncates.
PREDICTORS = {
    "zero": "0", "left": "w", "top": "n", "average0": "(w + n) DIV 2", "select": "(CASE WHEN ABS(n - nw) < ABS(w - nw) THEN w ELSE n END)", "gradient": _GRADIENT,
    "top_right": "ne", "top_left": "nw", "left_left": "ww", "average1": "(w + nw) DIV 2", "average2": "(nw + n) DIV 2", "average3": "(n + ne) DIV 2",
    "average4": "(6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8) DIV 16",
}
RESIDUALS = Operator("SELECT image_id, label, c, y, x, p.name AS predictor, v - CASE p.name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PREDICTORS.items())
                     + " END AS residual FROM {src} CROSS JOIN (VALUES " + ", ".join(f"('{k}')" for k in PREDICTORS) + ") p(name)")
RESIDUAL_STATS = Operator("SELECT predictor, COUNT(*) AS n, CAST(SUM(ABS(residual)) AS BIGINT) AS sum_abs, MIN(residual) AS low, MAX(residual) AS high FROM {src} GROUP BY predictor")
BEST_PREDICTOR = Operator("""
SELECT image_id, MIN_BY(predictor, cost * 100 + rank) AS predictor, MIN(cost) AS cost FROM (
  SELECT image_id, predictor, CAST(SUM(ABS(residual)) AS BIGINT) AS cost, MIN(CASE predictor """ + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(PREDICTORS)) + """ END) AS rank FROM {src} GROUP BY image_id, predictor)
GROUP BY image_id""")
PROPERTIES = Operator("""
SELECT image_id, c, y, x, ABS(n) AS abs_n, ABS(w) AS abs_w, n, w, w - COALESCE(LAG(w + n - nw) OVER (PARTITION BY image_id, c, y ORDER BY x), 0) AS w_less_gradient, w + n - nw AS gradient, w - nw AS w_nw, nw - n AS nw_n, n - ne AS n_ne, n - nn AS n_nn, w - ww AS w_ww FROM {src}""")
# Where the local range of neighbours changes the context.
CUTOFFS = (0, 1, 3, 5, 7, 11, 15, 23, 31, 47, 63, 95, 127, 191, 255, 392, 500)
#: Context and packed residual of every pixel, for the lossless cost.
CONTEXT = Operator("SELECT image_id, label, ctx, packed FROM (SELECT image_id, label, " + " + ".join(f"CAST(GREATEST(w, n, nw) - LEAST(w, n, nw) < {t} AS INT)" for t in CUTOFFS)
                   + f" AS ctx, {pack(f'(v - {_GRADIENT})')} AS packed FROM {{src}})")


def shifted(column: str, by: int, window: str) -> str:
    """The column's value so many places further along a named window; beyond the border it is mirrored, the edge included.

    Images that are smaller than the reach take their own value where even the mirror ends.
    """
    if not by:
        return column
    ahead, back, n = ("LEAD", "LAG", by) if by > 0 else ("LAG", "LEAD", -by)

    def at(k: int) -> str:
        return column if not k else f"{ahead if k > 0 else back}({column}, {abs(k)}) OVER {window}"

    short = [f"WHEN {at(j)} IS NOT NULL THEN {at(2 * j + 1 - n)}" for j in range(n - 1, 0, -1)]  # j places are left before the border
    rest = f"CASE {' '.join(short)} ELSE {at(1 - n)} END" if short else at(1 - n)
    return f"COALESCE({at(n)}, {rest}, {column})"


def one_pass(select: str, source: str, window: str) -> str:
    """SELECT over a source's neighbours along one window, each LAG and LEAD in the text being computed once."""
    pattern = r"(LAG|LEAD)\((\w+), (\d+)\) OVER (\w+)"
    once = sorted({m.groups() for m in re.finditer(pattern, select)})
    names = ", ".join(f"{f}({n}, {k}) OVER {w} AS {n}_{f.lower()}{k}" for f, n, k, w in once)
    return f"SELECT {re.sub(pattern, lambda m: f'{m[2]}_{m[1].lower()}{m[3]}', select)} FROM (SELECT *, {names} FROM {source} WINDOW {window})" if once else f"SELECT {select} FROM {source}"


def convolve(kernel: dict[tuple[int, int], float], value: str = "v") -> Operator:
    """Weighted sum over offsets (dy, dx) in two window passes: along each column once for every dx, then along rows.

    A pixel stays one row throughout, whatever the kernel's size, and images may have any size.
    """
    across = sorted({dx for _, dx in kernel})
    columns = ", ".join("(" + " + ".join(f"{d(w)} * {shifted(value, dy, 'k')}" for (dy, a), w in sorted(kernel.items()) if a == dx) + f") AS u{i}" for i, dx in enumerate(across))
    total = " + ".join(shifted(f"u{i}", dx, "r") for i, dx in enumerate(across))
    return Operator(one_pass(f"image_id, c, y, x, ROUND({total}, 6) + 0D AS v", f"({one_pass(f'image_id, c, y, x, {columns}', '{src}', _COLUMNS)})", _ROWS))


def ring(weights: dict[tuple[int, int], float], normalise: bool = True) -> dict[tuple[int, int], float]:
    """A symmetric kernel from its weights for 0 <= dx <= dy."""
    full = {(sy * b, sx * a): w for (p, q), w in weights.items() for a, b in ((p, q), (q, p)) for sy in (1, -1) for sx in (1, -1)}
    total = sum(full.values()) if normalise else 1.0
    return {k: w / total for k, w in full.items()}


# The smoothing filter's weights beside the centre, and its approximate inverse's.
GABORISH = ring({(0, 0): 1.0, (0, 1): 1.1 * 0.104699568, (1, 1): 1.1 * 0.055680538})
GABORISH_INVERSE = ring({(0, 0): 1.0, (0, 1): -0.09495815671340026, (1, 1): -0.041031725066768575, (0, 2): 0.013710004822696948, (1, 2): 0.006510206083837737, (2, 2): -0.0014789063378272242})
SMOOTH3 = ring({(0, 0): 4.0, (0, 1): 2.0, (1, 1): 1.0})


def gaussian(sigma: float, radius: int) -> dict[tuple[int, int], float]:
    import math

    return ring({(a, b): math.exp(-(a * a + b * b) / (2 * sigma * sigma)) for b in range(radius + 1) for a in range(b + 1)})


LAPLACIAN = ring({(0, 0): 8.0, (0, 1): -1.0, (1, 1): -1.0}, normalise=False)
_AROUND = "COALESCE(LAG({0}) OVER {1}, {0}) AS {0}_before, COALESCE(LEAD({0}) OVER {1}, {0}) AS {0}_after"
#: Smallest and largest of the 3x3 neighbourhood, and the pixel's smoothed value held between them.
MINMAX = Operator(f"""
SELECT image_id, c, y, x, MIN(lo) OVER (PARTITION BY image_id, c, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS lo, MAX(hi) OVER (PARTITION BY image_id, c, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS hi, v FROM (
  SELECT *, MIN(v) OVER r1 AS lo, MAX(v) OVER r1 AS hi FROM {{src}} WINDOW r1 AS (PARTITION BY image_id, c, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))""")
_B, _A, _N = "b", "a", "n"
_DOWN, _UP = "(4 * b - 3 * n - a + 6) DIV 12", "(4 * b - 3 * n - a - 6) DIV 12"
#: One lifting step along rows: average and residual of each pair, the residual less the expected slope.
SQUEEZE = Operator(f"""
SELECT image_id, c, y, x, average, p - q - CASE
  WHEN b >= a AND a >= n THEN LEAST(CASE WHEN t - t % 2 > 2 * (b - a) THEN 2 * (b - a) + 1 ELSE t END, CASE WHEN CASE WHEN t - t % 2 > 2 * (b - a) THEN 2 * (b - a) + 1 ELSE t END + ABS(CASE WHEN t - t % 2 > 2 * (b - a) THEN 2 * (b - a) + 1 ELSE t END % 2) > 2 * (a - n) THEN 2 * (a - n) ELSE 1000000 END)
  WHEN b <= a AND a <= n THEN GREATEST(CASE WHEN t + ABS(t % 2) < 2 * (b - a) THEN 2 * (b - a) - 1 ELSE t END, CASE WHEN CASE WHEN t + ABS(t % 2) < 2 * (b - a) THEN 2 * (b - a) - 1 ELSE t END - ABS(CASE WHEN t + ABS(t % 2) < 2 * (b - a) THEN 2 * (b - a) - 1 ELSE t END % 2) < 2 * (a - n) THEN 2 * (a - n) ELSE -1000000 END)
  ELSE 0 END AS residual
FROM (SELECT *, CASE WHEN b >= a AND a >= n THEN {_DOWN} WHEN b <= a AND a <= n THEN {_UP} ELSE 0 END AS t FROM (
  SELECT image_id, c, y, x DIV 2 AS x, p, q, average, average AS a, COALESCE(LAG(q) OVER w, average) AS b, COALESCE(LEAD(average) OVER w, average) AS n FROM (
    SELECT *, (p + q + CASE WHEN p > q THEN 1 ELSE 0 END) >> 1 AS average FROM (SELECT image_id, c, y, x, v AS p, LEAD(v) OVER (PARTITION BY image_id, c, y ORDER BY x) AS q FROM {{src}}) WHERE x % 2 = 0)
  WINDOW w AS (PARTITION BY image_id, c, y ORDER BY x)))""")
TRANSPOSE = Operator("SELECT image_id, c, x AS y, y AS x, v FROM {src}")
CHROMA_UPSAMPLE = Operator(f"""
SELECT image_id, c, y, 2 * x + side.s AS x, ROUND(0.75D * v + 0.25D * CASE WHEN side.s = 0 THEN v_before ELSE v_after END, 6) AS v
FROM (SELECT *, {_AROUND.format('v', 'r')} FROM {{src}} WINDOW {_ROWS}) CROSS JOIN (VALUES (0), (1)) side(s)""")


def downsample_mean(factor: int) -> Operator:
    """Means of factor x factor cells; cells at the border are means of the pixels they have."""
    return Operator(f"SELECT image_id, c, y DIV {factor} AS y, x DIV {factor} AS x, ROUND(AVG(v), 6) AS v FROM {{src}} GROUP BY image_id, c, y DIV {factor}, x DIV {factor}")


def downsample_edge(factor: int) -> Operator:
    """Means of factor x factor cells; at the border the last pixel stands for those that a cell lacks."""
    times = lambda a: f"CASE WHEN {a} = l{a} THEN {factor} - {a} % {factor} ELSE 1 END"
    return Operator(f"""
SELECT image_id, c, y DIV {factor} AS y, x DIV {factor} AS x, ROUND(SUM(v * ({times('y')}) * ({times('x')}) * 1D) / {d(float(factor * factor))}, 6) AS v FROM (
  SELECT image_id, c, y, x, v, MAX(y) OVER (PARTITION BY image_id, c) AS ly, MAX(x) OVER (PARTITION BY image_id, c) AS lx FROM {{src}}) GROUP BY image_id, c, y DIV {factor}, x DIV {factor}""")


# Luminance weights of the wide gamut, and half of the usual peak, below which no cell is taken to be.
LUMINANCE, LEAST_PEAK = (0.2627, 0.678, 0.0593), 127.5


def max_log(factor: int, peak: float) -> Operator:
    """Logarithm of the greatest luminance of factor x factor cells of an image with a peak of so many nits."""
    light = " + ".join(f"{d(w)} * {n}" for w, n in zip(LUMINANCE, "rgb", strict=True))
    return Operator(f"SELECT image_id, y DIV {factor} AS y, x DIV {factor} AS x, ROUND(LOG2(GREATEST({d(LEAST_PEAK)}, MAX(({light}) * {d(peak)}))), 6) AS v FROM {{src}} GROUP BY image_id, y DIV {factor}, x DIV {factor}")


_AROUND3 = f"""(SELECT image_id, c, y, x, v, {', '.join(f"{shifted(n, k, 'r')} AS {n}{k + 1}" for n in 'tvb' for k in (-1, 0, 1))} FROM (
  SELECT *, {shifted('v', -1, 'k')} AS t, {shifted('v', 1, 'k')} AS b FROM {{src}} WINDOW {_COLUMNS}) WINDOW {_ROWS})"""
_NINE = [f"{n}{k}" for n in "tvb" for k in (0, 1, 2)]
# Weights of the four smallest, what a target below 2 adds to them, and their total.
EROSION, EROSION_ADD, EROSION_TOTAL = (0.125, 0.1, 0.09, 0.06), (0.0, -0.1, -0.09, -0.06), 0.29959705784054957


def fuzzy_erosion(target: float = 1.0) -> Operator:
    """The four smallest of a clamped 3x3 neighbourhood, weighted for a target distance, and summed to half the size."""
    weights = [a + max(0.0, (2 - target) / 2) * b for a, b in zip(EROSION, EROSION_ADD, strict=True)]
    term = " + ".join(f"{d(w * EROSION_TOTAL / sum(weights))} * ELEMENT_AT(low, {i + 1})" for i, w in enumerate(weights))
    return Operator(f"""
SELECT image_id, c, y DIV 2 AS y, x DIV 2 AS x, ROUND(SUM({term}), 6) + 0D AS v FROM (SELECT image_id, c, y, x, ARRAY_SORT(ARRAY({', '.join(_NINE)})) AS low FROM {_AROUND3})
GROUP BY image_id, c, y DIV 2, x DIV 2""")


SECOND_SMALLEST_DIFFERENCE = Operator(f"""
SELECT image_id, c, y, x, ELEMENT_AT(ARRAY_SORT(ARRAY({', '.join(f'ABS({n} - v)' for n in _NINE if n != 'v1')})), 2) AS v FROM {_AROUND3}""")
CROSS_AGREEMENT = Operator("SELECT image_id, c, y, x, CAST(v = w AND v = n AND w = nw AS INT) AS flat FROM {src}")


def flat_cells(side: int = 4, alike: int = 8, slack: float = 1e-4) -> Operator:
    """Cells of one colour, as screens have them: side x side pixels within slack of the first, and so do the first pixels of at least `alike` of the nine cells around.

    Cells at the border and those that an image has only a part of are none.
    """
    near = lambda p: " AND ".join(f"ABS({p}{n} - {n}0) <= {d(slack)}" for n in "rgb")
    return Operator(f"""
SELECT f.image_id, f.cy, f.cx, CAST(COUNT(*) AS BIGINT) AS same FROM (
  SELECT image_id, y DIV {side} AS cy, x DIV {side} AS cx, MAX(CASE WHEN y % {side} = 0 AND x % {side} = 0 THEN r END) AS r0, MAX(CASE WHEN y % {side} = 0 AND x % {side} = 0 THEN g END) AS g0, MAX(CASE WHEN y % {side} = 0 AND x % {side} = 0 THEN b END) AS b0,
    {', '.join(f'MIN({n}) AS low_{n}, MAX({n}) AS high_{n}' for n in 'rgb')}, COUNT(*) AS n FROM {{src}} GROUP BY image_id, y DIV {side}, x DIV {side}) f
JOIN (SELECT image_id, y DIV {side} AS py, x DIV {side} AS px, r AS pr, g AS pg, b AS pb FROM {{src}} WHERE y % {side} = 0 AND x % {side} = 0) p ON p.image_id = f.image_id AND p.py BETWEEN f.cy - 1 AND f.cy + 1 AND p.px BETWEEN f.cx - 1 AND f.cx + 1
JOIN (SELECT image_id, (MAX(y) + 1) DIV {side} AS ph, (MAX(x) + 1) DIV {side} AS pw FROM {{src}} GROUP BY image_id) s ON s.image_id = f.image_id
WHERE f.n = {side * side} AND f.cy BETWEEN 1 AND s.ph - 2 AND f.cx BETWEEN 1 AND s.pw - 2 AND {near('p.p').replace('r0', 'f.r0').replace('g0', 'f.g0').replace('b0', 'f.b0')} AND {' AND '.join(f'f.high_{n} - f.{n}0 <= {d(slack)} AND f.{n}0 - f.low_{n} <= {d(slack)}' for n in 'rgb')}
GROUP BY f.image_id, f.cy, f.cx HAVING COUNT(*) >= {alike}""")


def crop(top: int, left: int, height: int, width: int) -> Operator:
    """The part of each image inside a rectangle, which may reach beyond it, with the rectangle's corner as origin."""
    return Operator(f"SELECT image_id, c, y - ({top}) AS y, x - ({left}) AS x, v FROM {{src}} WHERE y BETWEEN {top} AND {top + height - 1} AND x BETWEEN {left} AND {left + width - 1}")


# Weights beside and diagonal to the centre.
DC_SIDE, DC_CORNER = 0.20345139757231578, 0.0334829185968739
_IMAGE_COLUMNS, _IMAGE_ROWS = "k AS (PARTITION BY image_id, x ORDER BY y)", "r AS (PARTITION BY image_id, y ORDER BY x)"


def dc_smooth(steps: tuple[float, float, float]) -> Operator:
    """Channels r, g, b towards their 3x3 mean, the less the more any of them changes in its quantisation step; borders stay."""
    inner = ", ".join(f"{d(DC_SIDE)} * {n} + {d(DC_CORNER)} * (LAG({n}) OVER k + LEAD({n}) OVER k) AS {n}s, {d(1 - 4 * (DC_SIDE + DC_CORNER))} * {n} + {d(DC_SIDE)} * (LAG({n}) OVER k + LEAD({n}) OVER k) AS {n}m" for n in "rgb")
    smooth = ", ".join(f"COALESCE({n}m + LAG({n}s) OVER r + LEAD({n}s) OVER r, {n}) AS {n}2" for n in "rgb")
    gap = ", ".join(f"ABS({n} - {n}2) / {d(s)}" for n, s in zip("rgb", steps, strict=True))
    return Operator(f"""
SELECT image_id, y, x, {', '.join(f'ROUND({n} + ({n}2 - {n}) * factor, 6) AS {n}' for n in 'rgb')} FROM (
  SELECT *, GREATEST(0D, 3D - 4D * GREATEST(0.5D, {gap})) AS factor FROM (
    SELECT image_id, y, x, r, g, b, {smooth} FROM (SELECT *, {inner} FROM {{src}} WINDOW {_IMAGE_COLUMNS}) WINDOW {_IMAGE_ROWS}))""")


# What a filter's strength is divided by, the step's common scale, channel weights, and the block border's share.
INV_SIGMA, EPF_SCALE, EPF_CHANNELS, EPF_BORDER = -1.1715728752538099, 1.65, (40.0, 5.0, 3.5), 2 / 3
EPF_STEP_SCALE = (0.9, 1.0, 6.5)
_PLUS = ((0, 0), (-1, 0), (0, -1), (1, 0), (0, 1))


def edge_preserving(step: int, sigma: float) -> Operator:
    """One of three steps of the edge-preserving filter: neighbours weigh by how alike their surroundings are.

    Step 0 looks at all within two steps of a rook, 1 and 2 at the four beside; surroundings are a plus of five pixels, in step 2 the pixel alone.
    """
    reach = 2 if step == 0 else 1
    offsets = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if 0 < abs(a) + abs(b) <= reach]
    plus = _PLUS[:1] if step == 2 else _PLUS
    needed = sorted({(a + p, b + q) for a, b in [(0, 0), *offsets] for p, q in plus})

    def at(n: str, a: int, b: int) -> str:
        return f"{n}_{a + 3}_{b + 3}"

    down = ", ".join(f"{shifted(n, a, 'k')} AS {n}{a + 3}" for n in "rgb" for a in sorted({a for a, _ in needed}))
    along = ", ".join(f"{shifted(f'{n}{a + 3}', b, 'r')} AS {at(n, a, b)}" for n in "rgb" for a, b in needed)
    strength = f"{d(INV_SIGMA / sigma * EPF_SCALE * EPF_STEP_SCALE[step])} * CASE WHEN y % 8 IN (0, 7) OR x % 8 IN (0, 7) THEN {d(EPF_BORDER)} ELSE 1D END AS strength"
    surroundings = one_pass(f"image_id, y, x, {strength}, {along}", f"({one_pass(f'image_id, y, x, {down}', '{src}', _IMAGE_COLUMNS)})", _IMAGE_ROWS)
    sads = ", ".join("GREATEST(0D, 1D + strength * (" + " + ".join(f"{d(s)} * ABS({at(n, p, q)} - {at(n, a + p, b + q)})" for n, s in zip("rgb", EPF_CHANNELS, strict=True) for p, q in plus) + f")) AS w{i}" for i, (a, b) in enumerate(offsets))
    total = " + ".join(f"w{i}" for i in range(len(offsets)))
    mean = ", ".join(f"ROUND(({at(n, 0, 0)} + " + " + ".join(f"w{i} * {at(n, a, b)}" for i, (a, b) in enumerate(offsets)) + f") / (1D + {total}), 6) AS {n}" for n in "rgb")
    return Operator(f"""
SELECT image_id, y, x, {mean} FROM (SELECT *, {sads} FROM (
  {surroundings}))""")


def blur(planes: dict[str, str], sigma: float, radius: int) -> Operator:
    """Gaussian means of several planes at once (name: expression); what lies beyond the border has no weight."""
    import math

    weight = {k: math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)}

    def mean(n: str, window: str) -> str:
        at = {k: n if not k else f"{'LEAD' if k > 0 else 'LAG'}({n}, {abs(k)}) OVER {window}" for k in weight}
        return "(" + " + ".join(f"{d(w)} * COALESCE({at[k]}, 0D)" for k, w in weight.items()) + ") / (" + " + ".join(f"CASE WHEN {at[k]} IS NULL THEN 0D ELSE {d(w)} END" for k, w in weight.items()) + f") AS {n}"

    source = f"(SELECT image_id, y, x, a, b, {', '.join(f'{e} AS {n}' for n, e in planes.items())} FROM {{src}})"
    for window, order in (("k", _IMAGE_COLUMNS), ("r", _IMAGE_ROWS)):
        source = f"({one_pass('image_id, y, x, a, b, ' + ', '.join(mean(n, window) for n in planes), source, order)})"
    return Operator(f"SELECT * FROM {source}")


CHROMA_UPSAMPLE_V = Operator(f"""
SELECT image_id, c, 2 * y + side.s AS y, x, ROUND(0.75D * v + 0.25D * CASE WHEN side.s = 0 THEN v_before ELSE v_after END, 6) AS v
FROM (SELECT *, {_AROUND.format('v', 'k')} FROM {{src}} WINDOW {_COLUMNS}) CROSS JOIN (VALUES (0), (1)) side(s)""")
#: A pixel held between the least and the greatest of its 3x3 neighbourhood in another image.
CLAMP_LOCAL = Operator("SELECT p.image_id, p.c, p.y, p.x, GREATEST(q.lo, LEAST(q.hi, p.v)) AS v FROM {src} p JOIN {range} q ON q.image_id = p.image_id AND q.c = p.c AND q.y = p.y AND q.x = p.x")
