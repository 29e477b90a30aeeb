"""Perceptual scores of pairs of images over several scales, as window passes and aggregations that keep the routing by image.

Pairs are rows (image_id, y, x, r1, g1, b1, r2, g2, b2) of linear light. Blurs are Gaussians of finite reach, beyond the border
there is nothing, where recursive filters of the same width are common.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from rastrel.functions.pointwise import ABSORB, BIAS, LAB_KNEE, LAB_MIX, LAB_OFFSET, LAB_SCALE, LAB_SLOPE, LAB_ZERO, d, dot
from rastrel.operators.neighbourhood import one_pass
from rastrel.plans.steps import Operator, Plan, Source

SCALES, SIGMA, REACH = 6, 1.5, 5
# What each of the 108 parts of the score weighs, by channel, scale, norm, and kind of error.
WEIGHTS = (
    0.0, 0.0007376606707406586, 0.0, 0.0, 0.0007793481682867309, 0.0, 0.0, 0.0004371155730107379, 0.0, 1.1041726426657346, 0.00066284834129271, 0.00015231632783718752,
    0.0, 0.0016406437456599754, 0.0, 1.8422455520539298, 11.441172603757666, 0.0, 0.0007989109436015163, 0.000176816438078653, 0.0, 1.8787594979546387, 10.94906990605142, 0.0,
    0.0007289346991508072, 0.9677937080626833, 0.0, 0.00014003424285435884, 0.9981766977854967, 0.00031949755934435053, 0.0004550992113792063, 0.0, 0.0, 0.0013648766163243398, 0.0, 0.0,
    0.0, 0.0, 0.0, 7.466890328078848, 0.0, 17.445833984131262, 0.0006235601634041466, 0.0, 0.0, 6.683678146179332, 0.00037724407979611296, 1.027889937768264,
    225.20515300849274, 0.0, 0.0, 19.213238186143016, 0.0011401524586618361, 0.001237755635509985, 176.39317598450694, 0.0, 0.0, 24.43300999870476, 0.28520802612117757, 0.0004485436923833408,
    0.0, 0.0, 0.0, 34.77906344483772, 44.835625328877896, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
    0.0, 0.0008680556573291698, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0005313191874358747, 0.0, 0.00016533814161379112, 0.0, 0.0,
    0.0, 0.0, 0.0, 0.0004179171803251336, 0.0017290828234722833, 0.0, 0.0020827005846636437, 0.0, 0.0, 8.826982764996862, 23.19243343998926, 0.0,
    95.1080498811086, 0.9863978034400682, 0.9834382792465353, 0.0012286405048278493, 171.2667255897307, 0.9807858872435379, 0.0, 0.0, 0.0, 0.0005130064588990679, 0.0, 0.00010854057858411537,
)
# The score's scale, its cubic, its power, and the constants of both similarities.
GAIN, CUBIC, POWER = 0.9562382616834844, (2.326765642916932, -0.020884521182843837, 6.248496625763138e-05), 0.6276336467831387
STABLE, OLD_LIGHT, OLD_STABLE = 0.0009, 0.0001, 0.0004
# Weights of mean and least similarity by scale and channel of the older score, and of edges and grids by channel.
OLD_MEAN = ((0.0448, 0.003, 0.003), (0.2856, 0.00896, 0.00896), (0.3001, 0.05712, 0.05712), (0.2363, 0.06002, 0.06002), (0.1333, 0.06726, 0.06726), (0.1, 0.05, 0.05))
OLD_LEAST = ((0.02, 0.00005, 0.00005), (0.03, 0.00025, 0.00025), (0.025, 0.001, 0.001), (0.02, 0.0015, 0.0015), (0.012, 0.00175, 0.00175), (0.005, 0.00175, 0.00175))
OLD_EDGE, OLD_GRID = (1.5, 0.1, 0.1), (1.0, 0.1, 0.1)
_SIX = [f"{n}{i}" for n in "rgb" for i in (1, 2)]
_PLANES = [f"{n}{i}" for n in "xyb" for i in (1, 2)]


def halve(names: list[str]) -> Operator:
    """Half the size, a border's last pixel standing for the one that is missing; images with a side under 8 go."""
    times = lambda a: f"CASE WHEN {a} = l{a} AND {a} % 2 = 0 THEN 2D ELSE 1D END"
    return Operator(f"""
SELECT image_id, y DIV 2 AS y, x DIV 2 AS x, {', '.join(f'SUM({n} * {times("y")} * {times("x")}) / 4D AS {n}' for n in names)} FROM (
  SELECT *, MAX(y) OVER (PARTITION BY image_id) AS ly, MAX(x) OVER (PARTITION BY image_id) AS lx FROM {{src}}) WHERE ly >= 7 AND lx >= 7 GROUP BY image_id, y DIV 2, x DIV 2""")


#: Images that are large enough for the first scale.
LARGE_ENOUGH = Operator(f"SELECT image_id, y, x, {', '.join(_SIX)} FROM (SELECT *, MAX(y) OVER (PARTITION BY image_id) AS ly, MAX(x) OVER (PARTITION BY image_id) AS lx FROM {{src}}) WHERE ly >= 7 AND lx >= 7")


def _positive(i: int) -> tuple[str, str]:
    """Opponent colours of one image, moved to about 0..1: the mixtures, and the three channels out of them."""
    root = d(BIAS ** (1 / 3))
    mixed = ", ".join(f"POWER(GREATEST({dot(row, [f'{n}{i}' for n in 'rgb'])} + {d(BIAS)}, 0D), {d(1 / 3)}) - {root} AS {m}{i}" for row, m in zip(ABSORB, "lms", strict=True))
    return mixed, f"(l{i} - m{i}) / 2D * 14D + 0.42D AS x{i}, (l{i} + m{i}) / 2D + 0.01D AS y{i}, s{i} - (l{i} + m{i}) / 2D + 0.55D AS b{i}"


OPPONENT = Operator(f"SELECT image_id, y, x, {_positive(1)[1]}, {_positive(2)[1]} FROM (SELECT image_id, y, x, {_positive(1)[0]}, {_positive(2)[0]} FROM {{src}})")


def _lab(i: int) -> tuple[str, str]:
    at = [dot(row, [f"{n}{i}" for n in "rgb"]) for row in LAB_MIX]
    curve = ", ".join(f"CASE WHEN {a} > {d(LAB_KNEE)} THEN POWER({a}, {d(1 / 3)}) - {d(LAB_OFFSET)} ELSE {d(LAB_SLOPE)} * {a} END AS f{n}{i}" for n, a in zip("xyz", at, strict=True))
    return curve, ", ".join(f"{d(z)} + {d(s)} * ({e}) AS {n}{i}" for n, z, s, e in zip("xyb", LAB_ZERO, LAB_SCALE, (f"fy{i}", f"fx{i} - fy{i}", f"fy{i} - fz{i}"), strict=True))


LAB_PAIR = Operator(f"SELECT image_id, y, x, {_lab(1)[1]}, {_lab(2)[1]} FROM (SELECT image_id, y, x, {_lab(1)[0]}, {_lab(2)[0]} FROM {{src}})")


def _blurred() -> Operator:
    """The six planes, and blurred: themselves (m), their squares (s) and the products of both images (p)."""
    weight = [math.exp(-k * k / (2 * SIGMA * SIGMA)) for k in range(-REACH, REACH + 1)]
    weight = [w / sum(weight) for w in weight]
    planes = {f"m_{n}": n for n in _PLANES} | {f"s_{n}": f"{n} * {n}" for n in _PLANES} | {f"p_{n}": f"{n}1 * {n}2" for n in "xyb"}
    source = f"(SELECT image_id, y, x, {', '.join(_PLANES)}, {', '.join(f'{e} AS {n}' for n, e in planes.items())} FROM {{src}})"
    for window, order in (("k", "k AS (PARTITION BY image_id, x ORDER BY y)"), ("r", "r AS (PARTITION BY image_id, y ORDER BY x)")):
        def mean(n: str, window=window) -> str:
            return "(" + " + ".join(f"{d(w)} * " + (n if not k else f"COALESCE({'LEAD' if k > 0 else 'LAG'}({n}, {abs(k)}) OVER {window}, 0D)") for k, w in zip(range(-REACH, REACH + 1), weight, strict=True)) + f") AS {n}"

        source = f"({one_pass('image_id, y, x, ' + ', '.join(_PLANES) + ', ' + ', '.join(mean(n) for n in planes), source, order)})"
    return Operator(f"SELECT * FROM {source}")


BLURRED = _blurred()


def _parts(scale: int) -> Operator:
    """One row an image with the 18 parts of a scale: by channel, by norm (1 and 4), similarity, added and lost edges."""
    errors, sums = [], []
    for n in "xyb":
        similar = f"(1D - (m_{n}1 - m_{n}2) * (m_{n}1 - m_{n}2)) * (2D * (p_{n} - m_{n}1 * m_{n}2) + {d(STABLE)}) / ((s_{n}1 - m_{n}1 * m_{n}1) + (s_{n}2 - m_{n}2 * m_{n}2) + {d(STABLE)})"
        edge = f"((1D + ABS({n}2 - m_{n}2)) / (1D + ABS({n}1 - m_{n}1)) - 1D)"
        errors += [f"GREATEST(0D, 1D - {similar}) AS e_{n}0", f"GREATEST(0D, {edge}) AS e_{n}1", f"GREATEST(0D, -{edge}) AS e_{n}2"]
        sums += [f"AVG(e_{n}{k}) AS v_{n}0{k}" for k in range(3)] + [f"SQRT(SQRT(AVG(POWER(e_{n}{k}, 4D)))) AS v_{n}1{k}" for k in range(3)]
    return Operator(f"SELECT image_id, {scale} AS scale, {', '.join(sums)} FROM (SELECT image_id, {', '.join(errors)} FROM {{src}}) GROUP BY image_id")


_VALUES = [f"v_{n}{m}{k}" for n in "xyb" for m in (0, 1) for k in range(3)]
_SCORE = Operator(f"""
SELECT image_id, scales, ROUND(CASE WHEN s > 0D THEN 100D - 10D * POWER(s, {d(POWER)}) ELSE 100D END, 4) AS score FROM (
  SELECT image_id, scales, {d(CUBIC[0])} * t + {d(CUBIC[1])} * t * t + {d(CUBIC[2])} * t * t * t AS s FROM (
    SELECT image_id, MAX(n) AS scales, SUM(ABS(ELEMENT_AT(ARRAY({', '.join(_VALUES)}), k.k + 1)) * ELEMENT_AT(ARRAY({', '.join(d(w) for w in WEIGHTS)}), CAST((k.k DIV 6 * n + scale) * 6 + k.k % 6 + 1 AS INT))) * {d(GAIN)} AS t FROM (
      SELECT *, COUNT(*) OVER (PARTITION BY image_id) AS n FROM {{src}}) CROSS JOIN (VALUES {', '.join(f'({k})' for k in range(18))}) k(k) GROUP BY image_id))""")
_TOGETHER = Operator("SELECT * FROM {src} UNION ALL SELECT * FROM {more}")
Rows = DataFrame | Plan | Source


def multiscale_score(pairs: Rows) -> DataFrame | Plan:
    """100 for equal images, less the more the second differs: 108 weighted parts over up to six scales, halved in linear light.

    Images with a side under 8 have no scale and no row; those with fewer scales use the first weights, as many as they have parts.
    """
    light, parts = LARGE_ENOUGH(pairs), None
    for scale in range(SCALES):
        own = _parts(scale)(BLURRED(OPPONENT(light)))
        parts = own if parts is None else _TOGETHER(parts, more=own)
        light = halve(_SIX)(light)
    return _SCORE(parts)


def _old_parts(scale: int) -> Operator:
    """Mean similarity of each channel, and the least mean of 4x4 cells, whose border cells repeat their last pixel."""
    similar = lambda n: f"(2D * m_{n}1 * m_{n}2 + {d(OLD_LIGHT)}) * (2D * (p_{n} - m_{n}1 * m_{n}2) + {d(OLD_STABLE)}) / ((m_{n}1 * m_{n}1 + m_{n}2 * m_{n}2 + {d(OLD_LIGHT)}) * ((s_{n}1 - m_{n}1 * m_{n}1) + (s_{n}2 - m_{n}2 * m_{n}2) + {d(OLD_STABLE)}))"
    times = lambda a: f"CASE WHEN {a} = l{a} THEN 4D - {a} % 4 ELSE 1D END"
    grid = ""
    if scale == 0:
        grid = ", " + ", ".join(f"1D - GREATEST(0D, ABS({n}2 - m_{n}2) - ABS({n}1 - m_{n}1)) AS e_{n}" for n in "xyb")
    cells = f"""SELECT image_id, y DIV 4 AS cy, x DIV 4 AS cx, {', '.join(f'SUM(q_{n}) AS t_{n}, SUM(q_{n} * {times("y")} * {times("x")}) / 16D AS c_{n}' for n in 'xyb')}, COUNT(*) AS pixels{', ' + ', '.join(f'SUM(e_{n}) AS e_{n}' for n in 'xyb') if grid else ''} FROM (
      SELECT image_id, y, x, MAX(y) OVER (PARTITION BY image_id) AS ly, MAX(x) OVER (PARTITION BY image_id) AS lx, {', '.join(f'{similar(n)} AS q_{n}' for n in 'xyb')}{grid} FROM {{src}}) GROUP BY image_id, y DIV 4, x DIV 4"""
    return Operator(f"""
SELECT image_id, {scale} AS scale, {', '.join(f'SUM(t_{n}) / SUM(pixels) AS mean_{n}, MIN(c_{n}) AS least_{n}' for n in 'xyb')}, {', '.join((f'SUM(e_{n}) / SUM(pixels)' if grid else '0D') + f' AS edge_{n}' for n in 'xyb')} FROM ({cells}) GROUP BY image_id""")


def _grid(axis: str, of: str) -> str:
    """The mean of the line that is at two hundredths of all by its sum, of a plane's rows or columns."""
    across = "x" if axis == "y" else "y"
    sums = ", ".join(f"SUM({of}_{n}) / COUNT({across}) AS l_{n}" for n in "xyb")
    ranks = ", ".join(f"ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY l_{n}) AS k_{n}" for n in "xyb")
    picks = ", ".join(f"MAX(CASE WHEN k_{n} = n DIV 50 + 1 THEN l_{n} END) AS g_{n}" for n in "xyb")
    return f"SELECT image_id, {picks} FROM (SELECT *, {ranks}, COUNT(*) OVER (PARTITION BY image_id) AS n FROM (SELECT image_id, {axis}, {sums} FROM {{src}} GROUP BY image_id, {axis})) GROUP BY image_id"


_CELLS = Operator("SELECT image_id, y DIV 4 AS y, x DIV 4 AS x, " + ", ".join(f"SUM(q_{n} * (CASE WHEN y = ly THEN 4D - y % 4 ELSE 1D END) * (CASE WHEN x = lx THEN 4D - x % 4 ELSE 1D END)) / 16D AS q_{n}" for n in "xyb")
                  + " FROM (SELECT *, MAX(y) OVER (PARTITION BY image_id) AS ly, MAX(x) OVER (PARTITION BY image_id) AS lx FROM {src}) GROUP BY image_id, y DIV 4, x DIV 4")
_MAPS = Operator("SELECT image_id, y, x, " + ", ".join(
    f"(2D * m_{n}1 * m_{n}2 + {d(OLD_LIGHT)}) * (2D * (p_{n} - m_{n}1 * m_{n}2) + {d(OLD_STABLE)}) / ((m_{n}1 * m_{n}1 + m_{n}2 * m_{n}2 + {d(OLD_LIGHT)}) * ((s_{n}1 - m_{n}1 * m_{n}1) + (s_{n}2 - m_{n}2 * m_{n}2) + {d(OLD_STABLE)})) AS q_{n}, "
    f"1D - GREATEST(0D, ABS({n}2 - m_{n}2) - ABS({n}1 - m_{n}1)) AS e_{n}" for n in "xyb") + " FROM {src}")
_LINES = [Operator(_grid(axis, of)) for of in "qe" for axis in "yx"]
_ADD_GRIDS = Operator("SELECT image_id, " + ", ".join(f"SUM(g_{n}) AS grid_{n}" for n in "xyb") + " FROM (SELECT * FROM {src} UNION ALL SELECT * FROM {b} UNION ALL SELECT * FROM {c} UNION ALL SELECT * FROM {e}) GROUP BY image_id")


def _weigh(table, n: int) -> str:
    return f"ELEMENT_AT(ARRAY({', '.join(d(row[n]) for row in table)}), scale + 1)"


_OLD_SCORE = Operator("SELECT image_id, scales, ROUND(LEAST(1D, GREATEST(0D, most / got - 1D)), 6) AS score FROM (SELECT p.image_id, p.scales, p.got + " + " + ".join(f"{d(w)} * p.edge_{n} + {d(g)} * q.grid_{n}" for n, w, g in zip("xyb", OLD_EDGE, OLD_GRID, strict=True))
                      + f" AS got, p.most + {d(sum(OLD_EDGE) + 4 * sum(OLD_GRID))} AS most FROM (SELECT image_id, COUNT(*) AS scales, SUM(" + " + ".join(f"{_weigh(OLD_MEAN, i)} * mean_{n} + {_weigh(OLD_LEAST, i)} * least_{n}" for i, n in enumerate("xyb")) + ") AS got, SUM("
                      + " + ".join(f"{_weigh(t, i)}" for i in range(3) for t in (OLD_MEAN, OLD_LEAST)) + ") AS most, " + ", ".join(f"SUM(edge_{n}) AS edge_{n}" for n in "xyb") + " FROM {src} GROUP BY image_id) p JOIN {grid} q ON q.image_id = p.image_id)")


def structure_score(pairs: Rows) -> DataFrame | Plan:
    """0 for equal images, up to 1: mean and least structural similarity over up to six scales of a uniform colour space, halved in it, with edges and grids of the first."""
    planes, parts, first = LAB_PAIR(LARGE_ENOUGH(pairs)), None, None
    for scale in range(SCALES):
        blurred = BLURRED(planes)
        first = first or blurred
        own = _old_parts(scale)(blurred)
        parts = own if parts is None else _TOGETHER(parts, more=own)
        planes = halve(_PLANES)(planes)
    maps = _MAPS(first)
    rows, columns = (_LINES[k](_CELLS(maps)) for k in (0, 1))
    return _OLD_SCORE(parts, grid=_ADD_GRIDS(rows, b=columns, c=_LINES[2](maps), e=_LINES[3](maps)))
