"""Quality measures between images, block transforms and statistics, palettes, compositing, orders."""

from __future__ import annotations

import math
from collections.abc import Callable

from rastrel.functions.pointwise import LUMA, d, dot, half_even
from rastrel.operators.neighbourhood import blur
from rastrel.plans.steps import Operator, other_dialect

P_NORM = Operator("""SELECT image_id, ROUND((POWER(AVG(POWER(ABS(a - b), 3D)), """ + d(1 / 3) + """) + POWER(AVG(POWER(ABS(a - b), 6D)), """ + d(1 / 6) + """) + POWER(AVG(POWER(ABS(a - b), 12D)), """ + d(1 / 12) + """)) / 3D, 6) AS p_norm,
  ROUND(MAX(ABS(a - b)), 6) AS max_norm, ROUND(SQRT(AVG((a - b) * (a - b))), 6) AS rmse FROM {src} GROUP BY image_id""")
# Luma and colour differences of the measure, which are not those of full-range BT.601.
_YUV = (LUMA, (-0.14713, -0.28886, 0.436), (0.615, -0.51499, -0.10001))
_DIFF = ("(r1 - r2)", "(g1 - g2)", "(b1 - b2)")
PSNR = Operator("SELECT image_id, ROUND(" + " + ".join(f"{d(w)} * CASE WHEN s{i} = 0D THEN 99.99D ELSE 20D * LOG10(1D / SQRT(s{i} / n)) END" for i, w in enumerate((6 / 8, 1 / 8, 1 / 8)))
                + ", 6) AS psnr, ROUND(POWER(" + " + ".join(f"{d(w)} * SQRT(s{i})" for i, w in enumerate((6 / 8, 1 / 8, 1 / 8))) + ", 2D), 6) AS distance2 FROM (SELECT image_id, COUNT(*) * 1D AS n, "
                + ", ".join(f"SUM(POWER({dot(row, _DIFF)}, 2D)) AS s{i}" for i, row in enumerate(_YUV)) + " FROM {src} GROUP BY image_id)")
_C2 = d(0.0009)
#: Means of both images, their squares and product; SSIM and EDGE_DIFF take its rows.
BLURRED = blur({"ma": "a", "mb": "b", "aa": "a * a", "bb": "b * b", "ab": "a * b"}, 1.5, 4)
SSIM = Operator(f"""
SELECT image_id, ROUND(AVG(e), 6) AS mean, ROUND(POWER(AVG(POWER(e, 4D)), 0.25D), 6) AS norm4 FROM (
  SELECT image_id, GREATEST(0D, 1D - (1D - (ma - mb) * (ma - mb)) * (2D * (ab - ma * mb) + {_C2}) / ((aa - ma * ma) + (bb - mb * mb) + {_C2})) AS e FROM {{src}})
GROUP BY image_id""")
EDGE_DIFF = Operator("""
SELECT image_id, ROUND(AVG(GREATEST(e, 0D)), 6) AS artifact, ROUND(POWER(AVG(POWER(GREATEST(e, 0D), 4D)), 0.25D), 6) AS artifact4, ROUND(AVG(GREATEST(-e, 0D)), 6) AS lost, ROUND(POWER(AVG(POWER(GREATEST(-e, 0D), 4D)), 0.25D), 6) AS lost4 FROM (
  SELECT image_id, (1D + ABS(b - mb)) / (1D + ABS(a - ma)) - 1D AS e FROM {src}) GROUP BY image_id""")
# Weights of the channels.
_L2 = (12.339445295782363, 1.0, 0.2)
#: Squared difference of 8x8 blocks, masked; {mask} has mask for each pixel.
BLOCK_L2 = Operator("SELECT p.image_id, p.y DIV 8 AS by, p.x DIV 8 AS bx, ROUND(" + " + ".join(f"{d(w)} * SUM(m.mask * m.mask * POWER({n}1 - {n}2, 2D))" for n, w in zip("rgb", _L2, strict=True))
                    + ", 6) AS l2 FROM {src} p JOIN {mask} m ON m.image_id = p.image_id AND m.y = p.y AND m.x = p.x GROUP BY p.image_id, p.y DIV 8, p.x DIV 8")


def tile_16norm(tile: int, margin: int) -> Operator:
    """16-norm of a difference map by tile and a margin around it, whose outermost rows and columns weigh less."""
    def pick(axis: str) -> tuple[str, str, str]:
        t = f"({axis} DIV {tile} + n{axis}.k)"
        return t, f"GREATEST(0, {t} * {tile} - {margin})", f"LEAST(side{axis}, {t} * {tile} + {tile + margin})"

    (ty, y0, y1), (tx, x0, x1) = pick("y"), pick("x")
    border = lambda axis, lo, hi: f"CASE WHEN {margin} > 0 AND ({axis} = {lo} OR {axis} = {hi} - 1) THEN 1 ELSE 0 END"
    return Operator(f"""
SELECT image_id, ty, tx, ROUND(1.2D * POWER(SUM(m * POWER(diff, 16D)) / SUM(m), 0.0625D), 6) AS norm FROM (
  SELECT image_id, diff, {ty} AS ty, {tx} AS tx, CASE {border('y', y0, y1)} + {border('x', x0, x1)} WHEN 0 THEN 1D WHEN 1 THEN 0.98D ELSE 0.7D END AS m FROM (
    SELECT image_id, y, x, ABS(a - b) AS diff, MAX(y) OVER (PARTITION BY image_id) + 1 AS sidey, MAX(x) OVER (PARTITION BY image_id) + 1 AS sidex FROM {{src}})
  CROSS JOIN (VALUES (-1), (0), (1)) ny(k) CROSS JOIN (VALUES (-1), (0), (1)) nx(k)
  WHERE {ty} >= 0 AND {tx} >= 0 AND {ty} * {tile} < sidey AND {tx} * {tile} < sidex AND y >= {y0} AND y < {y1} AND x >= {x0} AND x < {x1}) GROUP BY image_id, ty, tx""")


#: Least and greatest value, each with its first place in reading order, mean and variance of a plane of any size.
MINMAX_STATS = Operator("""
SELECT image_id, c, MIN(v) AS low, MAX(v) AS high, MIN_BY(place, v * n + place) AS at_low, MAX_BY(place, v * n - place) AS at_high, ROUND(AVG(v), 6) AS mean, ROUND(AVG(v * v * 1D) - AVG(v) * AVG(v), 4) AS variance FROM (
  SELECT image_id, c, v, y * (MAX(x) OVER (PARTITION BY image_id, c) + 1) + x AS place, (MAX(x) OVER (PARTITION BY image_id, c) + 1) * (MAX(y) OVER (PARTITION BY image_id, c) + 1) AS n FROM {src}) GROUP BY image_id, c""")
IMAGE_INFO = Operator("SELECT image_id, MAX(x) + 1 AS width, MAX(y) + 1 AS height, COUNT(DISTINCT c) AS channels, COUNT(*) AS samples FROM {src} GROUP BY image_id")
BENCH_ROLLUP = Operator("""
SELECT codec, COUNT(*) AS images, ROUND(SUM(bytes), 2) AS bytes, ROUND(SUM(bytes) * 8D / SUM(pixels), 8) AS bpp, ROUND(SQRT(SUM(max_norm * max_norm * pixels) / SUM(pixels)), 6) AS max_norm, ROUND(SUM(bytes) * 8D / SUM(pixels) * SUM(p_norm * pixels) / SUM(pixels), 8) AS bpp_pnorm
FROM {src} GROUP BY ROLLUP(codec)""")
PERCENTILES = Operator("SELECT codec, " + ", ".join(f"MAX(CASE WHEN rank = CAST(FLOOR(n * {d(q / 100)}) AS BIGINT) + 1 THEN p_norm END) AS p{q}" for q in (5, 10, 50, 90, 95))
                       + " FROM (SELECT codec, p_norm, ROW_NUMBER() OVER (PARTITION BY codec ORDER BY p_norm) AS rank, COUNT(*) OVER (PARTITION BY codec) AS n FROM {src}) GROUP BY codec")
_TOO_MANY, _OVERFLOW, _UNDERFLOW = math.log(1e100), math.log(1.7976931348623157e308), math.log(5e-324)


def _speed_summary(ln: Callable[[str], str], order: str) -> str:
    return f"""
SELECT stream, reps, low, high, kind, ROUND(CASE kind WHEN 'single' THEN first WHEN 'second' THEN last WHEN 'geomean' THEN EXP(rest / (reps - 1)) ELSE med END, 6) AS central, ROUND(CASE WHEN kind = 'median' THEN SQRT(spread) ELSE 0D END, 4) AS variability FROM (
  SELECT *, CASE WHEN reps = 1 THEN 'single' WHEN reps = 2 THEN 'second' WHEN reps * {ln('first')} < {d(_TOO_MANY)} AND rest < {d(_OVERFLOW)} AND rest > {d(_UNDERFLOW)} THEN 'geomean' ELSE 'median' END AS kind FROM (
    SELECT stream, COUNT(*) AS reps, MIN(t) AS low, MAX(t) AS high, MAX(CASE WHEN pos = 0 THEN t END) AS first, MAX(CASE WHEN pos = n - 1 THEN t END) AS last, SUM(CASE WHEN pos > 0 THEN {ln('t')} ELSE 0D END) AS rest, MAX(med) AS med, SUM((t - med) * (t - med)) AS spread FROM (
      SELECT stream, pos, t, n, MAX(CASE WHEN rank = n DIV 2 + 1 THEN t END) OVER (PARTITION BY stream) AS med FROM (
        SELECT stream, pos, t, ROW_NUMBER() OVER (PARTITION BY stream ORDER BY {order}) AS rank, COUNT(*) OVER (PARTITION BY stream) AS n FROM {{src}})) GROUP BY stream))"""


#: Times of repetitions (stream, pos, t): the only one, the second of two, else the geometric mean without the first, or the median where its product is no number.
#: The logarithm of zero is -Infinity, of less NaN, and null times come last; Spark's own would be null and first.
SPEED_SUMMARY = Operator(
    _speed_summary(lambda t: f"CASE WHEN {t} > 0 THEN LN({t}) WHEN {t} = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN {t} < 0 THEN CAST('NaN' AS DOUBLE) END", "t NULLS LAST"),
    other_dialect(_speed_summary(lambda t: f"LN({t})", "t")),
)


#: Colours of each image, and whether they fit a palette of so many; counting ends where it would not matter, so n is cut there.
def distinct_colours(most: int) -> Operator:
    return Operator(f"SELECT image_id, LEAST(COUNT(*), {most + 1}) AS colours, CAST(COUNT(*) <= {most} AS INT) AS fits FROM (SELECT DISTINCT image_id, v0, v1, v2 FROM {{src}}) GROUP BY image_id")


PALETTE = Operator("SELECT image_id, v, DENSE_RANK() OVER (PARTITION BY image_id ORDER BY v) - 1 AS idx, COUNT(*) AS n FROM {src} GROUP BY image_id, v")
PALETTE_INDEX = Operator("SELECT p.image_id, p.y, p.x, q.idx, q.v AS expanded FROM {src} p JOIN {palette} q ON q.image_id = p.image_id AND q.v = p.v")
#: Colours of each image by how often they occur; common ones first, from bright to dark, then the others from dark to bright; alpha, where there is one, scales the luma.
def palette_order(alpha: str | None = None, common: int = 4) -> Operator:
    keys = "v0, v1, v2" + (f", {alpha}" if alpha else "")
    luma = f"({dot(LUMA, ('v0', 'v1', 'v2'))} + 0.1D)" + (f" * (1D + {alpha})" if alpha else "")
    return Operator(f"""
SELECT image_id, {keys}, n, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY CASE WHEN n > {common} THEN -luma ELSE luma END, {keys}) - 1 AS place FROM (
  SELECT *, {luma} AS luma FROM (SELECT image_id, {keys}, COUNT(*) AS n FROM {{src}} GROUP BY image_id, {keys}))""")


# Weights of the channels, what is added for a channel that is large in both colours, and of the weighted sum.
_FAR, _FAR_ADD, _FAR_SUM, _FAR_MEAN = (3.0, 5.0, 2.0), (1.15, 1.15, 1.12), (3.0, 5.0, 1.0), 1.21 / 3


def colour_distance(a: tuple[str, str, str], b: tuple[str, str, str]) -> str:
    """Squared distance of two colours; a channel counts more where both colours are rich in it."""
    both = [f"({p} + {q})" for p, q in zip(a, b, strict=True)]
    mean = f"({' + '.join(both)}) * {d(_FAR_MEAN)}"
    weight = [f"({d(w)} + CASE WHEN {s} >= {mean} THEN {d(add)}{f' - CASE WHEN {s} < 1.22D * ({mean}) THEN 0.5D ELSE 0D END' if i == 2 else ''} ELSE 0D END)" for i, (w, add, s) in enumerate(zip(_FAR, _FAR_ADD, both, strict=True))]
    square = " + ".join(f"POWER(({p} - {q}) * {w}, 2D)" for p, q, w in zip(a, b, weight, strict=True))
    return f"(4D * ({square}) + POWER({' + '.join(f'({p} - {q}) * {d(w)}' for p, q, w in zip(a, b, _FAR_SUM, strict=True))}, 2D))"


#: The nearest colour of an image's palette by that distance, the first of equals; {src} (image_id, y, x, v0, v1, v2), {palette} (image_id, idx, p0, p1, p2).
PALETTE_NEAREST = Operator(f"""
SELECT image_id, y, x, MIN_BY(idx, rank) AS idx, MIN(far) AS far FROM (
  SELECT image_id, y, x, idx, far, ROW_NUMBER() OVER (PARTITION BY image_id, y, x ORDER BY far, idx) AS rank FROM (
    SELECT p.image_id, p.y, p.x, q.idx, ROUND({colour_distance(('q.p0', 'q.p1', 'q.p2'), ('p.v0', 'p.v1', 'p.v2'))}, 4) AS far FROM {{src}} p JOIN {{palette}} q ON q.image_id = p.image_id)) GROUP BY image_id, y, x""")


def top_deltas(bits: int = 8, most: int = 128, least: float = 17.0) -> Operator:
    """Frequent colour deltas of each image (image_id, d0, d1, d2, distance) in buckets, weighted by the fourth root of distances and the delta's own length."""
    bucket = 3 << max(0, bits - 8)
    near = lambda v: f"(CASE WHEN {v} < 0 THEN -((-{v} + {bucket // 2}) DIV {bucket}) ELSE ({v} + {bucket // 2}) DIV {bucket} END)"
    length = colour_distance(("0D", "0D", "0D"), ("k0", "k1", "k2"))
    return Operator(f"""
SELECT image_id, {', '.join(f'k{i} * {bucket} AS d{i}' for i in range(3))}, ROUND(score, 4) AS score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY ROUND(score, 6) DESC, k0, k1, k2) AS rank FROM (
    SELECT image_id, k0, k1, k2, weight * (SQRT({length}) + 1D) / pixels AS score FROM (
      SELECT image_id, k0, k1, k2, pixels, SUM(SQRT(SQRT(distance))) AS weight FROM (
        SELECT image_id, {', '.join(f'{near(f"d{i}")} AS k{i}' for i in range(3))}, distance, COUNT(*) OVER (PARTITION BY image_id) * 1D AS pixels FROM {{src}})
      WHERE k0 <> 0 OR k1 <> 0 OR k2 <> 0 GROUP BY image_id, k0, k1, k2, pixels)) WHERE score >= {d(least)}) WHERE rank <= {most}""")


#: What each pixel differs from the one to its left (the first from nothing), and how far that is.
LEFT_DELTAS = Operator(f"""
SELECT image_id, v0 - w0 AS d0, v1 - w1 AS d1, v2 - w2 AS d2, {colour_distance(('w0', 'w1', 'w2'), ('v0', 'v1', 'v2'))} AS distance FROM (
  SELECT *, {', '.join(f'COALESCE(LAG(v{i}) OVER (PARTITION BY image_id, y ORDER BY x), 0) AS w{i}' for i in range(3))} FROM {{src}})""")

_MODES = ("replace", "add", "blend", "weighted add", "multiply")


def blend(premultiplied: bool = False, clamp: bool = False) -> Operator:
    """A layer {top} put on a canvas {src} (image_id, y, x, r, g, b, a) where {place} (image_id, mode, dy, dx) says; what it leaves uncovered stays.

    Modes: 0 replace, 1 add, 2 blend by alpha, 3 add weighted by alpha, 4 multiply. Alpha is blended as the colours are.
    """
    fa = "LEAST(1D, GREATEST(0D, f.a))" if clamp else "f.a"
    alpha = f"(1D - (1D - {fa}) * (1D - p.a))"
    def over(n: str) -> str:
        if premultiplied:
            return f"f.{n} + p.{n} * (1D - {fa})"
        return f"CASE WHEN {alpha} > 0D THEN (f.{n} * {fa} + p.{n} * p.a * (1D - {fa})) / {alpha} ELSE 0D END"

    def colour(n: str) -> str:
        times = f"LEAST(1D, GREATEST(0D, f.{n}))" if clamp else f"f.{n}"
        return f"ROUND(CASE WHEN f.a IS NULL THEN p.{n} WHEN q.mode = 0 THEN f.{n} WHEN q.mode = 1 THEN p.{n} + f.{n} WHEN q.mode = 2 THEN {over(n)} WHEN q.mode = 3 THEN p.{n} + f.{n} * {fa} ELSE p.{n} * {times} END, 6) AS {n}"

    return Operator(f"""
SELECT p.image_id, p.y, p.x, {', '.join(colour(n) for n in 'rgb')}, ROUND(CASE WHEN f.a IS NULL THEN p.a WHEN q.mode = 0 THEN f.a WHEN q.mode = 1 THEN p.a + f.a WHEN q.mode = 2 THEN {alpha} WHEN q.mode = 3 THEN p.a ELSE p.a * {fa} END, 6) AS a
FROM {{src}} p JOIN {{place}} q ON q.image_id = p.image_id LEFT JOIN {{top}} f ON f.image_id = p.image_id AND f.y + q.dy = p.y AND f.x + q.dx = p.x""")


_PATCHED = "q.image_id = p.image_id AND p.y >= q.y0 AND p.y < q.y0 + q.h AND p.x >= q.x0 AND p.x < q.x0 + q.w"
#: Patches applied to the pixels they cover in the order of their ids (mode 0 replaces, 1 adds, 2 multiplies); other pixels stay.
PATCH_APPLY = Operator(
    f"""SELECT image_id, y, x, v AS before, AGGREGATE(ARRAY_SORT(steps), CAST(v AS DOUBLE), (s, t) -> CASE t.mode WHEN 0 THEN t.value WHEN 1 THEN s + t.value ELSE s * t.value END) AS v FROM (
  SELECT p.image_id, p.y, p.x, p.v, COLLECT_LIST(CASE WHEN q.id IS NOT NULL THEN NAMED_STRUCT('id', q.id, 'mode', q.mode, 'value', CAST(q.value AS DOUBLE)) END) AS steps FROM {{src}} p LEFT JOIN {{patches}} q ON {_PATCHED} GROUP BY p.image_id, p.y, p.x, p.v)""",
    f"""WITH RECURSIVE ranked AS (SELECT p.image_id, p.y, p.x, q.mode, q.value::DOUBLE AS value, row_number() OVER (PARTITION BY p.image_id, p.y, p.x ORDER BY q.id) AS k FROM {{src}} p JOIN {{patches}} q ON {_PATCHED}),
steps AS (SELECT image_id, y, x, v AS before, v::DOUBLE AS v, 0 AS k FROM {{src}} UNION ALL
  SELECT s.image_id, s.y, s.x, s.before, CASE r.mode WHEN 0 THEN r.value WHEN 1 THEN s.v + r.value ELSE s.v * r.value END, s.k + 1 FROM steps s JOIN ranked r ON r.image_id = s.image_id AND r.y = s.y AND r.x = s.x AND r.k = s.k + 1)
SELECT image_id, y, x, before, arg_max(v, k) AS v FROM steps GROUP BY image_id, y, x, before""")




def natural_order(rows: int = 1, columns: int = 1) -> str:
    """Sort keys of coefficients (u, w) of a transform over so many blocks, columns >= rows: the lowest first, then by diagonals in turns.

    Diagonals are those of the square over the longer side, of which only every (columns / rows)-th line is there.
    """
    step = columns // rows
    low = f"u < {rows} AND w < {columns}"
    return f"CASE WHEN {low} THEN u * {columns} + w ELSE {rows * columns} + u * {step} + w END, CASE WHEN {low} THEN 0 WHEN (u * {step} + w) % 2 = 0 THEN w ELSE u END"


def zigzag(rows: int = 1, columns: int = 1) -> Operator:
    """The natural order of all coefficients of a transform over rows x columns blocks of 8x8."""
    grid = "(SELECT a.k AS u, b.k AS w FROM (VALUES " + ", ".join(f"({k})" for k in range(8 * rows)) + ") a(k) CROSS JOIN (VALUES " + ", ".join(f"({k})" for k in range(8 * columns)) + ") b(k))"
    return Operator(f"SELECT u, w, ROW_NUMBER() OVER (ORDER BY {natural_order(rows, columns)}) - 1 AS place FROM {grid} CROSS JOIN (SELECT COUNT(*) AS n FROM {{src}})")


_TURN = d(2 * math.pi)


def centre_first(size: int) -> Operator:
    """Groups of size x size pixels of each image in squares around the one that holds the centre, clockwise from the side nearest to it."""
    remainder = lambda a: f"({a} - {_TURN} * {half_even(f'({a} / {_TURN})')})"
    turn = f"(-ATAN2(iy - cy, ix - cx) + {d(5 * math.pi / 4)})"
    return Operator(f"""
SELECT image_id, gy, gx, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY ring, ROUND(angle, 9)) - 1 AS place FROM (
  SELECT image_id, gy, gx, GREATEST(ABS(dx), ABS(dy)) AS ring, {remainder('a')} AS angle FROM (
    SELECT *, ATAN2(dy, dx) + {d(math.pi / 4)} + side * {d(math.pi / 2)} AS a FROM (
      SELECT image_id, gy, gx, gx * {size} + {size // 2} - cx AS dx, gy * {size} + {size // 2} - cy AS dy, FLOOR(({turn} - {_TURN} * FLOOR({turn} / {_TURN})) * {d(2 / math.pi)}) AS side FROM (
        SELECT DISTINCT image_id, y DIV {size} AS gy, x DIV {size} AS gx, iy, ix, iy DIV {size} * {size} + {size // 2} AS cy, ix DIV {size} * {size} + {size // 2} AS cx FROM (
          SELECT image_id, y, x, (MAX(y) OVER (PARTITION BY image_id) + 1) DIV 2 AS iy, (MAX(x) OVER (PARTITION BY image_id) + 1) DIV 2 AS ix FROM {{src}})))))""")


def basis(n: int) -> list[list[float]]:
    """basis(n)[u][k]: what sample k adds to coefficient u of the scaled DCT-II, whose constant is the mean."""
    return [[(1 / math.sqrt(2) if u == 0 else 1.0) * math.cos((k + 0.5) * u * math.pi / n) * math.sqrt(2) / n for k in range(n)] for u in range(n)]


def _table(values: list[float]) -> str:
    return "(ARRAY(" + ", ".join(d(v) for v in values) + "))"


def _pick(values: list[float], index: str) -> str:
    return f"ELEMENT_AT{_table(values)[:-1]}, CAST({index} AS INT))"


def _forward(axis: str, u: int) -> str:
    """Factor of a pixel for coefficient u along an axis; an image's last pixel also stands for those that its last block lacks."""
    row = basis(8)[u]
    return _pick(row + [sum(row[k:]) for k in range(8)], f"{axis} % 8 + 1 + CASE WHEN {axis} = l{axis} THEN 8 ELSE 0 END")


_IN_BLOCK = [(u, w) for u in range(8) for w in range(8)]
_CELLS = "(VALUES " + ", ".join(f"({u}, {w})" for u, w in _IN_BLOCK) + ")"
_SUMS = "ELEMENT_AT(ARRAY(" + ", ".join(f"s{u}_{w}" for u, w in _IN_BLOCK) + "), k.a * 8 + k.b + 1)"
#: Scaled two-dimensional DCT-II of the 8x8 blocks of planes of any size, a border repeating its last pixel: eight sums a line, then 64 a block.
DCT8 = Operator(f"""
SELECT image_id, c, cy, cx, k.a AS u, k.b AS w, {_SUMS} AS v FROM (
  SELECT image_id, c, y DIV 8 AS cy, cx, {', '.join(f'SUM(r{w} * {_forward("y", u)}) AS s{u}_{w}' for u, w in _IN_BLOCK)} FROM (
    SELECT image_id, c, y, ly, x DIV 8 AS cx, {', '.join(f'SUM(v * {_forward("x", w)}) AS r{w}' for w in range(8))} FROM (
      SELECT image_id, c, y, x, v, MAX(y) OVER (PARTITION BY image_id, c) AS ly, MAX(x) OVER (PARTITION BY image_id, c) AS lx FROM {{src}})
    GROUP BY image_id, c, y, ly, x DIV 8)
  GROUP BY image_id, c, y DIV 8, cx) CROSS JOIN {_CELLS} k(a, b)""")
_BACK = [[8 * v for v in row] for row in zip(*basis(8), strict=True)]
#: The samples of whole 8x8 blocks out of their coefficients.
IDCT8 = Operator(f"""
SELECT image_id, c, cy * 8 + k.a AS y, cx * 8 + k.b AS x, {_SUMS} AS v FROM (
  SELECT image_id, c, cy, cx, {', '.join(f'SUM(r{x} * {_pick(_BACK[y], "u + 1")}) AS s{y}_{x}' for y, x in _IN_BLOCK)} FROM (
    SELECT image_id, c, cy, cx, u, {', '.join(f'SUM(v * {_pick(_BACK[x], "w + 1")}) AS r{x}' for x in range(8))} FROM {{src}} GROUP BY image_id, c, cy, cx, u)
  GROUP BY image_id, c, cy, cx) CROSS JOIN {_CELLS} k(a, b)""")


def dct(rows: int, columns: int) -> Operator:
    """The same for blocks of rows x columns pixels of whole blocks only, as joins with the bases; for sides that a block of sums would be too wide for."""
    table = lambda n: "(VALUES " + ", ".join(f"({u}, {k}, {d(v)})" for u, row in enumerate(basis(n)) for k, v in enumerate(row)) + ") k(u, k, f)"
    return Operator(f"""
SELECT r.image_id, r.c, r.y DIV {rows} AS cy, r.cx, k.u, r.w, SUM(r.v * k.f) AS v FROM (
  SELECT p.image_id, p.c, p.y, p.x DIV {columns} AS cx, k.u AS w, SUM(p.v * k.f) AS v FROM {{src}} p JOIN {table(columns)} ON k.k = p.x % {columns} GROUP BY p.image_id, p.c, p.y, p.x DIV {columns}, k.u HAVING COUNT(*) = {columns}) r
JOIN {table(rows)} ON k.k = r.y % {rows} GROUP BY r.image_id, r.c, r.y DIV {rows}, r.cx, k.u, r.w HAVING COUNT(*) = {rows}""")


_BLOCK = "image_id, c, cy, cx"
COEFFICIENTS = Operator(f"SELECT {_BLOCK}, u, w, ROUND(v, 6) + 0D AS v FROM {{src}}")
SAMPLES = Operator("SELECT image_id, c, y, x, CAST(FLOOR(v + 0.5D) AS BIGINT) AS v FROM {src}")
# Where the dead zone ends in the four quarters of a block, and the biases of a quantised 1 by channel and of larger values.
DEAD_ZONE, BIAS_OF_ONE, BIAS_OF_MORE = (0.58, 0.64, 0.64, 0.64), (1 - 0.05465007330715401, 1 - 0.07005449891748593, 1 - 0.049935103337343655), 0.145


def deadzone(step: float, thresholds: tuple[float, float, float, float] = DEAD_ZONE) -> Operator:
    """Coefficients in steps, the nearest and of two the even one; 0 below the threshold of their quarter of the block."""
    limit = f"ELEMENT_AT(ARRAY({', '.join(d(t) for t in thresholds)}), CAST(u DIV 4 * 2 + w DIV 4 + 1 AS INT))"
    return Operator(f"SELECT {_BLOCK}, u, w, CAST(CASE WHEN ABS(v) / {d(step)} >= {limit} THEN {half_even(f'(v / {d(step)})')} ELSE 0D END AS BIGINT) AS q FROM {{src}}")


def dequantise(step: float) -> Operator:
    """Values for quantised coefficients, moved to where in each step they are most likely to lie."""
    one = "CASE c " + " ".join(f"WHEN {c} THEN {d(b)}" for c, b in enumerate(BIAS_OF_ONE)) + " END"
    return Operator(f"SELECT {_BLOCK}, u, w, ROUND(CASE WHEN q = 0 THEN 0D WHEN ABS(q) = 1 THEN q * {one} ELSE q - {d(BIAS_OF_MORE)} / q END * {d(step)}, 6) AS v FROM {{src}}")


NONZEROS = Operator(f"SELECT {_BLOCK}, CAST(SUM(CASE WHEN q <> 0 AND (u > 0 OR w > 0) THEN 1 ELSE 0 END) AS BIGINT) AS nonzeros, ROUND(SUM(SQRT(ABS(q) * 1D)), 4) AS sqrt_cost FROM {{src}} GROUP BY {_BLOCK}")
#: Coefficients of each channel by how often they are zero, in steps that leave most of the natural order.
COEFFICIENT_ORDER = Operator(f"""
SELECT c, u, w, zeros, ROW_NUMBER() OVER (PARTITION BY c ORDER BY FLOOR(zeros * 0.125D + 0.1D), {natural_order()}) - 1 AS place FROM (
  SELECT c, u, w, CAST(SUM(CASE WHEN q = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros FROM {{src}} GROUP BY c, u, w)""")
#: Coefficients in natural order up to the last that is not zero, the mean apart, with how many are still to come.
SCAN_TOKENS = Operator(f"""
SELECT {_BLOCK}, place, q, remaining FROM (SELECT {_BLOCK}, place, q, CAST(SUM(CASE WHEN q <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {_BLOCK} ORDER BY place DESC) AS BIGINT) AS remaining FROM (
  SELECT {_BLOCK}, q, ROW_NUMBER() OVER (PARTITION BY {_BLOCK} ORDER BY {natural_order()}) - 1 AS place FROM {{src}}) WHERE place > 0) WHERE remaining > 0""")
# What a unit of the multiplier stands for, and how far it is drawn to zero.
CFL_UNIT, CFL_SHRINK = 84.0, 2.6


def cfl_fit(base: float = 0.0, distance: float = 1e-3) -> Operator:
    """How much luma each tile's chroma (image_id, m, s) follows: least squares in closed form, drawn to zero, rounded and held in a byte."""
    return Operator(f"""
SELECT image_id, ROUND(x, 6) AS x, CAST(LEAST(127D, GREATEST(-128D, ROUND(CASE WHEN x >= {d(CFL_SHRINK)} THEN x - {d(CFL_SHRINK)} WHEN x <= {d(-CFL_SHRINK)} THEN x + {d(CFL_SHRINK)} ELSE 0D END))) AS BIGINT) AS multiplier FROM (
  SELECT image_id, -SUM(a * b) / (SUM(a * a) + COUNT(*) * {d(distance / 2)}) AS x FROM (SELECT image_id, m / {d(CFL_UNIT)} AS a, {d(base)} * m - s AS b FROM {{src}}) GROUP BY image_id)""")


#: Chroma less what luma says of it, cy the multiplier of its tile ({fit} with image_id and multiplier), and back.
def cfl_apply(base: float = 0.0, sign: int = -1) -> Operator:
    return Operator(f"SELECT p.image_id, p.y, p.x, p.m, ROUND(p.s {'-' if sign < 0 else '+'} p.m * ({d(base)} + q.multiplier / {d(CFL_UNIT)}), 6) AS s FROM {{src}} p JOIN {{fit}} q ON q.image_id = p.image_id")


#: The upper median and the median of distances to it, and the scale of a quantiser whose field (values over 0) this is.
MEDIAN_MAD = Operator("""
SELECT image_id, MAX(med) AS med, MAX(CASE WHEN rank = n DIV 2 + 1 THEN dev END) AS mad FROM (
  SELECT image_id, med, dev, n, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY dev) AS rank FROM (
    SELECT image_id, med, n, ABS(v - med) AS dev FROM (SELECT image_id, v, n, MAX(CASE WHEN rank = n DIV 2 + 1 THEN v END) OVER (PARTITION BY image_id) AS med FROM (
      SELECT image_id, v, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY v) AS rank, COUNT(*) OVER (PARTITION BY image_id) AS n FROM {src}))))
GROUP BY image_id""")
OFFSETS = Operator("SELECT image_id, frame, size, SUM(size) OVER (PARTITION BY image_id ORDER BY frame) - size AS start, SUM(duration) OVER (PARTITION BY image_id ORDER BY frame) - duration AS tick FROM {src}")
LAYER_GROUPS = Operator("SELECT image_id, frame, 1 + SUM(CASE WHEN before > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY frame) AS layer FROM (SELECT image_id, frame, LAG(duration) OVER (PARTITION BY image_id ORDER BY frame) AS before FROM {src})")
REFERENCE_SLOT = Operator("SELECT image_id, frame, MAX(CASE WHEN duration = 0 THEN frame END) OVER (PARTITION BY image_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reference FROM {src}")
#: Parts (image_id, part) that can be used: those before the first gap; repeats count once.
READY_PARTS = Operator("SELECT image_id, COUNT(*) AS ready FROM (SELECT image_id, part, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY part) - 1 AS place FROM (SELECT DISTINCT image_id, part FROM {src})) WHERE part = place GROUP BY image_id")
PASSES = Operator("SELECT image_id, y AS pass, CAST(SUM(SUM(v)) OVER (PARTITION BY image_id ORDER BY y) AS BIGINT) AS refined FROM {src} GROUP BY image_id, y")
