"""Contexts, curves and statistics that models of images are made of; codes and components in Python."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rastrel.functions.pointwise import d
from rastrel.operators.recurrences import per_plane
from rastrel.plans.steps import Operator

#: What the channel before says about a pixel: its value there and how far that is from its own gradient prediction.
PREVIOUS_CHANNEL = Operator("""
SELECT image_id, c, y, x, v, ABS(before) AS abs_value, before AS value, ABS(before - guess) AS abs_error, before - guess AS error FROM (
  SELECT image_id, c, y, x, v, COALESCE(LAG(v) OVER p, 0) AS before, COALESCE(LAG(guess) OVER p, 0) AS guess FROM (
    SELECT image_id, c, y, x, v, GREATEST(LEAST(n, w), LEAST(GREATEST(n, w), n + w - nw)) AS guess FROM {src}) WINDOW p AS (PARTITION BY image_id, y, x ORDER BY c))""")

# Contexts by how many coefficients are still to come, and by place in the scan; the first of each is never used.
LEFT_CONTEXT = (
    0, 0, 31, 62, 62, 93, 93, 93, 93, 123, 123, 123, 123, 152, 152, 152, 152, 152, 152, 152, 152, 180, 180, 180, 180, 180, 180, 180, 180, 180, 180, 180,
    180, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206,
)
PLACE_CONTEXT = (
    0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 15, 16, 16, 17, 17, 18, 18, 19, 19, 20, 20, 21, 21, 22, 22,
    23, 23, 23, 23, 24, 24, 24, 24, 25, 25, 25, 25, 26, 26, 26, 26, 27, 27, 27, 27, 28, 28, 28, 28, 29, 29, 29, 29, 30, 30, 30, 30,
)
_LEFT, _PLACE = (f"ELEMENT_AT(ARRAY({', '.join(map(str, t))}), CAST({n} + 1 AS INT))" for t, n in ((LEFT_CONTEXT, "remaining"), (PLACE_CONTEXT, "place")))
#: Context of each scanned coefficient, by how many are still to come, its place, and whether the one before is zero.
ZERO_DENSITY = Operator(f"""
SELECT image_id, c, cy, cx, place, q, remaining, ({_LEFT} + {_PLACE}) * 2 + CASE WHEN place = 1 THEN CASE WHEN remaining > 4 THEN 0 ELSE 1 END WHEN before <> 0 THEN 1 ELSE 0 END AS ctx FROM (
  SELECT *, LAG(q) OVER (PARTITION BY image_id, c, cy, cx ORDER BY place) AS before FROM {{src}})""")


def move_to_front(symbols: int) -> Operator:
    """Place of each symbol in a list that starts as 0, 1, 2, ... and gets every coded symbol to its front.

    Linear in the stream: each row is held against the alphabet, of which the last place of every symbol is known.
    """
    return Operator(f"""
SELECT stream, pos, CAST(SUM(CASE WHEN last > own THEN 1 ELSE 0 END) AS BIGINT) AS place FROM (
  SELECT stream, pos, last, MAX(CASE WHEN s = v THEN last END) OVER (PARTITION BY stream, pos) AS own FROM (
    SELECT p.stream, p.pos, p.v, k.s, COALESCE(MAX(CASE WHEN p.v = k.s THEN p.pos END) OVER (PARTITION BY p.stream, k.s ORDER BY p.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1 - k.s) AS last
    FROM {{src}} p CROSS JOIN (VALUES {', '.join(f'({s})' for s in range(symbols))}) k(s)))
GROUP BY stream, pos""")




def nearest_histogram(seeds: int = 4) -> Operator:
    """The nearest of the histograms with the most symbols, by the bits that coding with it costs."""
    return Operator(f"""
SELECT ctx, MIN_BY(seed, bits * 1000 + rank) AS seed, ROUND(MIN(bits), 2) AS bits FROM (
  SELECT h.ctx, s.seed, s.rank, FLOOR(SUM(-h.n * LOG2(COALESCE(q.n, 0) * 1D / s.total + 1D / 4096D)) * 100D + 0.5D) / 100D AS bits FROM {{src}} h
  CROSS JOIN (SELECT seed, total, ROW_NUMBER() OVER (ORDER BY total DESC, seed) AS rank FROM (SELECT ctx AS seed, SUM(n) AS total FROM {{src}} GROUP BY ctx ORDER BY total DESC, ctx LIMIT {seeds})) s
  LEFT JOIN {{src}} q ON q.ctx = s.seed AND q.symbol = h.symbol GROUP BY h.ctx, s.seed, s.rank)
GROUP BY ctx""")


def catmull_rom(samples: int = 16) -> Operator:
    """Points on the centripetal curve through control points (stream, pos, px, py), equally many for each piece; the ends go on straight.

    A point that repeats the one before it is left out, as a curve has no direction there.

    The curve over four points is interpolated from lines, then from those curves, by parameters that grow with the root of the distances.
    """
    def mix(a: str, b: str, u: str) -> str:
        return f"({a} + ({u}) * ({b} - {a}))"

    def level(name: str, source: list[str], spans: list[tuple[str, str]]) -> str:
        return ", ".join(f"{mix(f'{n}{source[k]}', f'{n}{source[k + 1]}', f'(u - {low}) / ({high})')} AS {n}{name}{k}" for n in "xy" for k, (low, high) in enumerate(spans))

    return Operator(f"""
SELECT stream, pos, step, ROUND({mix('xb0', 'xb1', '(u - t1) / d1')}, 6) AS x, ROUND({mix('yb0', 'yb1', '(u - t1) / d1')}, 6) AS y FROM (
  SELECT *, {level('b', ['a0', 'a1', 'a2'], [('0D', 'd0 + d1'), ('t1', 'd1 + d2')])} FROM (
    SELECT *, {level('a', ['0', '1', '2', '3'], [('0D', 'd0'), ('t1', 'd1'), ('t2', 'd2')])} FROM (
      SELECT p.*, d0 AS t1, d0 + d1 AS t2, k.k AS step, d0 + k.k * {d(1 / samples)} * d1 AS u FROM (
        SELECT *, {', '.join(f'SQRT(SQRT(POWER(x{k + 1} - x{k}, 2D) + POWER(y{k + 1} - y{k}, 2D))) AS d{k}' for k in range(3))} FROM (
          SELECT stream, pos, {', '.join(f'COALESCE(LAG({n}) OVER w, 2D * {n} - (LEAD({n}) OVER w)) AS {a}0, {n} AS {a}1, LEAD({n}) OVER w AS {a}2, COALESCE(LEAD({n}, 2) OVER w, 2D * (LEAD({n}) OVER w) - {n}) AS {a}3' for a, n in (('x', 'px'), ('y', 'py')))}
          FROM (SELECT * FROM (SELECT *, LAG(px) OVER o AS qx, LAG(py) OVER o AS qy FROM {{src}} WINDOW o AS (PARTITION BY stream ORDER BY pos)) WHERE qx IS NULL OR qx <> px OR qy <> py) WINDOW w AS (PARTITION BY stream ORDER BY pos)) WHERE x2 IS NOT NULL) p
      CROSS JOIN (VALUES {', '.join(f'({k})' for k in range(samples))}) k(k))))""")


#: Second moments of two channels by image, and their main axes: smaller and larger variance, and the direction of the larger.
MAIN_AXES = Operator("""
SELECT image_id, ROUND((a + b - root) / 2D, 8) AS small, ROUND((a + b + root) / 2D, 8) AS large, ROUND(ABS(m) / SQRT(m * m + POWER((a - b - root) / 2D, 2D)), 4) AS along FROM (
  SELECT image_id, a, b, m, SQRT(POWER(a - b, 2D) + 4D * m * m) AS root FROM (SELECT image_id, AVG(r * r) - AVG(r) * AVG(r) AS a, AVG(g * g) - AVG(g) * AVG(g) AS b, AVG(r * g) - AVG(r) * AVG(g) AS m FROM {src} GROUP BY image_id))
WHERE ABS(m) > 1e-10D""")


def ready_corners(rows: int, columns: int) -> Operator:
    """Corners (y, x) of a grid of parts (image_id, y, x) around which every part that the grid has is there."""
    wanted = f"(CASE WHEN y IN (0, {rows}) THEN 1 ELSE 2 END * CASE WHEN x IN (0, {columns}) THEN 1 ELSE 2 END)"
    return Operator(f"""
SELECT image_id, y, x, CAST(COUNT(*) AS BIGINT) AS here FROM (
  SELECT image_id, y + a.k AS y, x + b.k AS x FROM (SELECT DISTINCT image_id, y, x FROM {{src}} WHERE y < {rows} AND x < {columns}) CROSS JOIN (VALUES (0), (1)) a(k) CROSS JOIN (VALUES (0), (1)) b(k))
GROUP BY image_id, y, x HAVING COUNT(*) = {wanted}""")


def restore_moved(coded: DataFrame, symbols: int) -> DataFrame:
    """Symbols from their places in a move-to-front list. A stream is one task's work, a row at a time: each needs the list after the one before."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        order, out = list(range(symbols)), []
        for place in frame["place"]:
            out.append(order.pop(place))
            order.insert(0, out[-1])
        return frame[["stream", "pos"]].assign(v=out)

    return coded.select("stream", "pos", "place").groupBy("stream").applyInPandas(run, "stream long, pos long, v long")


def restore_permutation(coded: DataFrame) -> DataFrame:
    """Ranks (0, 1, ...) from how many smaller ones follow; a Fenwick tree finds the k-th one left, so a stream of n takes n log n."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        n = len(frame)
        left = [0] + [i & -i for i in range(1, n + 1)]
        top = 1 << max(n.bit_length() - 1, 0)
        out = []
        for code in frame["code"]:
            at, rest, step = 0, int(code), top
            while step:
                if at + step <= n and left[at + step] <= rest:
                    at, rest = at + step, rest - left[at + step]
                step >>= 1
            out.append(at)
            i = at + 1
            while i <= n:
                left[i] -= 1
                i += i & -i
        return frame[["stream", "pos"]].assign(v=out)

    return coded.select("stream", "pos", "code").groupBy("stream").applyInPandas(run, "stream long, pos long, v long")


def code_lengths(counts: Iterable[int], most: int) -> list[int]:
    """Depths of a Huffman tree no deeper than most: small counts are raised, twice as far at each try, until it fits."""
    counts = list(counts)
    if len(counts) < 2:
        return [1] * len(counts)
    if len(counts) > 1 << most:
        raise ValueError("more symbols than codes of that length")
    least = 1
    while True:
        heap = [(max(c, least), i, [i]) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        depths = [0] * len(counts)
        while len(heap) > 1:
            (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for k in x + y:
                depths[k] += 1
            heapq.heappush(heap, (a + b, i, x + y))
        if max(depths) <= most:
            return depths
        least *= 2


def huffman(histogram: DataFrame, most: int = 15) -> DataFrame:
    """(ctx, symbol, n) to (ctx, symbol, depth); an alphabet is one task's work."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("symbol")
        return frame[["ctx", "symbol"]].assign(depth=code_lengths(frame["n"].tolist(), most))

    return histogram.select("ctx", "symbol", "n").groupBy("ctx").applyInPandas(run, "ctx long, symbol long, depth long")


def components(pixels: DataFrame, grow: int, seed: int) -> DataFrame:
    """The least position in each pixel's component (eight neighbours, values over grow, at least one over seed), or -1.

    A component is a set of pixels that reach each other, so it does not depend on where growing starts.
    """

    def spread(planes: np.ndarray) -> np.ndarray:
        b, h, w = planes.shape
        none = h * w
        inside = planes > grow
        label = np.where(inside, np.arange(none).reshape(1, h, w), none)
        strong = np.zeros((b, none + 1), dtype=bool)
        while True:
            big = np.pad(label, ((0, 0), (1, 1), (1, 1)), constant_values=none)
            new = np.where(inside, np.min([big[:, y : y + h, x : x + w] for y in range(3) for x in range(3)], axis=0), none)
            if np.array_equal(new, label):
                break
            label = new
        image = np.broadcast_to(np.arange(b)[:, None, None], planes.shape)
        strong[image[planes > seed], label[planes > seed]] = True
        strong[:, none] = False
        return np.where(strong[image, label], label, -1)

    return per_plane(pixels, spread)
