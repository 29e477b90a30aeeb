"""Recurrences over the pixels of a plane, each of which needs results of earlier ones.

Planes are gathered to one row each, so a plane has to fit into a row; planes of one shape in a batch
run together, the loop going over positions and numpy over planes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The planes of an image table, values row by row.
PLANES = """SELECT image_id, c, MAX(y) + 1 AS height, MAX(x) + 1 AS width, TRANSFORM(ARRAY_SORT(COLLECT_LIST(STRUCT(y, x, v))), t -> t.v) AS vals FROM {src} GROUP BY image_id, c"""
# Largest weights of the four guesses, and the shares of earlier errors in them.
WEIGHTS = (13, 12, 12, 12)
SHARE_N, SHARE_W, SHARES_NW_N_NE, SHARES_NN_NW = 16, 10, (7, 7, 7), (0, 0)
#: Guesses carry so many bits below the unit.
FRACTION = 3


def per_plane(pixels: DataFrame, run: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(image_id, c, y, x, v) with v replaced by run on (planes, height, width) of integers."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (h, w), group in frame.groupby(["height", "width"]):
                out = run(np.stack(group["vals"].to_numpy()).astype(np.int64).reshape(len(group), h, w))
                yield pd.DataFrame({"image_id": group["image_id"], "c": group["c"], "width": out.shape[2], "vals": list(out.reshape(len(group), -1))})

    packed = pixels.sparkSession.sql(PLANES, src=pixels)
    rows = packed.mapInPandas(batches, "image_id long, c long, width long, vals array<long>").selectExpr("image_id", "c", "width", "posexplode(vals) AS (pos, v)")
    return rows.selectExpr("image_id", "c", "pos DIV width AS y", "pos % width AS x", "v")


def _log2(a: np.ndarray) -> np.ndarray:
    return np.frexp(a.astype(np.float64))[1] - 1


_INVERSE = (1 << 24) // np.arange(1, 65)


def _confidence(errors: np.ndarray, most: int) -> np.ndarray:
    """About most * 2^24 / (errors + 1), from a table of 64 inverses."""
    shift = np.maximum(_log2(errors + 1) - 5, 0)
    return 4 + ((most * _INVERSE[errors >> shift]) >> shift)


def _mix(guesses: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    down = _log2(sum(weights)) - 4
    weights = [w >> down for w in weights]
    total = sum(weights)
    return (sum(g * w for g, w in zip(guesses, weights, strict=True)) + (total >> 1) - 1) * _INVERSE[total - 1] >> 24


def _weighted(planes: np.ndarray, restore: bool) -> np.ndarray:
    """Residuals of the self-correcting predictor, or the values from residuals."""
    b, h, w = planes.shape
    values, out = (np.zeros_like(planes), planes.copy()) if restore else (planes, np.zeros_like(planes))
    miss = np.zeros((h + 1, w, b), dtype=np.int64)  # signed, by row with an empty one on top
    missed = np.zeros((4, h + 1, w, b), dtype=np.int64)  # of each guess, unsigned
    none = np.zeros(b, dtype=np.int64)
    half = (1 << FRACTION >> 1) - 1
    for y in range(h):
        for x in range(w):
            left = values[:, y, x - 1] if x else values[:, y - 1, x] if y else none
            top = values[:, y - 1, x] if y else left
            top_left = values[:, y - 1, x - 1] if x and y else left
            top_right = values[:, y - 1, x + 1] if y and x + 1 < w else top
            top2 = values[:, y - 2, x] if y > 1 else top
            W, N, NW, NE, NN = (a << FRACTION for a in (left, top, top_left, top_right, top2))
            x0, x1 = max(x - 1, 0), min(x + 1, w - 1)
            eW = miss[y + 1, x - 1] if x else none
            eN, eNW, eNE = miss[y, x], miss[y, x0], miss[y, x1]
            guesses = [
                W + NE - N,
                N - ((eN + eW + eNE) * SHARE_N >> 5),
                W - ((eN + eW + eNW) * SHARE_W >> 5),
                N - ((eNW * SHARES_NW_N_NE[0] + eN * SHARES_NW_N_NE[1] + eNE * SHARES_NW_N_NE[2] + (NN - N) * SHARES_NN_NW[0] + (NW - W) * SHARES_NN_NW[1]) >> 5),
            ]

            def seen(i: int, at: int) -> np.ndarray:
                """What guess i missed above a place, and left of it: the miss at a pixel counts at its upper right neighbour too."""
                return missed[i, y, at] + (missed[i, y + 1, at - 1] if 0 < at <= x else 0)

            weights = []
            for i in range(4):
                # left of the upper left neighbour lies the pixel two to the left; one step before the first column is the pixel above itself
                weights.append(_confidence(seen(i, x) + seen(i, x1) + seen(i, x0), WEIGHTS[i]))
            guess = _mix(guesses, weights)
            held = np.maximum(np.minimum(guess, np.maximum(np.maximum(W, N), NE)), np.minimum(np.minimum(W, N), NE))
            guess = np.where(((eN ^ eW) | (eN ^ eNW)) > 0, guess, held)
            whole = (guess + half) >> FRACTION
            if restore:
                values[:, y, x] = planes[:, y, x] + whole
            else:
                out[:, y, x] = planes[:, y, x] - whole
            actual = values[:, y, x] << FRACTION
            miss[y + 1, x] = guess - actual
            for i in range(4):
                missed[i, y + 1, x] = (np.abs(guesses[i] - actual) + half) >> FRACTION
    return values if restore else out


def weighted_residuals(pixels: DataFrame) -> DataFrame:
    return per_plane(pixels, lambda planes: _weighted(planes, False))


def weighted_restore(residuals: DataFrame) -> DataFrame:
    """Pixels from what weighted_residuals left of them."""
    return per_plane(residuals, lambda planes: _weighted(planes, True))


def _tendency(b: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expected difference of a pair from the averages around it: a third of the slope, where the slope is one, and no overshoot."""
    fall = (b >= a) & (a >= n)
    rise = (b <= a) & (a <= n) & ~fall
    sign = np.where(rise, -1, 1)
    down, on = np.abs(b - a), np.abs(a - n)
    t = np.trunc((sign * (4 * b - 3 * n - a) + 6) / 12).astype(np.int64)
    t = np.where(t - (t & 1) > 2 * down, 2 * down + 1, t)
    t = np.where(t + (t & 1) > 2 * on, 2 * on, t)
    return np.where(fall | rise, sign * t, 0)


def unsqueeze_planes(averages: np.ndarray, residuals: np.ndarray) -> np.ndarray:
    """Rows of twice the width out of averages and residuals; an odd last average is its pixel."""
    pairs = residuals.shape[2]
    out = np.zeros((*averages.shape[:2], averages.shape[2] + pairs), dtype=np.int64)
    for x in range(pairs):
        a = averages[:, :, x]
        before = out[:, :, 2 * x - 1] if x else a
        after = averages[:, :, x + 1] if x + 1 < averages.shape[2] else a
        gap = residuals[:, :, x] + _tendency(before, a, after)
        out[:, :, 2 * x] = a + np.where(gap < 0, -(-gap >> 1), gap >> 1)
        out[:, :, 2 * x + 1] = out[:, :, 2 * x] - gap
    if averages.shape[2] > pairs:
        out[:, :, -1] = averages[:, :, -1]
    return out


def unsqueeze(squeezed: DataFrame) -> DataFrame:
    """(image_id, c, y, x, average, residual) back to pixels; residual is null where a row's last average stands alone."""
    stacked = squeezed.selectExpr("image_id", "c", "stack(2, 2 * y, average, 2 * y + 1, residual) AS (y, v)", "x")
    odd = squeezed.where("residual IS NULL").selectExpr("image_id", "c").distinct()
    whole = stacked.join(odd, ["image_id", "c"], "left_anti")
    rest = stacked.join(odd, ["image_id", "c"], "left_semi").selectExpr("image_id", "c", "y", "x", "COALESCE(v, 0) AS v")
    even = per_plane(whole, lambda p: unsqueeze_planes(p[:, 0::2], p[:, 1::2]))
    return even.unionByName(per_plane(rest, lambda p: unsqueeze_planes(p[:, 0::2], p[:, 1::2, :-1])))
