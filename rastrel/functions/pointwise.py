"""Per-pixel expressions: colour spaces, transfer functions, integer colour transforms, tokens.

All stay inside whole-stage code generation; constants are folded into the text.
"""

from __future__ import annotations

import math

from rastrel.plans.steps import Operator

# The absorbance matrix, its inverse and bias, the scaled offsets, and luma weights.
ABSORB = ((0.30, 1 - 0.078 - 0.30, 0.078), (0.23, 1 - 0.078 - 0.23, 0.078), (0.24342268924547819, 0.20476744424496821, 1 - 0.24342268924547819 - 0.20476744424496821))
UNABSORB = (
    (11.031566901960783, -9.866943921568629, -0.16462299647058826),
    (-3.254147380392157, 4.418770392156863, -0.16462299647058826),
    (-3.6588512862745097, 2.7129230470588235, 1.9459282392156863),
)
BIAS = 0.0037930732552754493
SCALED_OFFSET, SCALED_SCALE = (0.015386134, 0.0, 0.27770459), (22.995788804, 1.183000077, 1.502141333)
LUMA = (0.299, 0.587, 0.114)
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.5599107295


def d(x: float) -> str:
    return f"({x!r}D)" if x >= 0 else f"(-{-x!r}D)"


def dot(weights, names) -> str:
    return "(" + " + ".join(f"{d(w)} * {n}" for w, n in zip(weights, names, strict=True)) + ")"


def odd(expression: str, x: str) -> str:
    """A curve for values from 0 on, mirrored to negative ones; expression has the value as m."""
    return f"(SIGN({x}) * ({expression.replace('m', f'ABS({x})')}))"


def srgb_encode(x: str) -> str:
    return f"(SIGN({x}) * CASE WHEN ABS({x}) <= 0.0031308D THEN ABS({x}) * 12.92D ELSE 1.055D * POWER(ABS({x}), {d(1 / 2.4)}) - 0.055D END)"


def srgb_decode(x: str) -> str:
    return f"(SIGN({x}) * CASE WHEN ABS({x}) <= 0.04045D THEN ABS({x}) / 12.92D ELSE POWER((ABS({x}) + 0.055D) / 1.055D, 2.4D) END)"


def bt709_encode(x: str) -> str:
    return f"(SIGN({x}) * CASE WHEN ABS({x}) < 0.018D THEN ABS({x}) * 4.5D ELSE 1.099D * POWER(ABS({x}), 0.45D) - 0.099D END)"


def bt709_decode(x: str) -> str:
    return f"(SIGN({x}) * CASE WHEN ABS({x}) < 0.081D THEN ABS({x}) / 4.5D ELSE POWER((ABS({x}) + 0.099D) / 1.099D, {d(1 / 0.45)}) END)"


def pq_encode(x: str) -> str:
    p = f"POWER(ABS({x}), {d(PQ_M1)})"
    return f"(SIGN({x}) * POWER(({d(PQ_C1)} + {d(PQ_C2)} * {p}) / (1D + {d(PQ_C3)} * {p}), {d(PQ_M2)}))"


def pq_decode(x: str) -> str:
    p = f"POWER(ABS({x}), {d(1 / PQ_M2)})"
    return f"(SIGN({x}) * POWER(GREATEST({p} - {d(PQ_C1)}, 0D) / ({d(PQ_C2)} - {d(PQ_C3)} * {p}), {d(1 / PQ_M1)}))"


def hlg_encode(x: str) -> str:
    return f"(SIGN({x}) * CASE WHEN ABS({x}) <= {d(1 / 12)} THEN SQRT(3D * ABS({x})) ELSE {d(HLG_A)} * LN(GREATEST(12D * ABS({x}) - {d(HLG_B)}, 1e-9D)) + {d(HLG_C)} END)"


def hlg_decode(x: str) -> str:
    return f"(SIGN({x}) * CASE WHEN ABS({x}) <= 0.5D THEN ABS({x}) * ABS({x}) / 3D ELSE (EXP((ABS({x}) - {d(HLG_C)}) / {d(HLG_A)}) + {d(HLG_B)}) / 12D END)"


def _curve(encode, decode) -> Operator:
    """Both directions of a transfer function and what is left of a value after both."""
    return Operator(f"SELECT image_id, y, x, ROUND({encode('r')}, 6) AS encoded, ROUND({decode('r')}, 6) AS decoded, ROUND({decode('e')} - r, 6) AS rest FROM (SELECT *, {encode('r')} AS e FROM {{src}})")


TF_SRGB, TF_709 = _curve(srgb_encode, srgb_decode), _curve(bt709_encode, bt709_decode)
TF_PQ, TF_HLG = _curve(pq_encode, pq_decode), _curve(hlg_encode, hlg_decode)
TF_GAMMA = _curve(lambda x: f"(SIGN({x}) * POWER(ABS({x}), {d(1 / 2.2)}))", lambda x: f"(SIGN({x}) * POWER(ABS({x}), 2.2D))")

_CBRT = lambda x: f"POWER({x}, {d(1 / 3)})"
_MIXED = ", ".join(f"{_CBRT(f'GREATEST({dot(row, "rgb")} + {d(BIAS)}, 0D)')} - {d(BIAS ** (1 / 3))} AS {n}" for row, n in zip(ABSORB, "lms", strict=True))
#: Linear light to opponent colours: x the red-green difference, yy the luma, bb the blue.
XYB = Operator(f"SELECT image_id, y, x, r, g, b, (l - m) / 2D AS xx, (l + m) / 2D AS yy, s AS bb FROM (SELECT image_id, y, x, r, g, b, {_MIXED} FROM {{src}})")
_CUBES = ", ".join(f"POWER({v} + {d(BIAS ** (1 / 3))}, 3D) - {d(BIAS)} AS {n}" for v, n in (("(yy + xx)", "l"), ("(yy - xx)", "m"), ("bb", "s")))
UNXYB = Operator("SELECT image_id, y, x, " + ", ".join(f"{dot(row, 'lms')} AS {n}2" for row, n in zip(UNABSORB, "rgb", strict=True)) + f", r, g, b FROM (SELECT *, {_CUBES} FROM {{src}})")
XYB_SCALED = Operator("SELECT image_id, y, x, " + ", ".join(f"ROUND(({v} + {d(o)}) * {d(s)}, 6) AS {n}" for v, n, o, s in zip(("xx", "yy", "(bb - yy)"), "xyb", SCALED_OFFSET, SCALED_SCALE, strict=True)).replace("AS x,", "AS sx,").replace("AS y,", "AS sy,") + " FROM {src}")
XYB_POSITIVE = Operator("SELECT image_id, y, x, ROUND(14D * xx + 0.42D, 6) AS px, ROUND(yy + 0.01D, 6) AS py, ROUND(bb - yy + 0.55D, 6) AS pb FROM {src}")
YCBCR = Operator(f"SELECT *, {dot(LUMA, 'rgb')} - {d(128 / 255)} AS yy, (b - {dot(LUMA, 'rgb')}) / 1.772D AS cb, (r - {dot(LUMA, 'rgb')}) / 1.402D AS cr FROM {{src}}")
UNYCBCR = Operator(f"""SELECT image_id, y, x, r, g, b, yy + {d(128 / 255)} + 1.402D * cr AS r2, yy + {d(128 / 255)} - {d(0.114 * 1.772 / 0.587)} * cb - {d(0.299 * 1.402 / 0.587)} * cr AS g2,
  yy + {d(128 / 255)} + 1.772D * cb AS b2 FROM {{src}}""")
#: What is left of three channels after a round trip.
REST = Operator("SELECT image_id, y, x, ROUND(r2 - r, 4) + 0D AS dr, ROUND(g2 - g, 4) + 0D AS dg, ROUND(b2 - b, 4) + 0D AS db FROM {src}")
_LUMINANCE = dot((0.2627, 0.678, 0.0593), "rgb")
SMALLEST_ALPHA = 2.0**-26


def half_even(x: str) -> str:
    """The nearest integer, the even one of two."""
    return f"(CASE WHEN {x} - FLOOR({x}) = 0.5D THEN 2D * FLOOR((FLOOR({x}) + 1D) / 2D) ELSE FLOOR({x} + 0.5D) END)"


def hlg_gamma(peak: float = 1000.0, surround: float = 5.0) -> float:
    """System gamma of a display by its peak and surround luminance."""
    return 1.2 * 1.111 ** math.log2(peak / 1000) * 0.98 ** math.log2(surround / 5)


def hlg_ootf(gamma: float) -> Operator:
    """Scene to display light by the power of the luminance; with 1 / gamma the inverse. Black stays black."""
    return Operator("SELECT image_id, y, x, " + ", ".join(f"ROUND({n} * k, 6) AS {n}" for n in "rgb") + f" FROM (SELECT *, CASE WHEN {_LUMINANCE} > 0D THEN POWER({_LUMINANCE}, {d(gamma - 1)}) ELSE 1D END AS k FROM {{src}})")


def tone_map(source: tuple[float, float] = (0.0, 1000.0), target: tuple[float, float] = (0.0, 250.0)) -> Operator:
    """Rec. 2408: the knee spline on PQ-coded luminance between mastering and display range (nits), its ratio on all channels."""

    def pq(nits: float) -> float:
        p = (nits / 10000) ** PQ_M1
        return ((PQ_C1 + PQ_C2 * p) / (1 + PQ_C3 * p)) ** PQ_M2

    low, reach = pq(source[0]), pq(source[1]) - pq(source[0])
    least, most = (pq(target[0]) - low) / reach, (pq(target[1]) - low) / reach
    knee = 1.5 * most - 0.5
    spline = f"((2D * t * t * t - 3D * t * t + 1D) * {d(knee)} + (t * t * t - 2D * t * t + t) * {d(1 - knee)} + (-2D * t * t * t + 3D * t * t) * {d(most)})"
    light = f"{_LUMINANCE} * {d(source[1] / 10000)}"
    peak = target[1] / 10000
    return Operator(f"""
SELECT image_id, y, x, {', '.join(f'ROUND(CASE WHEN light <= 1e-10D THEN shown / {d(peak)} ELSE {n} * shown / light * {d(source[1] / target[1])} END, 6) AS {n}' for n in 'rgb')} FROM (
  SELECT *, LEAST({d(peak)}, GREATEST(0D, {pq_decode(f'((e2 + {d(least)} * POWER(1D - e2, 4D)) * {d(reach)} + {d(low)})')})) AS shown FROM (
    SELECT *, CASE WHEN e < {d(knee)} THEN e ELSE {spline} END AS e2 FROM (
      SELECT *, (e - {d(knee)}) / {d(max(1e-6, 1 - knee))} AS t FROM (SELECT *, {light} AS light, LEAST(1D, ({pq_encode(light)} - {d(low)}) / {d(reach)}) AS e FROM {{src}}))))""")


def gamut_map(saturation: float = 0.1) -> Operator:
    """Colours outside 0..1 mixed with grey of their luminance.

    One mix brings the channels up to 0 and leaves what exceeds 1 to a common scale, which saves saturation; the other
    brings them below 1 too, which saves luminance; saturation says how much of the first.
    """
    inner = f"SELECT *, r - l AS r_, g - l AS g_, b - l AS b_ FROM (SELECT *, {_LUMINANCE} AS l FROM {{src}})"
    last = "0D"
    for n in "rgb":
        inner = f"SELECT *, CASE WHEN {n}_ >= 0D THEN {last} ELSE GREATEST({last}, {n} / {n}_) END AS s{n} FROM ({inner})"
        last = f"s{n}"
    whole = "GREATEST(0D, " + ", ".join(f"CASE WHEN {n}_ <= 0D THEN s{n} ELSE ({n} - 1D) / {n}_ END" for n in "rgb") + ")"
    mixed = ", ".join(f"mix * (l - {n}) + {n} AS {n}2" for n in "rgb")
    return Operator(f"""
SELECT image_id, y, x, {', '.join(f'ROUND({n}2 / GREATEST(1D, r2, g2, b2), 6) + 0D AS {n}' for n in 'rgb')} FROM (
  SELECT image_id, y, x, {mixed} FROM (
    SELECT *, LEAST(1D, GREATEST(0D, {d(saturation)} * (sb - whole) + whole)) AS mix FROM (SELECT *, {whole} AS whole FROM ({inner}))))""")


#: Linear light stretched so that some of it lies outside the gamut.
STRETCH = Operator("SELECT image_id, y, x, r * 1.5D - 0.2D AS r, g * 1.5D - 0.2D AS g, b * 1.5D - 0.2D AS b FROM {src}")


def flatten(background: tuple[float, float, float] = (0.5, 0.5, 0.5), alpha: str = "a") -> Operator:
    """Straight alpha over an even background."""
    return Operator(f"SELECT image_id, y, x, {', '.join(f'ROUND({n} * {alpha} + {d(v)} * (1D - {alpha}), 6) AS {n}' for n, v in zip('rgb', background, strict=True))} FROM {{src}}")


_ALPHA = f"GREATEST(a, {d(SMALLEST_ALPHA)})"
#: All channels times alpha, and back; the floor keeps the way back open.
PREMULTIPLY = Operator(f"SELECT image_id, y, x, a, {', '.join(f'{n} * {_ALPHA} AS {n}' for n in 'rgb')} FROM {{src}}")
UNPREMULTIPLY = Operator(f"SELECT image_id, y, x, a, {', '.join(f'{n} / {_ALPHA} AS {n}' for n in 'rgb')} FROM {{src}}")
ROUNDED = Operator("SELECT image_id, y, x, ROUND(r, 6) AS r, ROUND(g, 6) AS g, ROUND(b, 6) AS b FROM {src}")


def spot_colour(colour: tuple[float, float, float], solidity: float, coverage: str = "b") -> Operator:
    """A spot colour over the image where another channel says how much of it there is."""
    return Operator(f"SELECT image_id, y, x, {', '.join(f'ROUND({d(solidity)} * {coverage} * {d(v)} + (1D - {d(solidity)} * {coverage}) * {n}, 6) AS {n}' for n, v in zip('rgb', colour, strict=True))} FROM {{src}}")


# Fixed value: how much of what exceeds the bound is kept.
KEPT_ABOVE = 0.724216145665


def shape_range(most: float, around: float) -> Operator:
    """Values eased above a bound; those around zero removed; those around zero amplified."""
    return Operator(f"""SELECT image_id, y, x, v, CASE WHEN v >= {d(most)} THEN {d(most)} + {d(KEPT_ABOVE)} * (v - {d(most)}) WHEN v < {d(-most)} THEN {d(-most)} + {d(KEPT_ABOVE)} * (v + {d(most)}) ELSE v * 1D END AS clamped,
  CASE WHEN v > {d(around)} THEN v - {d(around)} WHEN v < {d(-around)} THEN v + {d(around)} ELSE 0D END AS removed, CASE WHEN v > {d(around)} THEN v + {d(around)} WHEN v < {d(-around)} THEN v - {d(around)} ELSE 2D * v END AS amplified FROM {{src}}""")


def channel_quantise(q: int) -> Operator:
    """The nearest multiple of q, halves away from zero."""
    return Operator(f"SELECT image_id, c, y, x, CASE WHEN v < 0 THEN -((-v + {q // 2}) DIV {q}) ELSE (v + {q // 2}) DIV {q} END * {q} AS v FROM {{src}}")


def external(bits: int) -> Operator:
    """Samples of 0..1 as unsigned integers of so many bits, clamped, the nearest and of two the even one."""
    return Operator(f"SELECT image_id, y, x, {', '.join(f'CAST({half_even(f"(LEAST(1D, GREATEST(0D, {n})) * {d(float(2**bits - 1))})")} AS BIGINT) AS {n}' for n in 'rgb')} FROM {{src}}")


def planar(bits: int) -> Operator:
    """Unsigned integers of so many bits as samples of 0..1."""
    return Operator(f"SELECT image_id, y, x, {', '.join(f'{n} / {d(float(2**bits - 1))} AS {n}' for n in 'rgb')} FROM {{src}}")


#: Pixels turned as the image's orientation (1 to 8) says, whatever its size; {turn} has it for each image.
ORIENT = Operator("""
SELECT image_id, orientation, CASE WHEN orientation IN (1, 2) THEN y WHEN orientation IN (3, 4) THEN ly - y WHEN orientation IN (5, 6) THEN x ELSE lx - x END AS y,
  CASE WHEN orientation IN (1, 4) THEN x WHEN orientation IN (2, 3) THEN lx - x WHEN orientation IN (5, 8) THEN y ELSE ly - y END AS x, v
FROM (SELECT p.image_id, p.y, p.x, p.v, t.orientation, MAX(p.y) OVER (PARTITION BY p.image_id) AS ly, MAX(p.x) OVER (PARTITION BY p.image_id) AS lx FROM {src} p JOIN {turn} t ON t.image_id = p.image_id)""")


def noise_strength(lut: tuple[float, ...]) -> Operator:
    """Strength of noise at an intensity, by eight points for 0 to 7/6 and straight lines between them."""
    def point(k: str) -> str:
        return f"CASE {k} " + " ".join(f"WHEN {i} THEN {d(v)}" for i, v in enumerate(lut)) + " END"

    return Operator(f"""
SELECT image_id, y, x, ROUND({point('k')} + ({point('(k + 1)')} - {point('k')}) * rest, 6) AS strength FROM (
  SELECT image_id, y, x, CASE WHEN s >= 7D THEN 6 ELSE CAST(FLOOR(s) AS BIGINT) END AS k, CASE WHEN s >= 7D THEN 1D ELSE s - FLOOR(s) END AS rest FROM (SELECT image_id, y, x, GREATEST(0D, r * 6D) AS s FROM {{src}}))""")


def pack(v: str) -> str:
    return f"(CASE WHEN {v} >= 0 THEN 2 * ({v}) ELSE -2 * ({v}) - 1 END)"


def tokens(value: str, split: int = 4, msb: int = 2, lsb: int = 0) -> tuple[str, str]:
    """Token and number of extra bits of a value that is not negative, by the hybrid scheme (split exponent, kept high and low bits)."""
    n = f"(LENGTH(BIN({value})) - 1)"
    high = f"((({value}) - (1 << CAST({n} AS INT))) >> CAST({n} - {msb} AS INT))"
    low = f"(({value}) % {1 << lsb})"
    token = f"({1 << split} + ({n} - {split}) * {1 << (msb + lsb)} + {high} * {1 << lsb} + {low})"
    return f"(CASE WHEN {value} < {1 << split} THEN {value} ELSE {token} END)", f"(CASE WHEN {value} < {1 << split} THEN 0 ELSE {n} - {msb + lsb} END)"


HYBRID = Operator("SELECT stream, pos, v, CAST({0} AS BIGINT) AS token, CAST({1} AS BIGINT) AS extra_bits FROM {{src}}".format(*tokens("v")))
PACK_SIGNED = Operator(f"SELECT image_id, y, x, v, {pack('v')} AS packed, CASE WHEN {pack('v')} % 2 = 0 THEN {pack('v')} DIV 2 ELSE -(({pack('v')} + 1) DIV 2) END AS unpacked FROM {{src}}")


# The orders of channels that a transform number stands for.
CHANNEL_ORDERS = ((0, 1, 2), (1, 2, 0), (2, 0, 1), (0, 2, 1), (1, 0, 2), (2, 1, 0))


def rct(kind: int) -> Operator:
    """One of the 42 reversible colour transforms, forward: a permutation of channels, then one of seven kinds."""
    order, how = kind // 7, kind % 7
    a, b, c = (f"v{i}" for i in CHANNEL_ORDERS[order])
    if how == 6:
        co = f"({a} - {c})"
        mid = f"({c} + ({co} >> 1))"
        cg = f"({b} - {mid})"
        outs = (f"({mid} + ({cg} >> 1))", co, cg)
    else:
        two = {0: b, 1: f"({b} - {a})", 2: f"({b} - (({a} + {c}) >> 1))"}[how >> 1]
        outs = (a, two, f"({c} - {a})" if how & 1 else c)
    return Operator("SELECT image_id, y, x, v0, v1, v2, " + ", ".join(f"{o} AS w{i}" for i, o in enumerate(outs)) + " FROM {src}")


def unrct(kind: int) -> Operator:
    """The channels that one of the 42 transforms came from."""
    order, how = kind // 7, kind % 7
    if how == 6:
        mid = "(w0 - (w2 >> 1))"
        last = f"({mid} - (w1 >> 1))"
        outs = (f"({last} + w1)", f"(w2 + {mid})", last)
    else:
        third = "(w2 + w0)" if how & 1 else "w2"
        outs = ("w0", ("w1", "(w1 + w0)", f"(w1 + ((w0 + {third}) >> 1))")[how >> 1], third)
    return Operator("SELECT image_id, y, x, " + ", ".join(f"{o} AS v{i}" for i, o in sorted(zip(CHANNEL_ORDERS[order], outs, strict=True))) + " FROM {src}")


def _by_kind(make) -> Operator:
    """All 42 in one pass over rows that carry the transform's number as kind."""
    texts = [[c.split(" AS ")[0].strip() for c in _columns(make(k).sql)] for k in range(42)]
    names = [c.rsplit(" AS ", 1)[1].strip() for c in _columns(make(0).sql)]
    return Operator("SELECT image_id, y, x, kind, " + ", ".join(f"CASE kind {' '.join(f'WHEN {k} THEN {t[i]}' for k, t in enumerate(texts))} END AS {n}" for i, n in enumerate(names)) + " FROM {src}")


def _columns(sql: str) -> list[str]:
    """The columns of a transform's text that are not handed on, in order."""
    return [c for c in sql.removeprefix("SELECT ").removesuffix(" FROM {src}").split(", ") if " AS " in c]


RCT_BY_KIND, UNRCT_BY_KIND = _by_kind(rct), _by_kind(unrct)
#: Summed magnitudes of every transform's channels in one pass, and the cheapest for each image.
RCT_COSTS = Operator("SELECT image_id, MIN_BY(kind, cost * 100 + kind) AS kind, MIN(cost) AS cost FROM (SELECT image_id, k.k AS kind, CAST(CASE k.k " + " ".join(f"WHEN {k} THEN s{k}" for k in range(42))
                     + " END AS BIGINT) AS cost FROM (SELECT image_id, " + ", ".join("SUM(" + " + ".join(f"ABS({c.split(' AS ')[0].strip()})" for c in _columns(rct(k).sql)) + f") AS s{k}" for k in range(42))
                     + " FROM {src} GROUP BY image_id) CROSS JOIN (VALUES " + ", ".join(f"({k})" for k in range(42)) + ") k(k)) GROUP BY image_id")
QUALITY_TO_DISTANCE = Operator("SELECT q, CASE WHEN q >= 100 THEN 0D WHEN q >= 30 THEN ROUND(0.1D + (100 - q) * 0.09D, 6) ELSE ROUND(53D / 3000D * q * q - 23D / 20D * q + 25D, 6) END AS distance FROM {src}")


# Rows of the colour space's mixing, its knee and slope below it, offset, and scales of the three outputs.
LAB_MIX = ((0.43393624408206207, 0.3761977906365071, 0.1898342977380344), (0.2126729, 0.7151522, 0.072175), (0.017753810835629014, 0.10945087235996327, 0.872639210284664830))
LAB_KNEE, LAB_SLOPE, LAB_OFFSET = 0.008856451679035631, 7.787037037037037, 0.13793103448275862
LAB_ZERO, LAB_SCALE = (0.0, 0.3918181818181818, 0.49045454545454545), (1.16, 2.272727272727273, 0.9090909090909091)
_LAB = ", ".join(f"CASE WHEN {dot(row, 'rgb')} > {d(LAB_KNEE)} THEN POWER({dot(row, 'rgb')}, {d(1 / 3)}) - {d(LAB_OFFSET)} ELSE {d(LAB_SLOPE)} * {dot(row, 'rgb')} END AS f{n}" for n, row in zip("xyz", LAB_MIX, strict=True))
LAB = Operator("SELECT image_id, y, x, " + ", ".join(f"ROUND({d(z)} + {d(s)} * ({e}), 6) AS {n}" for n, z, s, e in zip(("lab_l", "lab_a", "lab_b"), LAB_ZERO, LAB_SCALE, ("fy", "fx - fy", "fy - fz"), strict=True)) + f" FROM (SELECT image_id, y, x, {_LAB} FROM {{src}})")


def fuzzy_class(score: str) -> str:
    """2 for a perfect image, 0.7777 at a score of 1, towards 0 beyond."""
    s = f"(2D / (1D + EXP(({score} - 1D) * 4.8D)))"
    return f"(CASE WHEN {score} < 1D THEN ({s} - 1D) * {d(2 - 0.7777)} + 0.7777D ELSE {s} * 0.7777D END)"


def fuzzy_score(value: str) -> str:
    """The score that a class stands for: fuzzy_class solved for it; defined for classes over 0 and below 1 + 0.2223 * 2 / (1 + e^-4.8) or so."""
    high = f"(2D / (({value} - 0.7777D) / {d(2 - 0.7777)} + 1D) - 1D)"
    return f"(1D + LN(CASE WHEN {value} > 0.7777D THEN {high} ELSE 2D / ({value} / 0.7777D) - 1D END) / 4.8D)"


FUZZY = Operator(f"SELECT image_id, y, x, ROUND(cls, 6) AS cls, ROUND({fuzzy_score('cls')} - score, 4) + 0D AS rest FROM (SELECT image_id, y, x, r * 3D AS score, {fuzzy_class('(r * 3D)')} AS cls FROM {{src}})")
# Colours of the scale from a perfect score on.
HEAT = ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0), (1, 1, 0), (1, 0, 0), (1, 0, 1), (0.5, 0.5, 1), (1, 0.5, 0.5), (1, 1, 0.5), (1, 1, 1), (1, 1, 1))


def heat_map(score: str, good: float, bad: float) -> Operator:
    """Colour of a score: three tenths of the scale up to a good one, then to a bad one, then on."""
    place = f"CASE WHEN s < {d(good)} THEN s / {d(good)} * 0.3D WHEN s < {d(bad)} THEN 0.3D + (s - {d(good)}) / {d(bad - good)} * 0.15D ELSE 0.45D + (s - {d(bad)}) / {d(bad * 12)} * 0.5D END"
    at = lambda c, k: f"CASE {k} " + " ".join(f"WHEN {i} THEN {d(float(v[c]))}" for i, v in enumerate(HEAT)) + " END"
    return Operator(f"""
SELECT image_id, y, x, {', '.join(f'ROUND(SQRT((place - k) * {at(c, "(k + 1)")} + (1D - place + k) * {at(c, "k")}), 6) AS {n}' for c, n in enumerate('rgb'))} FROM (
  SELECT *, LEAST({len(HEAT) - 2}, CAST(FLOOR(place) AS BIGINT)) AS k FROM (SELECT image_id, y, x, LEAST({d(len(HEAT) - 2.0)}, GREATEST(0D, ({place}) * {d(len(HEAT) - 1.0)})) AS place FROM (SELECT image_id, y, x, {score} AS s FROM {{src}})))""")


def dither(bits: int = 3) -> Operator:
    """To 8 bits with an ordered pattern of 2^bits by 2^bits thresholds, made by the doubling rule of recursive tessellation."""
    side = 1 << bits

    def threshold(y: int, x: int) -> float:
        rank = sum((((x ^ y) >> k & 1) << 1 | (y >> k & 1)) << 2 * (bits - 1 - k) for k in range(bits))
        return (rank + 0.5) / (side * side) - 0.5

    table = ", ".join(f"({y}, {x}, {d(threshold(y, x))})" for y in range(side) for x in range(side))
    return Operator(f"SELECT p.image_id, p.y, p.x, CAST(FLOOR(LEAST(255D, GREATEST(0D, p.r * 255D + t.t)) + 0.5D) AS BIGINT) AS v FROM {{src}} p JOIN (VALUES {table}) t(y, x, t) ON t.y = p.y % {side} AND t.x = p.x % {side}")


def xyb_range(side: int) -> tuple[Operator, Operator]:
    """The grid of side^3 colours out of rows with an id, and the range of each opponent channel over it with its first places; side is 256 at most.

    A value in millionths and its place are one number, so that all extremes are simple aggregates of one pass.
    """
    step = d(1 / (side - 1))
    grid = Operator(f"SELECT id AS image_id, id AS y, 0 AS x, (id DIV {side * side}) * {step} AS r, (id DIV {side} % {side}) * {step} AS g, (id % {side}) * {step} AS b FROM {{src}}")
    key = lambda n, place: f"(CAST(FLOOR({n} * 1e6D + 0.5D) AS BIGINT) * {1 << 24} + {place})"
    ends = ", ".join(f"MIN({key(n, 'image_id')}) AS low_{n}, MAX({key(n, f'{(1 << 24) - 1} - image_id')}) AS high_{n}" for n in ("xx", "yy", "bb"))
    pick = lambda end: "CASE n.n " + " ".join(f"WHEN '{c}' THEN {end}_{n}" for c, n in (("x", "xx"), ("y", "yy"), ("b", "bb"))) + " END"
    return grid, Operator(f"""
SELECT channel, (low >> 24) / 1e6D AS low, (high >> 24) / 1e6D AS high, low & {(1 << 24) - 1} AS at_low, {(1 << 24) - 1} - (high & {(1 << 24) - 1}) AS at_high FROM (
  SELECT n.n AS channel, {pick('low')} AS low, {pick('high')} AS high FROM (SELECT {ends} FROM {{src}}) CROSS JOIN (VALUES ('x'), ('y'), ('b')) n(n))""")
