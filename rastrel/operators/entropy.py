"""Histograms, entropy and coding cost over token streams. Counts are partial before they are shuffled."""

from __future__ import annotations

from rastrel.functions.pointwise import tokens
from rastrel.plans.steps import Operator

_TOKEN, _BITS = tokens("packed")
#: Cost in bits of one image: entropy of its tokens by context, and the raw bits beside them.
IMAGE_COST = Operator(f"""
SELECT image_id, label, ROUND(SUM(bits), 6) AS cost_bits, CAST(SUM(pixels) AS BIGINT) AS pixels FROM (
  SELECT image_id, label, SUM(n) AS pixels, SUM(extra) + CASE WHEN COUNT(*) = 1 THEN 0D ELSE SUM(-n * LOG2(n / total)) END AS bits FROM (
    SELECT *, SUM(n) OVER (PARTITION BY image_id, ctx) * 1D AS total FROM (
      SELECT image_id, label, ctx, token, COUNT(*) * 1D AS n, SUM(extra) * 1D AS extra FROM (SELECT image_id, label, ctx, {_TOKEN} AS token, {_BITS} AS extra FROM {{src}}) GROUP BY image_id, label, ctx, token))
  GROUP BY image_id, label, ctx)
GROUP BY image_id, label""")
LABEL_COST = Operator("SELECT label, COUNT(*) AS images, ROUND(SUM(cost_bits) / SUM(pixels), 6) AS bits_per_pixel FROM {src} GROUP BY label")
HISTOGRAM = Operator("SELECT stream AS ctx, v AS symbol, COUNT(*) AS n FROM {src} GROUP BY stream, v")
ENTROPY = Operator("""
SELECT ctx, CAST(MAX(total) AS BIGINT) AS total, COUNT(*) AS symbols, ROUND(CASE WHEN COUNT(*) = 1 THEN 0D ELSE SUM(-n * LOG2(n / total)) END, 4) AS bits,
  ROUND(SUM(-n * LOG2(GREATEST(n / total, 1D / 4096D))), 4) AS bits_least
FROM (SELECT ctx, symbol, n * 1D AS n, SUM(n) OVER (PARTITION BY ctx) * 1D AS total FROM {src}) GROUP BY ctx""")
#: Distance of each histogram to the sum of it and the next: bits of coding both together less bits apart; and the divergence.
HISTOGRAM_DISTANCE = Operator("""
SELECT ctx, ROUND(SUM(CASE WHEN a + b > 0 THEN -(a + b) * LOG2((a + b) / (ta + tb)) ELSE 0D END) - SUM(CASE WHEN a > 0 THEN -a * LOG2(a / ta) ELSE 0D END) - SUM(CASE WHEN b > 0 THEN -b * LOG2(b / tb) ELSE 0D END), 4) AS distance,
  ROUND(SUM(CASE WHEN a > 0 THEN a * (LOG2(a / ta) - LOG2(GREATEST(b / tb, 1D / 4096D))) ELSE 0D END), 4) AS divergence FROM (
  SELECT *, SUM(a) OVER (PARTITION BY ctx) AS ta, SUM(b) OVER (PARTITION BY ctx) AS tb FROM (
    SELECT ctx, symbol, SUM(a) * 1D AS a, SUM(b) * 1D AS b FROM (SELECT ctx, symbol, n AS a, 0 AS b FROM {src} UNION ALL SELECT ctx - 1 AS ctx, symbol, 0 AS a, n AS b FROM {src}) GROUP BY ctx, symbol)) WHERE ta > 0 AND tb > 0
GROUP BY ctx""")


def quantiles(chunks: int = 8) -> Operator:
    """Least symbols by which so many chunks of equal weight end, the last one's left out."""
    return Operator(f"""
SELECT ctx, k.k, MIN(symbol) AS threshold FROM (SELECT ctx, symbol, SUM(n) OVER (PARTITION BY ctx ORDER BY symbol) AS upto, SUM(n) OVER (PARTITION BY ctx) AS total FROM {{src}})
JOIN (VALUES {', '.join(f'({k})' for k in range(1, chunks))}) k(k) ON upto * {chunks} >= k.k * total GROUP BY ctx, k.k""")


MODE = Operator("SELECT ctx, MIN(symbol) AS mode, MAX(n) AS n FROM (SELECT *, MAX(n) OVER (PARTITION BY ctx) AS top FROM {src}) WHERE n = top GROUP BY ctx")
RUN_LENGTHS = Operator("""
SELECT stream, MIN(pos) AS start, MIN(v) AS v, COUNT(*) AS length FROM (SELECT *, SUM(CASE WHEN v = before THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY pos) AS run FROM (
  SELECT stream, pos, v, LAG(v) OVER (PARTITION BY stream ORDER BY pos) AS before FROM {src})) GROUP BY stream, run""")
UINT_CONFIGS = ((4, 2, 0), (4, 1, 1), (5, 2, 0), (6, 1, 1), (7, 0, 0))
_SCHEMES = [tokens("v", *c) for c in UINT_CONFIGS]
#: The token scheme of least cost for each stream; every value is read once and gives a row for each scheme.
UINT_SEARCH = Operator("SELECT stream, MIN_BY(config, cost * 10 + config) AS config, MIN(cost) AS cost FROM (SELECT stream, config, ROUND(SUM(-n * LOG2(n / total)) + SUM(extra), 4) AS cost FROM ("
                       "SELECT *, SUM(n) OVER (PARTITION BY stream, config) * 1D AS total FROM (SELECT stream, config, token, COUNT(*) * 1D AS n, SUM(extra) * 1D AS extra FROM ("
                       "SELECT stream, k.k AS config, CASE k.k " + " ".join(f"WHEN {i} THEN {t}" for i, (t, _) in enumerate(_SCHEMES)) + " END AS token, CASE k.k " + " ".join(f"WHEN {i} THEN {e}" for i, (_, e) in enumerate(_SCHEMES))
                       + " END AS extra FROM {src} CROSS JOIN (VALUES " + ", ".join(f"({i})" for i in range(len(UINT_CONFIGS))) + ") k(k)) GROUP BY stream, config, token)) GROUP BY stream, config) GROUP BY stream")
CLUSTER_RENUMBER = Operator("SELECT stream, v, DENSE_RANK() OVER (PARTITION BY stream ORDER BY first_pos) - 1 AS cluster FROM (SELECT stream, v, MIN(pos) AS first_pos FROM {src} GROUP BY stream, v)")
LEHMER = Operator("""
SELECT a.stream, a.pos, COUNT(b.pos) AS code FROM (SELECT stream, pos, ROW_NUMBER() OVER (PARTITION BY stream ORDER BY v, pos) AS p FROM {src}) a
LEFT JOIN (SELECT stream, pos, ROW_NUMBER() OVER (PARTITION BY stream ORDER BY v, pos) AS p FROM {src}) b ON b.stream = a.stream AND b.pos > a.pos AND b.p < a.p GROUP BY a.stream, a.pos""")
DELTAS = Operator("SELECT stream, pos, v - COALESCE(LAG(v) OVER (PARTITION BY stream ORDER BY pos), 0) AS first_order, v - 2 * COALESCE(LAG(v) OVER (PARTITION BY stream ORDER BY pos), 0) + COALESCE(LAG(v, 2) OVER (PARTITION BY stream ORDER BY pos), 0) AS second_order FROM {src}")
SYMBOLS = Operator("SELECT stream, pos, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE LENGTH(event_type) END AS v FROM {src}")
