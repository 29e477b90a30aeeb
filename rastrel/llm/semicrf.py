"""A semi-Markov conditional random field over candidate segments (plain Python and dicts of weights).

A region of text is a sequence of n tokens. A segment covers tokens i..j and has a type and features
of the whole span; whatever no segment covers is outside, token by token, with score 0. Scores of a
segmentation add up; the dynamic programme over its ends, bounded by the longest segment, sums or
maximises over all segmentations.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterable

Segment = tuple[int, int, str]  # first token, end, type


class SemiCrf:
    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def decode(self, n: int, starting: Callable[[int], Iterable[tuple[int, str, float]]]) -> list[Segment]:
        """The segmentation of largest score; ties go to fewer segments. starting(i): end, type and score of the candidates from token i on.

        From the last token to the first, so that each candidate is looked at once and then forgotten; a token costs three numbers.
        """
        best = array("d", bytes(8 * (n + 1)))
        reach, kind = array("q", bytes(8 * n)), array("b", bytes(n))
        names: list[str] = []
        for i in range(n - 1, -1, -1):
            top, to, what = best[i + 1], 0, 0
            for j, name, score in starting(i):
                v = score + best[j]
                if v > top + 1e-12:
                    if name not in names:
                        names.append(name)
                    top, to, what = v, j, names.index(name)
            best[i], reach[i], kind[i] = top, to, what
        out, i = [], 0
        while i < n:
            if reach[i]:
                out.append((i, reach[i], names[kind[i]]))
                i = reach[i]
            else:
                i += 1
        return out

    def _gradient(self, n: int, candidates: list[tuple[Segment, list[str]]], gold: set[Segment]) -> dict[str, float]:
        """Features of the gold segmentation less their expectation."""
        scored = [(s, f, self.score(f)) for s, f in candidates]
        ending: dict[int, list] = {}
        starting: dict[int, list] = {}
        for x in scored:
            ending.setdefault(x[0][1], []).append(x)
            starting.setdefault(x[0][0], []).append(x)

        def total(values: list[float]) -> float:
            top = max(values)
            return top + math.log(sum(math.exp(v - top) for v in values))

        forward = [0.0] * (n + 1)
        for j in range(1, n + 1):
            forward[j] = total([forward[j - 1], *[forward[s[0]] + v for s, _, v in ending.get(j, ())]])
        backward = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            backward[i] = total([backward[i + 1], *[backward[s[1]] + v for s, _, v in starting.get(i, ())]])
        out: dict[str, float] = {}
        for s, f, v in scored:
            d = (s in gold) - math.exp(forward[s[0]] + v + backward[s[1]] - forward[n])
            if abs(d) > 1e-9:
                for name in f:
                    out[name] = out.get(name, 0.0) + d
        return out

    def fit(self, data: list[tuple[int, list[tuple[Segment, list[str]]], set[Segment]]], epochs: int = 12, rate: float = 0.2, l2: float = 1e-3) -> SemiCrf:
        """Stochastic ascent of the conditional likelihood, with per-feature rates (Adagrad); in the order given."""
        squares: dict[str, float] = {}
        for _ in range(epochs):
            for n, candidates, gold in data:
                for name, g in self._gradient(n, candidates, gold).items():
                    g -= l2 * self.weights.get(name, 0.0)
                    squares[name] = squares.get(name, 1e-6) + g * g
                    self.weights[name] = self.weights.get(name, 0.0) + rate * g / math.sqrt(squares[name])
        return self
