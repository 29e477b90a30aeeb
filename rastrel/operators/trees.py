"""Decision trees over a pixel's properties, written as text: compiled to expressions, not walked row by row.

    if W-NW > 5
      if |N| > 100 - Gradient + 1
      - W 0
    - Set 3

A node tests a property; its first branch holds where the value is greater. A leaf names a predictor and an offset.
"""

from __future__ import annotations

from dataclasses import dataclass

from rastrel.operators.neighbourhood import PREDICTORS
from rastrel.plans.steps import Operator

#: Properties and predictors by the names of the text.
PROPERTIES = {
    "c": "c", "y": "y", "x": "x", "|N|": "ABS(n)", "|W|": "ABS(w)", "N": "n", "W": "w", "W-WW-NW+NWW": "w_less_gradient", "W+N-NW": "(w + n - nw)",
    "W-NW": "(w - nw)", "NW-N": "(nw - n)", "N-NE": "(n - ne)", "N-NN": "(n - nn)", "W-WW": "(w - ww)",
}
LEAVES = {
    "Set": "zero", "W": "left", "N": "top", "AvgW+N": "average0", "Select": "select", "Gradient": "gradient", "NE": "top_right", "NW": "top_left", "WW": "left_left",
    "AvgW+NW": "average1", "AvgN+NW": "average2", "AvgN+NE": "average3", "AvgAll": "average4",
}


@dataclass(frozen=True)
class Leaf:
    predictor: str
    offset: int


@dataclass(frozen=True)
class Split:
    name: str
    above: int
    greater: Split | Leaf
    other: Split | Leaf


def parse(text: str) -> Split | Leaf:
    """The tree of a text; a ValueError says what is wrong with it."""
    words = text.split()

    def integer(word: str) -> int:
        try:
            return int(word)
        except ValueError:
            raise ValueError(f"not a number: {word}") from None

    def take(k: int, known: dict | None = None) -> str:
        if k >= len(words):
            raise ValueError("the text ends inside a node")
        if known is not None and words[k] not in known:
            raise ValueError(f"unknown name: {words[k]}")
        return words[k]

    def node(k: int) -> tuple[Split | Leaf, int]:
        kind = take(k)
        if kind == "if":
            name = take(k + 1, PROPERTIES)
            if take(k + 2) != ">":
                raise ValueError(f"> expected, not {words[k + 2]}")
            above = integer(take(k + 3))
            greater, k = node(k + 4)
            other, k = node(k)
            return Split(name, above, greater, other), k
        if kind != "-":
            raise ValueError(f"neither a test nor a leaf: {kind}")
        name = take(k + 1, LEAVES)
        sign = take(k + 2)
        if sign in "+-":
            return Leaf(name, integer(sign + take(k + 3))), k + 4
        return Leaf(name, integer(sign)), k + 3

    tree, end = node(0)
    if end < len(words):
        raise ValueError(f"words after the tree: {words[end]}")
    return tree


def describe(tree: Split | Leaf, depth: int = 0) -> str:
    """The text of a tree, a line for each node."""
    pad = "  " * depth
    if isinstance(tree, Leaf):
        return f"{pad}- {tree.predictor} {'+' if tree.offset >= 0 else '-'} {abs(tree.offset)}"
    return f"{pad}if {tree.name} > {tree.above}\n{describe(tree.greater, depth + 1)}\n{describe(tree.other, depth + 1)}"


def leaves(tree: Split | Leaf) -> list[Leaf]:
    return [tree] if isinstance(tree, Leaf) else leaves(tree.greater) + leaves(tree.other)


def choose(tree: Split | Leaf, results: list[str]) -> str:
    """One expression for the result of the leaf that a row reaches."""
    if isinstance(tree, Leaf):
        return results[0]
    n = len(leaves(tree.greater))
    return f"CASE WHEN {PROPERTIES[tree.name]} > {tree.above} THEN {choose(tree.greater, results[:n])} ELSE {choose(tree.other, results[n:])} END"


def apply(tree: Split | Leaf) -> Operator:
    """Leaf, prediction and residual of every pixel with its neighbours."""
    ends = leaves(tree)
    guesses = [f"({PREDICTORS[LEAVES[e.predictor]]} + ({e.offset}))" for e in ends]
    return Operator(f"""
SELECT image_id, c, y, x, leaf, guess, v - guess AS residual FROM (SELECT image_id, c, y, x, v, {choose(tree, [str(i) for i in range(len(ends))])} AS leaf, {choose(tree, guesses)} AS guess FROM (
  SELECT *, w - COALESCE(LAG(w + n - nw) OVER (PARTITION BY image_id, c, y ORDER BY x), 0) AS w_less_gradient FROM {{src}}))""")


def best_split(properties: dict[str, str], step: int = 32) -> Operator:
    """Gain in bits of splitting a sample of pixels at each bound of each property, from token counts up to it and above."""
    from rastrel.functions.pointwise import tokens

    token, _ = tokens("packed")
    each = " UNION ALL ".join(f"SELECT '{n}' AS property, {p} DIV {step} AS bin, {token} AS token FROM {{src}}" for n, p in properties.items())
    bits = lambda n, t: f"SUM(CASE WHEN {n} > 0 THEN -{n} * LOG2({n} / {t}) ELSE 0D END)"
    return Operator(f"""
SELECT property, bin, ROUND({bits('(lo + hi)', '(tlo + thi)')} - {bits('lo', 'tlo')} - {bits('hi', 'thi')}, 3) AS gain FROM (
  SELECT *, SUM(lo) OVER (PARTITION BY property, bin) AS tlo, SUM(hi) OVER (PARTITION BY property, bin) AS thi FROM (
    SELECT property, bin, token, SUM(n) OVER (PARTITION BY property, token ORDER BY bin) * 1D AS lo, (SUM(n) OVER (PARTITION BY property, token) - SUM(n) OVER (PARTITION BY property, token ORDER BY bin)) * 1D AS hi FROM (
      SELECT g.property, g.bin, g.token, COALESCE(h.n, 0) AS n FROM (
        SELECT b.property, b.bin, t.token FROM (SELECT DISTINCT property, bin FROM ({each})) b JOIN (SELECT DISTINCT property, token FROM ({each})) t ON t.property = b.property) g
      LEFT JOIN (SELECT property, bin, token, COUNT(*) AS n FROM ({each}) GROUP BY property, bin, token) h ON h.property = g.property AND h.bin = g.bin AND h.token = g.token)))
WHERE tlo > 0 AND thi > 0 GROUP BY property, bin""")
