"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

All state stays in DataFrames; each round is cut with a reliable checkpoint. Minima are
pre-aggregated before the shuffle. The join back to a node's edges broadcasts the few nodes that hold
more than a thousandth of all edges, so a hub's edges stay spread over the tasks that read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import checkpoint, spread_join


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return spread_join(both.where("v > u"), low, "u", "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """edges: u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return (
        spread_join(edges, low, "u", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(low.select("u", F.col("m").alias("v")))
    )


def _down(edges: DataFrame) -> DataFrame:
    """Each edge from its larger to its smaller end, once; loops go."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(node, component) for every node that has an edge to another node; component is the smallest node reachable.

    Rows with a null end and loops are ignored; repeated edges do no harm; without edges the result
    is empty.
    """
    now = checkpoint(_down(edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).dropna()))
    was, state = None, _state(now)
    while state != was and state[0]:
        large = checkpoint(_down(_large_star(now, state[0])))
        now = checkpoint(_down(_small_star(large, large.count())))
        was, state = state, _state(now)
    # a star now: every node but the root points at its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
