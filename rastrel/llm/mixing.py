"""Mixing sources to target weights by Poisson replication. Built-in expressions only.

A source of weight w among sources that hold n of N rows gets the mean repetition rate
w * N * epochs / n. A document's own count inverts the Poisson distribution of that mean at a
uniform number drawn from a hash of (seed, doc_id); no state, so a task that runs again draws the
same. The copies are then shuffled globally by another hash.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import partitions

#: 52 bits of an MD5 as a number in [0, 1): exact in a double, and easy to draw in other engines.
BITS = 13
#: Rates above this are cut into equal parts whose counts add up, so that exp(-rate) stays a normal number.
MAX_RATE = 30.0
#: Rows of sources that are repeated more often than this on average are written in runs of so many copies.
HEAVY_RATE, RUN = 1000.0, 1024
ADDED = ("mix_rate", "mix_copies", "mix_copy", "mix_key")


def uniform(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS), 16, 10).cast("long").cast("double") / F.lit(float(16**BITS))


def poisson_cdf(rate: Column, terms: int) -> Column:
    """Array of P(X <= k), k = 0 .. terms - 1."""
    first = F.exp(-rate)
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms - 1)),
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda s, k: F.struct(
            (s["p"] * rate / k.cast("double")).alias("p"),
            F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * rate / k.cast("double"))).alias("c"),
        ),
    )
    return step["c"]


def source_rates(docs: DataFrame, weights: Mapping[str, float], rest: float, epochs: float, source_col: str = "source") -> DataFrame:
    """One row for each named source and one for the rest ('' as its name): n rows, weight, rate.

    At most len(weights) + 1 rows, whatever docs holds.
    """
    known = list(weights)
    key = F.when(F.col(source_col).isin(known), F.col(source_col)).otherwise(F.lit("")) if known else F.lit("")
    counts = docs.select(key.alias("mix_source")).groupBy("mix_source").agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(float(rest))
    for name, w in weights.items():
        weight = F.when(F.col("mix_source") == name, F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    # totals over a handful of rows
    return counts.selectExpr("mix_source", "n", "sum(n) OVER () AS rows", "sum(weight) OVER () AS weights", "weight").select(
        "mix_source", "n", F.expr(f"CASE WHEN weights > 0 THEN weight / weights * rows * {float(epochs)}D / n ELSE 0D END").alias("rate")
    )


def mix(
    docs: DataFrame, weights: Mapping[str, float], *, rest: float = 1.0, epochs: float = 1.0, seed: int = 42,
    id_col: str = "doc_id", source_col: str = "source", shuffle: bool = True,
) -> DataFrame:
    """docs repeated so that sources hold their target weights; adds mix_rate, mix_copies, mix_copy, mix_key.

    weights names the sources; all others together, null sources with them, have the weight rest.
    Weights are relative. A source without rows leaves its share to the others. mix_copy counts a
    row's copies from 0; a row has fewer than 2^31. mix_key is the hash that orders the shuffle. Null ids draw as the empty
    string; repeated rows draw equal counts; an empty table gives no rows; further
    columns of docs come along, but for those with the names that are added, which are replaced. Counting the
    rows of the sources is a job of its own, as it decides whether some rows have to be spread.
    """
    if any(not math.isfinite(w) or w < 0 for w in [*weights.values(), rest, epochs]):
        raise ValueError("weights and epochs must be finite and not negative")
    spark = docs.sparkSession
    rates = source_rates(docs, weights, rest, epochs, source_col)
    known = list(weights)
    key = F.when(F.col(source_col).isin(known), F.col(source_col)).otherwise(F.lit("")) if known else F.lit("")
    parts = F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int")
    cut = F.least(F.col("rate") / F.col("mix_parts"), F.lit(MAX_RATE))
    table = rates.withColumn("mix_parts", parts).withColumn("mix_cdf", poisson_cdf(cut, int(MAX_RATE + 12 * math.sqrt(MAX_RATE))))
    # bounded by the number of named sources
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*kept).alias("mix_row"), F.col(id_col).alias("mix_id"), key.alias("mix_source"))  # no other name can clash
    joined = rows.join(F.broadcast(table), "mix_source")
    ident = F.coalesce(F.col("mix_id").cast("string"), F.lit(""))

    def draw(part: Column) -> Column:
        # the number is bound as a lambda's variable, so it is made once and not for every term
        once = F.transform(F.array(uniform(F.lit(str(seed)), ident, part.cast("string"))), lambda u: F.size(F.filter(F.col("mix_cdf"), lambda c: c <= u)))
        return F.element_at(once, 1)

    count = F.aggregate(F.sequence(F.lit(1), F.col("mix_parts")), F.lit(0).cast("long"), lambda s, p: s + draw(p))
    counted = joined.withColumn("mix_copies", count).where("mix_copies > 0")
    top = rates.agg(F.max("rate")).first()[0]
    light = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_copies") - 1)))
    if top is not None and top > HEAVY_RATE:
        # the few rows of a source that is repeated so often go out in runs of copies, each of which any task can write
        runs = counted.where(F.col("rate") > HEAVY_RATE).withColumn("mix_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_copies") - 1, F.lit(RUN).cast("long"))))
        runs = runs.repartition(partitions(spark), "mix_id", "mix_run")
        heavy = runs.withColumn("mix_copy", F.explode(F.sequence(F.col("mix_run"), F.least(F.col("mix_run") + RUN, F.col("mix_copies")) - 1))).drop("mix_run")
        light = light.where(F.col("rate") <= HEAVY_RATE).unionByName(heavy)
    out = light.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), ident, F.col("mix_copy").cast("string")).cast("binary")))
    out = out.select("mix_row.*", F.col("rate").alias("mix_rate"), F.col("mix_copies").cast("int").alias("mix_copies"), F.col("mix_copy").cast("int").alias("mix_copy"), "mix_key")
    if shuffle:
        # a hash decides the partition and orders it: together a uniform permutation, without a sampling pass
        out = out.repartition(partitions(spark), "mix_key").sortWithinPartitions("mix_key")
    return out
