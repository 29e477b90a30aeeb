"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

Groups are dealt to buckets of bounded size by hash; each bucket is differenced in a task of its
own and leaves one partial partition (a sum for each shard). Those are differenced again, a bounded
number at a time, level by level, until one is left. What a level hands on is one row for each
bucket, so no task and no driver ever holds all groups.

A bucket's parts are equal, so they make no room for a group that is large beside a shard. With more
than one bucket the large groups, whose number is bounded, join at the last level, and so do as many
of the other groups as fill up the shards without them: by hash in a bounded number of lumps, most
of them small and some of a single group, that are differenced one by one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import checkpoint, prepare, spread_join, text_or_empty
from rastrel.llm.karmarkar import difference

#: Groups in a bucket, partial partitions that one task combines, and rows that one task numbers, about.
BUCKET_GROUPS, FAN_IN, CHUNK_ROWS = 20_000, 256, 100_000
#: A group over 1 / LARGE of a fair share is large, so there are fewer than LARGE for each shard. Lumps of other groups at most.
LARGE, LUMPS = 64, 8_000
OVERHEAD, LEAST_CHUNKS = 16, 8


def _deal(shards: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "gkey"], ascending=[False, True], kind="stable")
        sums = np.zeros((len(rows), shards), dtype=np.int64)
        sums[:, 0] = rows["size"]
        totals, to = difference(sums)
        return pd.DataFrame({"bucket": int(key[0]), "gkey": rows["gkey"], "part": to[:, 0], "totals": _once(totals, len(rows))})

    return run


def _once(totals: np.ndarray, rows: int) -> list:
    """The parts' totals on the first of a task's rows; the others have none."""
    return [totals.tolist(), *[None] * (rows - 1)][:rows]


def _combine(shards: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket", kind="stable")
        totals, to = difference(np.array(rows["totals"].tolist(), dtype=np.int64).reshape(len(rows), shards))
        return pd.DataFrame({"bucket": rows["bucket"], "above": int(key[0]), "to": to.tolist(), "totals": _once(totals, len(rows))})

    return run


def _loose(sizes: list[int], rest: int, shards: int) -> float:
    """The fraction of the rest's bytes that has to be dealt out singly to level the shards beside large groups of these sizes."""
    sums = np.zeros((len(sizes), shards), dtype=np.int64)
    sums[:, 0] = sizes
    totals = difference(sums)[0]
    # a fifth more than the room is, as large lumps are left over, and 0.3 for small ones to end with
    room = int((totals.max() - totals).sum())
    return min(1.0, 1.2 * room / rest + 0.3) if sizes and rest else 0.0


def _apart(groups: DataFrame, total: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """(groups for the buckets, (gkey, size, bucket) of the large groups and lumps), these with numbers below 0 for buckets."""
    large = F.col("size") * (LARGE * shards) > F.lit(total)
    found = groups.where(large).orderBy(F.desc("size"), "gkey").collect()  # fewer than LARGE * shards
    others = groups.where(~large)
    loose = _loose([g["size"] for g in found], total - sum(g["size"] for g in found), shards)
    # u: the group's place in [0, 1); lumps grow by the same factor from less than one group on
    u = F.pmod(F.xxhash64(F.lit("lump"), "gkey"), F.lit(2**40)) / F.lit(float(2**40))
    grow = math.log1p(16 * groups.count() * loose / LUMPS)
    lump = F.least(F.floor(F.log1p(u / loose * math.expm1(grow)) * (LUMPS / grow)), F.lit(LUMPS - 1)).cast("int") if loose else F.lit(0)
    singles = groups.sparkSession.createDataFrame([(g["gkey"], g["size"], -1 - LUMPS - k) for k, g in enumerate(found)], "gkey string, size long, bucket int")
    return others.where(u >= loose), singles.union(others.where(u < loose).select("gkey", "size", (-1 - lump).alias("bucket")))


def balance_groups(groups: DataFrame, shards: int) -> DataFrame:
    """groups: (gkey, size), a row for each indivisible group. Returns (gkey, shard)."""
    groups = checkpoint(groups)
    n, total = groups.agg(F.count(F.lit(1)), F.sum("size")).first()
    buckets = max(1, math.ceil(n / BUCKET_GROUPS))
    apart = None
    if buckets > 1:
        groups, apart = _apart(groups, total, shards)
    dealt = checkpoint(
        groups.withColumn("bucket", F.pmod(F.xxhash64("gkey"), F.lit(buckets)).cast("int"))
        .groupBy("bucket").applyInPandas(_deal(shards), "bucket int, gkey string, part int, totals array<long>")
    )
    level = dealt.where("totals IS NOT NULL").select("bucket", "totals")
    place = dealt.select("gkey", "bucket", "part")
    while buckets > 1:
        fewer = math.ceil(buckets / FAN_IN)
        if fewer == 1:
            none = F.array_repeat(F.lit(0).cast("long"), shards - 1)
            level = level.union(apart.groupBy("bucket").agg(F.concat(F.array(F.sum("size")), none).alias("totals")))
            place = place.union(apart.select("gkey", "bucket", F.lit(0).alias("part")))
        merged = checkpoint(
            level.withColumn("above", F.pmod("bucket", F.lit(fewer)).cast("int"))
            .groupBy("above").applyInPandas(_combine(shards), "bucket int, above int, to array<int>, totals array<long>")
        )
        place = place.join(merged.select("bucket", "above", "to"), "bucket").select(
            "gkey", F.col("above").alias("bucket"), F.expr("to[part]").alias("part")
        )
        level = merged.where("totals IS NOT NULL").select(F.col("above").alias("bucket"), "totals")
        buckets = fewer
    return place.select("gkey", F.col("part").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its shard, under the law 'bytes': shards hold near equal sizes.

    A row's size is the UTF-8 bytes of its text (null: none) plus 16. Rows of equal text go to one
    shard; null and empty text are one group. A group larger than a fair share fills its shard by
    itself, and the others are balanced; smaller large groups get shards of the common size. slot numbers a shard's
    rows from 0 without gaps, by a hash of id and text that deals them to chunks, as many as the table's rows ask
    for, then by text and id within a chunk; no setting of Spark changes it. Repeated rows get slots of their own. An
    empty table gives no rows, and further columns of docs are not read.
    """
    prepare(docs.sparkSession)
    text = text_or_empty(text_col)
    size = F.octet_length(text).cast("long") + OVERHEAD
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.md5(text.cast("binary")).alias("gkey"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = checkpoint(rows)
    groups = checkpoint(rows.groupBy("gkey").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    total = rows.count()
    named = checkpoint(balance_groups(groups.select("gkey", "size"), shards).join(groups.select("gkey", "n"), "gkey"))
    placed = spread_join(rows, named, "gkey", "n", total)
    # number the rows of a shard chunk by chunk, so that one large shard is not one task
    spread = max(LEAST_CHUNKS, math.ceil(total / CHUNK_ROWS))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "gkey"), F.lit(spread)).cast("int"))
    numbered = placed.selectExpr("*", "row_number() OVER (PARTITION BY shard, chunk ORDER BY gkey, doc_id) - 1 AS at")
    counts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.selectExpr("shard", "chunk", "coalesce(sum(n) OVER (PARTITION BY shard ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead")
    return numbered.join(before, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
