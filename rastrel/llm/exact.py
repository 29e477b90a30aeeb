"""Exact de-duplication: group by a 128-bit content hash, compare bytes inside groups, keep one row.

Only built-in expressions. A group is keyed by (hash, text): the hash routes and pre-filters, and
the aggregation's own key comparison looks at the bytes, so texts that collide never share a group.
Copies are pre-aggregated before the shuffle, so a text that makes up a third of all rows arrives
as one row for each map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import text_or_empty


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("h128"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. keep says whether the largest or smallest id stays. Repeated rows
    count once each in group_size and get equal results; null ids lose to any id, and a group of
    null ids alone has a null keep_id and is kept. An empty table gives no rows; further columns
    of docs, whatever their names, are not read.
    """
    pick = F.max if keep == "max" else F.min
    keyed = _keyed(docs, id_col, text_col)
    sha = F.sha2(F.col("text").cast("binary"), 256)
    groups = (
        keyed.groupBy("h128", "text").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h128", sha.alias("text_sha256"), "keep_id", "group_size")
    )
    rows = keyed.select("doc_id", "h128", sha.alias("text_sha256"))
    # two texts that share the 128-bit hash still differ in the second key
    return rows.join(groups, ["h128", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """docs with one row left of each group of equal texts, all its columns as they were.

    One shuffle; of repeated rows with the id that stays, one stays.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    ranked = F.max_by if keep == "max" else F.min_by
    text = text_or_empty(text_col)
    # a null id sorts below any other
    order = F.struct(F.col(id_col).isNotNull().alias("known") if keep == "max" else F.col(id_col).isNull().alias("known"), F.col(id_col))
    kept = (
        docs.select(F.unhex(F.md5(text.cast("binary"))).alias("h128"), text.alias("key_text"), order.alias("rank"), whole.alias("whole"))
        .groupBy("h128", "key_text").agg(ranked("whole", "rank").alias("whole"))
    )
    return kept.select("whole.*")
