"""A training-corpus pipeline of five operators: toxicity, exact and near duplicates, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as
Parquet and reads them back as the next one's docs. Stages but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rastrel.llm import bpe, exact, mixing, queries, simhash, toxicity
from rastrel.llm.common import checkpoint_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Score every document and drop those that the operator rejects; it learns from labelled rows of docs.

    Null text scores as empty. Null ids have no label and are scored like any other; of a repeated id all rows are judged
    by their own text. With fewer than two labelled rows of a kind all scores are equal.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), queries.TOXIC_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, that of the largest id; null text counts as empty, and a null id loses to any other."""
    return exact.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest id, null ids last; texts without words are one group."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that sources hold their weights; a null source counts among the rest."""
    return mixing.mix(docs, queries.WEIGHTS, rest=queries.REST, epochs=queries.EPOCHS, seed=queries.SEED).select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of tokens for each of docs; null and empty texts have none. Other columns go."""
    return bpe.encode_documents(docs, *queries.vocabulary())


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("simhash near-dedup", drop_near_copies), ("mix sources", mix_sources), ("bpe", encode)]

#: Fitted trees, components and tokens have no SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's output is removed once the next one's is written; the last stays."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs
