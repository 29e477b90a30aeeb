"""The ten corpus operators as queries over whole tables, and their oracle SQL where SQL has one."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm import bpe, embeddings, exact, html_extract, mixing, pii, sharding, simhash, substring, toxicity
from rastrel.llm.common import table

#: The vocabulary file of the tokenizer, by name; its folder comes with the installed tokenizers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Target weights of the mixture: the large source is held down, a few are repeated.
WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 3.0, "src3": 2.0}
REST, EPOCHS, SEED, SHARDS, TOXIC_FROM = 14.0, 1.0, 42, 40, 0.7


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), *vocabulary(), with_ids=False)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = simhash.near_duplicate_components(table(spark, sf_dir, "documents"))
    return parts.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, rest=REST, epochs=EPOCHS, seed=SEED)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.learn(pages))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.learn(docs))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_simhash, op3_shard, op4_mix, op5_toxicity, op6_html, op7_embeddings, op8_pii, op9_substring, op10_exact)}

_EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


def mix_sql(source: str = "documents") -> str:
    """DuckDB's version of mixing.mix with the parameters above, for rates of up to mixing.MAX_RATE."""
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())
    names = ", ".join(f"'{k}'" for k in WEIGHTS)
    terms = int(mixing.MAX_RATE + 12 * math.sqrt(mixing.MAX_RATE))
    return f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN source IN ({names}) THEN source ELSE '' END AS mix_source FROM {source}),
n AS (SELECT mix_source, count(*) AS n, CASE mix_source {cases} ELSE {REST} END::DOUBLE AS weight FROM d GROUP BY mix_source),
r AS (SELECT mix_source, weight / (SELECT sum(weight) FROM n) * (SELECT sum(n) FROM n)::BIGINT * {EPOCHS}::DOUBLE / n AS rate FROM n),
cdf(mix_source, rate, k, p, c) AS (
  SELECT mix_source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL
  SELECT mix_source, rate, k + 1, p * rate / (k + 1)::DOUBLE, c + p * rate / (k + 1)::DOUBLE FROM cdf WHERE k + 1 < {terms}
),
u AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':1'), 1, {mixing.BITS}))::BIGINT::DOUBLE / {16**mixing.BITS}::DOUBLE AS u FROM d),
counted AS (SELECT u.*, r.rate AS mix_rate, (SELECT count(*) FROM cdf WHERE cdf.mix_source = u.mix_source AND cdf.c <= u.u)::INTEGER AS mix_copies FROM u JOIN r USING (mix_source))
SELECT doc_id, text, lang, source, n_chars, mix_rate, mix_copies, copy.k::INTEGER AS mix_copy, md5('order{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || copy.k) AS mix_key
FROM counted, LATERAL (SELECT unnest(range(mix_copies)) AS k) copy
"""


ORACLE_SQL = {"op4_mix": mix_sql(), "op10_exact": _EXACT}
