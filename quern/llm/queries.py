"""One query per operator, applied to its whole table with production parameters, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), limit=512)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.language import language_id

    return language_id(_table(spark, sf_dir, "documents"), folds=4, held=2)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.pitman_yor import pitman_yor_scores

    return pitman_yor_scores(_table(spark, sf_dir, "documents"), folds=7, held=2)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.licenses import license_digest

    return license_digest(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.bpe import bpe_digests

    return bpe_digests(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quern.llm.url_filter import RULES, url_filter

    # the labelled ids are taken as labels of the pages that carry them
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "block").otherwise("allow").alias("label"))
    return url_filter(_table(spark, sf_dir, "pages"), RULES, labels)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.embed_dedup import embedding_near_duplicates

    return embedding_near_duplicates(_table(spark, sf_dir, "embeddings"), 0.93)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.simhash import simhash_near_duplicates

    return simhash_near_duplicates(_table(spark, sf_dir, "documents"), radius=2, width=3, seed=42)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_language_id, op4_lm_scores, op5_license_scan, op6_byte_bpe, op7_url_filter, op8_embedding_near_dedup, op9_mix_sources, op10_simhash_near_dedup)}


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
  WHERE list_cosine_similarity(p.e, q.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.a = e.vec_id LEFT JOIN deg d ON d.a = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_embedding_near_dedup": OP8_SQL}
