"""Reciprocal-rank fusion of ranked lists, and the hybrid of both arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.lexical import ranked

#: The rank constant, bonuses of the first ranks, the lexical weight behind a full match.
RRF_K, BONUS, FULL_MATCH_WEIGHT = 60, {1: 0.05, 2: 0.02, 3: 0.02}, 2.0


def contribution(rank: Column, weight: Column) -> Column:
    """What a place (from 1) in a list is worth."""
    bonus = F.lit(0.0)
    for place, extra in BONUS.items():
        bonus = F.when(rank == place, extra).otherwise(bonus)
    return weight / (RRF_K + rank) + bonus


def lexical_weights(lexical: DataFrame) -> DataFrame:
    """qid, weight: full weight where the lexical list is led by a document with the whole phrase or all terms."""
    return lexical.where("rank = 1").select("qid", F.when(F.col("tier").isin("phrase", "and"), FULL_MATCH_WEIGHT).otherwise(1.0).alias("weight"))


def fuse(lists: DataFrame, limit: int | Column | None = 10, queries: DataFrame | None = None) -> DataFrame:
    """qid, doc_id, rank, score, sources from rows (qid, source, doc_id, rank, score, weight) of any number of lists.

    score: summed contributions; sources: map of each list's own score. One aggregation; no list is joined with another.
    """
    fused = lists.groupBy("qid", "doc_id").agg(
        F.sum(contribution(F.col("rank"), F.col("weight"))).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", F.col("score").alias("s"))))).alias("sources")
    )
    out = fused.withColumn("rank", F.row_number().over(ranked("score", "qid")))
    if isinstance(limit, Column):
        out = out.join(queries.select("qid", limit.alias("_limit")), "qid").where(F.col("rank") <= F.col("_limit")).drop("_limit")
    elif limit is not None:
        out = out.where(F.col("rank") <= limit)
    return out.select("qid", "doc_id", "rank", "score", "sources")


def hybrid(lexical: DataFrame, vector: DataFrame, limit: int | Column | None = 10, queries: DataFrame | None = None) -> DataFrame:
    """Fusion of a lexical list (qid, doc_id, rank, score, tier) and a vector list (qid, doc_id, rank, score)."""
    lex = lexical.join(lexical_weights(lexical), "qid").select("qid", F.lit("lexical").alias("source"), "doc_id", "rank", "score", "weight")
    vec = vector.select("qid", F.lit("vector").alias("source"), "doc_id", "rank", "score", F.lit(1.0).alias("weight"))
    return fuse(lex.unionByName(vec), limit, queries)
