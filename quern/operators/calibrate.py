"""Calibration of a truncation floor from the corpus itself: its own documents as answers, made-up words as questions without one."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a pseudo-query, how many of them are left out, list length looked at, report's floors, least changes.
N_WORDS, DROPOUT, DEPTH = 6, 2, 15
CURVE = [round(0.01 * i, 2) for i in range(1, 16)]
LEAST_CHANGES = 100
WORD = r"[A-Za-z][A-Za-z']{3,}"
CONSONANTS, VOWELS = "bcdfghjklmnpqrstvwxz", "aeiou"


def sample_documents(docs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n documents by the order of md5(seed:doc_id): the same ones in every run. A top-n, not a full sort."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    return docs.withColumn("_key", key).orderBy("_key", "doc_id").limit(n).drop("_key")


def pseudo_queries(docs: DataFrame, seed: int = 0, n_words: int = N_WORDS, dropout: int = DROPOUT) -> DataFrame:
    """qid, doc_id, query: n_words words of each body picked by md5, all but `dropout` of them; bodies with fewer words give none."""
    words = F.regexp_extract_all(F.col("body"), F.lit(WORD), F.lit(0))
    order = F.transform(words, lambda w, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), i.cast("string"))).alias("h"), i.alias("i"), w.alias("w")))
    picked = F.transform(F.slice(F.sort_array(order), 1, max(1, n_words - dropout)), lambda x: x["w"])
    return docs.where(F.size(words) >= n_words).select(F.concat(F.lit("pos-"), F.col("doc_id").cast("string")).alias("qid"), "doc_id", F.array_join(picked, " ").alias("query"))


def gibberish(n: int, seed: int = 0, words: int = 4) -> list[tuple[str, str]]:
    """(qid, query): pronounceable words of five to eight letters that no document holds."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(VOWELS if i % 2 else CONSONANTS) for i in range(rng.randint(5, 8)))
    return [(f"neg-{i}", " ".join(word() for _ in range(words))) for i in range(n)]


def observations(positives: DataFrame, negatives: DataFrame, results: DataFrame) -> DataFrame:
    """kind, score: of each pseudo-query whose document came back, that document's score; of each made-up query, the top score or 0."""
    pos = positives.select("qid", "doc_id").join(results.select("qid", "doc_id", "score"), ["qid", "doc_id"]).select(F.lit("pos").alias("kind"), "score")
    top = results.where("rank = 1").select("qid", "score")
    neg = negatives.select("qid").join(top, "qid", "left").select(F.lit("neg").alias("kind"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return pos.unionByName(neg)


def candidates(obs: DataFrame) -> DataFrame:
    """t: every score seen, and one a hair above the highest negative."""
    above = obs.where("kind = 'neg'").agg((F.max("score") + 1e-4).alias("t")).where("t is not null")
    return obs.select(F.col("score").alias("t")).unionByName(above).distinct()


def split_curve(obs: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """t, kept_pos, kept_neg: shares of both kinds at or above each candidate. Counts come from one running window over the
    scores, so the number of rows is that of the scores and candidates, not their product."""
    floors = candidates(obs) if floors is None else floors
    rows = obs.select(F.col("score").alias("t"), (F.col("kind") == "pos").cast("int").alias("p"), (F.col("kind") == "neg").cast("int").alias("n"), F.lit(0).alias("is_floor"))
    rows = rows.unionByName(floors.select("t", F.lit(0).alias("p"), F.lit(0).alias("n"), F.lit(1).alias("is_floor")))
    # at or above: all peers of a value are inside a range frame
    up = Window.orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    share = lambda c: F.coalesce(F.sum(c).over(up) / F.nullif(F.sum(c).over(every), F.lit(0)), F.lit(0.0))
    return rows.withColumn("kept_pos", share("p")).withColumn("kept_neg", share("n")).where("is_floor = 1").select("t", "kept_pos", "kept_neg")


def best_floor(curve: DataFrame) -> DataFrame:
    """floor, j: the candidate that keeps most positives less negatives; the lowest of equals."""
    j = F.round(F.col("kept_pos") - F.col("kept_neg"), 12)
    return curve.agg(F.max(F.struct(j.alias("j"), (-F.col("t")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("floor"), F.col("b.j").alias("j"))


def lower_quantile(values: Column, q: float) -> Column:
    """Of an array: the value at floor(q * n) in order, within bounds; null for an empty one."""
    at = F.least(F.floor(F.lit(q) * F.size(values)), F.size(values) - 1).cast("int")
    return F.get(F.sort_array(values), F.greatest(at, F.lit(0)))


def report(obs: DataFrame, target: float = 0.85, reject: float = 0.9) -> DataFrame:
    """One row: floor and what it keeps and rejects, the floors of both targets, quantiles, separation, collisions, retention curve.

    Observations number in the hundreds (the samples asked for), so they are gathered into one row. Without positives: floor 0.
    """
    floors = best_floor(split_curve(obs))
    reach = split_curve(obs).where(1 - F.col("kept_neg") >= reject).agg(F.min("t").alias("floor_reject"))
    sides = obs.agg(F.collect_list(F.when(F.col("kind") == "pos", F.col("score"))).alias("pos"), F.collect_list(F.when(F.col("kind") == "neg", F.col("score"))).alias("neg"))
    rows = sides.crossJoin(floors).crossJoin(reach)
    share = lambda a, t: F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.filter(a, lambda s: s >= t)) / F.size(a))
    pos, neg, floor = F.col("pos"), F.col("neg"), F.when(F.size("pos") == 0, 0.0).otherwise(F.col("floor"))
    q = lambda a, p: F.coalesce(lower_quantile(a, p), F.lit(0.0))
    r4 = lambda c: F.bround(c, 4)
    return rows.select(
        r4(floor).alias("floor"), r4(q(pos, 1 - target)).alias("floor_retention"), r4(F.coalesce("floor_reject", floor)).alias("floor_reject"),
        F.size(pos).cast("long").alias("n_pos"), F.size(neg).cast("long").alias("n_neg"),
        r4(q(pos, 0.05)).alias("pos_p5"), r4(q(pos, 0.5)).alias("pos_median"), r4(q(neg, 0.5)).alias("neg_p50"), r4(q(neg, 0.9)).alias("neg_p90"), r4(F.coalesce(F.array_max(neg), F.lit(0.0))).alias("neg_max"),
        r4(q(pos, 0.25) - q(neg, 0.9)).alias("separation"),
        F.bround(share(pos, F.lit(0.0)) - share(pos, q(neg, 0.9) + 1e-9), 3).alias("pos_collides_with_noise"),
        F.bround(share(pos, floor), 3).alias("pos_retained_at_floor"), F.bround(1 - share(neg, floor), 3).alias("neg_rejected_at_floor"),
        F.transform(F.array(*map(F.lit, CURVE)), lambda t: F.struct(t.alias("floor"), F.bround(share(pos, t), 3).alias("kept"))).alias("curve"),
    )


def change_threshold(n_documents: Column, fraction: float = 0.1) -> Column:
    return F.greatest(F.lit(LEAST_CHANGES), F.floor(F.lit(fraction) * n_documents)).cast("long")


def due(have_floor: Column, pending: Column, n_documents: Column, fraction: float = 0.1) -> Column:
    """Whether to calibrate again: without a floor, or when enough documents have changed."""
    return ~have_floor | (pending >= change_threshold(n_documents, fraction))
