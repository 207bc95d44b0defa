"""Batches against documents that are read, not indexed: the same answers as from postings, and nothing but the best leaves a task."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import lexical as L
from quern.operators import scan
from tests.test_retrieval import docs, queries

FIELDS = ["title", "body", "relpath"]


def rows(df):
    return sorted((r.qid, r["rank"], r.doc_id, r.tier, round(r.score, 12)) for r in df.collect())


@pytest.mark.parametrize("porter", [False, True])
@pytest.mark.parametrize("scoped", [False, True])
def test_scan_postings_and_large_batches_agree(spark, monkeypatch, porter, scoped):
    """The scan, the postings of a stored index, and a batch too large for either."""
    d = docs(spark).withColumn("active", F.col("doc_id") != 4)
    index = L.build_index(d, FIELDS, porter=porter)
    q = queries(spark).withColumn("collections", F.when((F.col("qid") % 2 == 0) & F.lit(scoped), F.array(F.lit("even"))).otherwise(F.array().cast("array<string>"))).withColumn("n", F.col("qid") % 4 + 1)
    found = {}
    for name, x in {"scan": index, "same frame": index, "postings": replace(index, source=None)}.items():
        found[name] = rows(L.search_lexical(x, q, d if name == "same frame" else d.select("doc_id", "collection", "active"), F.col("n")))
    monkeypatch.setattr(L, "SMALL_BATCH", 0)
    found["large"] = rows(L.search_lexical(index, q, d, F.col("n")))
    assert found["scan"] == found["same frame"] == found["postings"] == found["large"] and len(found["scan"]) > 5


def test_a_scan_needs_no_postings(spark):
    """Answers of an index that is not stored build no postings."""
    index = replace(L.build_index(docs(spark), FIELDS), postings=None, lengths=None)
    assert L.search_lexical(index, queries(spark)).count() > 10


def test_phrases_of_a_scan_are_those_of_postings(spark):
    index = L.build_index(docs(spark), FIELDS)
    p = L.query_phrases(queries(spark, ["the the", "red dog", "cat cat house", "cat cat", '"the house" dog', "red", "don't panic"]))
    key = lambda x: sorted(map(tuple, L.phrase_frequencies(x, p).select("phrase", "field", "doc_id", "tf").collect()))
    got = key(index)
    assert got == key(replace(index, source=None)) and any(tf == 2 for *_, tf in got)


def test_only_the_best_leave_a_task(spark):
    """Every document matches every query; a task returns k rows a query, whatever it read."""
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common words"), F.expr("repeat('more ', cast(id % 7 as int))")).alias("body")).repartition(3)
    index, q = L.build_index(d, ["body"]), queries(spark, ["common more", "words more", "common words"])
    phrases = L.query_phrases(q)
    asked = scan.batch(phrases, L.phrase_key())
    bags, stats = L._bags(index, asked, {"body": 1.0})
    assert scan.best(bags, asked, {0: 5, 1: 5, 2: 5}, "tiers", None, stats).count() <= 3 * 3 * 5
    got = {i: [r.doc_id for r in L.top(index, q, phrases, 5).where(F.col("qid") == i).orderBy("rank").collect()] for i in range(3)}
    # three times "more" in five words, the average: 1 + 1.571 units; once: 1.184 + 1.184; six times in eight: 0.803 + 1.705
    assert got == {0: [3, 10, 17, 24, 31], 1: [1, 8, 15, 22, 29], 2: [0, 7, 14, 21, 28]}


def test_best_of_many_steps():
    """Against a full sort, with ties, over steps that bring no, few and many columns."""
    rng = np.random.default_rng(1)
    key = np.where(rng.random((4, 500)) < 0.3, -np.inf, np.round(rng.random((4, 500)), 2))
    key[3] = -np.inf
    best, docs_ = scan._Best(4, 7), rng.permutation(500)
    for low, high in ((0, 3), (3, 3), (3, 200), (200, 500)):
        best.add(key[:, low:high], key[:, low:high], docs_[low:high])
    for q in range(3):
        assert best.doc[q].tolist() == docs_[np.lexsort((docs_, -key[q]))[:7]].tolist()
    assert (best.key[3] == -np.inf).all()


def test_stems_and_long_phrases_in_a_batch():
    finder = scan._Finder([("cat",), ("the", "cat", "run"), ("run", "run")], porter=True)
    codes, n, lengths = finder.counts(pa.array([["the", "cats", "running", "runs"], [], None, ["run", "run", "run"], ["the", "cat"]]))
    assert [(int(c) // 3, int(c) % 3, int(k)) for c, k in zip(codes, n, strict=True)] == [(0, 0, 1), (0, 1, 1), (0, 2, 1), (3, 2, 2), (4, 0, 1)] and lengths.tolist() == [4, 0, 0, 3, 2]


def engine(d, index, **more):
    from quern.operators.vector import HashEmbedder
    from quern.plans.engine import Engine

    chunks = d.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(0).alias("seq"), F.lit(0).alias("pos"), F.length("body").alias("length"))
    embedder = HashEmbedder()
    return Engine(d, index, chunks, d.select(F.col("doc_id").alias("chunk_id"), embedder.documents(F.col("body")).alias("embedding")), embedder, **more)


def test_an_engine_ranks_and_calibrates_without_postings(spark):
    d = docs(spark)
    e = engine(d, replace(L.build_index(d, FIELDS), postings=None, lengths=None))
    found = e.rank(e.requests(queries(spark)))
    assert {r.doc_id for r in found.where("qid = 1 and rank <= 2").collect()} >= {4}
    assert e.calibrate(sample=5, negatives=3).first().n_neg == 3


def test_titles_of_other_documents_are_not_worked_out(spark):
    d = docs(spark).withColumn("hash", F.sha2("body", 256))
    index = L.build_index(d, ["body"])
    d = d.withColumn("title", F.when(F.col("doc_id") == 5, F.raise_error(F.lit("a title that nobody asked for")).cast("string")).otherwise(F.lit("title")))
    rows = engine(d, index).search(queries(spark, ["red dog"]).withColumn("mode", F.lit("lexical"))).collect()
    assert {r.doc_id for r in rows} == {1, 2, 4} and all(r.title == "title" for r in rows)
