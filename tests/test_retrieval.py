import math
import sqlite3

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import fusion
from quern.operators import lexical as L
from quern.operators import vector as V
from quern.sources import store

DOCS = [
    (1, "Cats and dogs", "The cat chased the dog. The dog ran to the house.", "pets/a.md"), (2, "Houses", "A house with a red door and a red roof", "home/b.md"), (3, "", "cat cat cat house don't panic", "misc/cat.md"),
    (4, "Red dog", "The red dog; the café's dog sleeps", "pets/d.md"), (5, "Nothing", "zebra", "z.md"), (6, "The cat house", "", "pets/e.md"),
]
QUERIES = ["cat house", '"red dog"', "dog red", "the dog ran", "don't", '"red door" cat', "cafe", "missing words here", "the the cat", "!!!", "pets"]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, title string, body string, relpath string").withColumn("collection", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")).withColumn("active", F.lit(True))


def queries(spark, texts=QUERIES):
    return spark.createDataFrame([(i, q, []) for i, q in enumerate(texts)], "qid int, query string, collections array<string>")


def library():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(title, body, relpath, tokenize='unicode61')")
    db.executemany("insert into t(rowid, title, body, relpath) values (?, ?, ?, ?)", DOCS)
    return db


def tiers(db, query, limit=50):
    """Phrase, then all terms, then any term, each by the library's own rank."""
    import re

    token = re.compile(r"[\w']+")
    parts = [" ".join(token.findall(p)) for p in re.findall(r'"([^"]+)"', query)] + token.findall(re.sub(r'"[^"]+"', " ", query))
    parts = [f'"{p}"' for p in parts if p]
    if not parts:
        return []
    steps = [("and", " ".join(parts)), ("or", " OR ".join(parts))]
    if '"' not in query and len(token.findall(query)) > 1:
        steps.insert(0, ("phrase", '"' + " ".join(token.findall(query)) + '"'))
    out = {}
    for tier, expr in steps:
        rows = [(d, -s) for d, s in db.execute("select rowid, bm25(t, 4.0, 1.0, 2.0) from t where t match ?", (expr,))]
        for d, s in sorted(rows, key=lambda x: (-round(x[1] / (1 + x[1]), 9), x[0])):
            out.setdefault(d, (tier, s / (1 + s) if s > 0 else 0.0))
    return [(d, *x) for d, x in out.items()][:limit]


def test_tiers_and_scores_are_the_librarys(spark):
    index = L.build_index(docs(spark), ["title", "body", "relpath"])
    got = {}
    for r in L.search_lexical(index, queries(spark), docs(spark)).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.doc_id, r.tier, r.score))
    db = library()
    for i, q in enumerate(QUERIES):
        want = tiers(db, q)
        assert [(d, t) for d, t, _ in got.get(i, [])] == [(d, t) for d, t, _ in want], q
        assert [s for *_, s in got.get(i, [])] == pytest.approx([s for *_, s in want], abs=1e-12), q


def test_porter_index(spark):
    index = L.build_index(docs(spark), ["title", "body", "relpath"], porter=True)
    got = {r.doc_id for r in L.search_lexical(index, queries(spark, ["chasing cats"])).where("tier <> 'or'").collect()}
    assert got == {1}


def test_scope_and_limits(spark):
    index = L.build_index(docs(spark), ["title", "body", "relpath"])
    q = queries(spark, ["dog house", "dog house"]).withColumn("collections", F.when(F.col("qid") == 1, F.array(F.lit("even"))).otherwise(F.array().cast("array<string>")))
    rows = L.search_lexical(index, q, docs(spark)).collect()
    assert {r.doc_id for r in rows if r.qid == 1} == {2, 4, 6} and {r.doc_id for r in rows if r.qid == 0} == {1, 2, 3, 4, 6}
    scores = {(r.qid, r.doc_id): r.score for r in rows}
    assert scores[0, 2] == scores[1, 2]  # statistics are those of the whole index
    capped = L.search_lexical(index, q.withColumn("n", F.col("qid") + 1), docs(spark), F.col("n")).groupBy("qid").count().collect()
    assert {r["qid"]: r["count"] for r in capped} == {0: 1, 1: 2}


def test_snippets(spark):
    body = " ".join(f"w{i}" for i in range(100))
    d = spark.createDataFrame([(1, body), (2, "w50 only"), (3, "")], "doc_id long, body string")
    hits = spark.createDataFrame([("q", 1), ("q", 2), ("q", 3), ("r", 1)], "qid string, doc_id long")
    q = spark.createDataFrame([("q", "w50"), ("r", "w0")], "qid string, query string")
    got = {(r.qid, r.doc_id): r.snippet for r in L.match_snippets(hits, d, q).collect()}
    assert got["q", 1].startswith("…") and got["q", 1].endswith("…") and "w50" in got["q", 1] and len(got["q", 1].split()) == 16
    assert got["q", 2] == "w50 only" and got["q", 3] == "" and got["r", 1].startswith("w0 w1")


def test_no_documents(spark):
    index = L.build_index(docs(spark).limit(0), ["title", "body", "relpath"])
    assert L.search_lexical(index, queries(spark)).count() == 0


def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    x[7] = x[3]
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [0.0] * 8), (901, None), (902, [1.0])], "chunk_id long, embedding array<float>")


def nearest(x, q, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ (q.astype(float) / np.linalg.norm(q.astype(float))), 9)
    return np.lexsort((np.arange(len(s)), -s))[:k].tolist()


def test_nearest_neighbours(spark):
    x, v = vectors(spark)
    q = v.where("chunk_id < 12").withColumnRenamed("chunk_id", "qid")
    got = {}
    for r in V.knn(v.repartition(5), q, 6).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    assert got == {i: nearest(x, x[i], 6) for i in range(12)}
    assert V.knn(v, q.limit(0), 6).count() == 0


@pytest.mark.parametrize("k, cells", [(5, None), (200, None), (6, 1), (6, 150)])
def test_cells_find_all_neighbours(spark, tmp_path, k, cells):
    x, v = vectors(spark)
    q = v.where("chunk_id < 40 or chunk_id >= 900").withColumnRenamed("chunk_id", "qid")
    index = V.build_cells(v, cells)
    store.write_cells(index, str(tmp_path / "cells"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    exact = rows(V.knn(v, q, k))
    assert rows(V.knn_cells(store.read_cells(spark, str(tmp_path / "cells")), q, k)) == exact and len(exact) == 40 * k


def test_cells_find_the_whole_top_ten(spark):
    """All of the true ten, however low their cosine, on the given vectors; and no query comes back short."""
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id as chunk_id", "embedding")
    q = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "qid")
    exact, found = ({(r.qid, r.chunk_id, r["rank"]) for r in f(x, q, 10).collect()} for f, x in ((V.knn, v), (V.knn_cells, V.build_cells(v))))
    assert found == exact and len(found) == 250


def test_cells_skip_what_cannot_reach_the_floor():
    """Two tight clusters: queries of one never multiply with the other's vectors."""
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    rng = np.random.default_rng(0)
    x = unit(np.concatenate([np.eye(4)[0] + 0.01 * rng.normal(size=(20, 4)), np.eye(4)[1] + 0.01 * rng.normal(size=(20, 4))]))
    reach = np.array([[1.0, 0.1]])
    shared = type("Shared", (), {"value": ([7], x[:1], np.array([0.9]), reach)})
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(x.tolist()), pa.array([0] * 20 + [1] * 20, pa.int32())], ["chunk_id", "embedding", "cell"])
    found = [i for b in V._nearest(shared, 30, pa.int64())([batch]) for i in b.column(1).to_pylist()]
    assert sorted(found) == list(range(20))


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [0.0, 0.0])]])
def test_cells_of_nothing(spark, rows):
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<float>")
    assert V.knn_cells(V.build_cells(v), q, 3).count() == 0


def test_documents_by_best_chunk_and_scope(spark):
    x, v = vectors(spark)
    chunks = spark.createDataFrame([(i, i // 4, i % 4, 0, 10) for i in range(200)], "chunk_id long, doc_id long, seq int, pos int, length int")
    d = spark.createDataFrame([(i, "a" if i % 5 else "b", "body", True) for i in range(50)], "doc_id long, collection string, body string, active boolean")
    q = spark.createDataFrame([(0, [float(t) for t in x[0]], []), (1, [float(t) for t in x[0]], ["b"])], "qid int, embedding array<float>, collections array<string>")
    rows = V.search_vector(v, chunks, d, q, 10).orderBy("rank").collect()
    order = list(dict.fromkeys(i // 4 for i in nearest(x, x[0], 200)))
    assert [r.doc_id for r in rows if r.qid == 0] == order[:10]
    assert [r.doc_id for r in rows if r.qid == 1] == [o for o in order if o % 5 == 0][:10]
    short = V.search_vector(v, chunks, d, q, 10, fetch=20).where("qid = 1")
    full = V.search_vector(v, chunks, d, q, 10, fetch=20, prefilter=True).where("qid = 1")
    assert short.count() < full.count() == 10


def test_fusion(spark):
    rows = [("lexical", 1, 1, 0.9, 1.0), ("lexical", 2, 2, 0.8, 1.0), ("lexical", 3, 3, 0.7, 1.0), ("vector", 2, 1, 0.6, 1.0), ("vector", 4, 2, 0.5, 1.0)]
    lists = spark.createDataFrame([("q", *r) for r in rows], "qid string, source string, doc_id long, rank int, score double, weight double")
    out = fusion.fuse(lists).orderBy("rank").collect()
    assert out[0].doc_id == 2 and out[0].sources == {"lexical": 0.8, "vector": 0.6}
    assert math.isclose(out[0].score, 1 / 62 + 0.02 + 1 / 61 + 0.05) and len(out) == 4
    many = spark.createDataFrame([("q", "lexical", i, i + 1, 1.0 - i / 50, 1.0) for i in range(20)], lists.schema)
    assert fusion.fuse(many, 5).count() == 5


def test_full_matches_outvote_vectors(spark):
    lex = spark.createDataFrame([("a", 1, 1, 0.5, "and"), ("b", 1, 1, 0.5, "or")], "qid string, doc_id long, rank int, score double, tier string")
    vec = spark.createDataFrame([("a", 2, 1, 0.9), ("b", 2, 1, 0.9)], "qid string, doc_id long, rank int, score double")
    top = {r.qid: (r.doc_id, r.score) for r in fusion.hybrid(lex, vec).where("rank = 1").collect()}
    assert top["a"][0] == 1 and math.isclose(top["a"][1], 2 / 61 + 0.05) and math.isclose(top["b"][1], 1 / 61 + 0.05)
