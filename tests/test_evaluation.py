import math

import pytest
from pyspark.sql import functions as F

from quern.operators import calibrate as C
from quern.operators import envelope as N
from quern.operators import evaluate as E
from quern.operators import querygen as G
from tests.small import ranked


def one(df):
    return df.first().asDict()


def test_hit_ranks_and_recall(spark):
    rows = [("a", "x", "d.txt", ["c/e.txt", "c/d.txt"]), ("b", "x", "d.txt", ["xd.txt"]), ("c", "y", "d.txt", ["d.txt"]), ("d", "y", "d.txt", [])]
    hits = E.hit_ranks(spark.createDataFrame(rows, "qid string, type string, expected string, paths array<string>"), "type")
    assert {r.qid: r.hit for r in hits.collect()} == {"a": 1, "b": None, "c": 0, "d": None}
    got = {r["type"]: (r.n, r.recall_1, r.recall_3, r.recall_10) for r in E.recall_by_type(hits).collect()}
    assert got == {"x": (2, 0.0, 0.5, 0.5), "y": (2, 0.5, 0.5, 0.5), "all": (4, 0.25, 0.5, 0.5)}


@pytest.mark.parametrize("n", [1, 2, 4, 5, 101])
def test_percentiles(spark, n):
    values = [float((i * 37) % n) for i in range(n)]
    got = one(E.latency(spark.createDataFrame([(v,) for v in values], "ms double")))
    at = lambda p: sorted(values)[min(n - 1, max(0, round(p / 100 * (n - 1))))]
    assert (got["p50"], got["p99"]) == (round(at(50), 1), round(at(99), 1))


def test_purity_has_both_noise_rates(spark):
    lists = spark.createDataFrame([("a",), ("b",), ("c",)], "qid string")
    labelled = spark.createDataFrame([("a", "noise", False), ("a", "relevant", True), ("a", "related", False), ("a", "odd", False), ("b", "relevant", False)], "qid string, label string, is_hit boolean")
    rows = E.per_query(lists, labelled.withColumn("label", F.when(F.col("label") == "odd", "unjudged").otherwise(F.col("label"))), "qid")
    got = one(E.purity(rows))
    assert got["queries"] == 3 and got["results"] == 5 and got["unjudged"] == 1
    assert math.isclose(got["noise_micro"], 1 / 5) and math.isclose(got["noise_macro"], (1 / 4 + 0) / 2) and math.isclose(got["clean"], 2 / 3)
    assert math.isclose(got["nonempty_clean"], 1 / 2) and math.isclose(got["strict_clean"], 1 / 3) and math.isclose(got["abstained"], 1 / 3) and math.isclose(got["recall"], 1 / 3)
    none = one(E.nomatch_report(rows))
    assert none["returned"] == 2 and none["false_positives"] == 2 and math.isclose(none["noise"], 1 / 8)


def test_sweep(spark):
    lists = ranked(spark, [1.0, 0.9, 0.1, 0.05]).withColumn("path", F.concat(F.lit("p"), F.col("doc_id").cast("string"))).withColumn("expected", F.lit("p1"))
    judged = spark.createDataFrame([("q", "p0", "relevant"), ("q", "p2", "noise")], "qid string, path string, label string")
    got = {r.spec: r for r in E.sweep(lists, judged, ["off", "knee", "abs:2"]).collect()}
    assert got["off"].noise_macro == 0.5 and got["off"].clean == 0 and got["off"].uncovered == 2 and got["off"].recall == 1
    assert got["knee"].noise_macro == 0 and got["knee"].clean == 1 and got["knee"].avg_len == 2
    assert got["abs:2"].abstained == 1 and got["abs:2"].recall == 0 and got["abs:2"].avg_len == 0


def test_paths_back_to_files(spark):
    files = spark.createDataFrame([("alt.atheism/1.txt",), ("1.txt",), ("deep/a.b/c.py",)], "relpath string")
    shown = spark.createDataFrame([("coll/alt.atheism/1.txt",), ("x/alt-atheism/1.txt",), ("q/1.txt",), ("z/deep/a-b/c.py",), ("none",)], "path string")
    got = {r.path: r.real for r in E.real_paths(shown, files).collect()}
    assert got == {"coll/alt.atheism/1.txt": "alt.atheism/1.txt", "x/alt-atheism/1.txt": "1.txt", "q/1.txt": "1.txt", "z/deep/a-b/c.py": "deep/a.b/c.py", "none": None}


def test_ceiling_and_first_distinct(spark):
    q = spark.createDataFrame([("a", "x.py"), ("b", "d/y.py"), ("c", "z.py")], "qid string, expected string")
    got = one(E.ceiling(q, spark.createDataFrame([("s/x.py",), ("d/y.py",), ("xz.py",)], "path string")))
    assert got == {"n": 3, "reachable": 2, "ceiling": 0.6667}
    r = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a"), ("q", 3, None), ("q", 4, "b"), ("q", 5, "c")], "qid string, rank int, path string")
    assert [(x.path, x.place) for x in E.first_distinct(r, 2).orderBy("place").collect()] == [("a", 1), ("b", 2)]


def test_pools(spark):
    pools = E.pool(spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "p")], "qid string, path string"), spark.createDataFrame([("a", "t"), ("b", "p")], "qid string, expected string"))
    assert {r.qid: r.pool for r in pools.collect()} == {"a": ["p", "q", "t"], "b": ["p"]}
    assert [r.qid for r in E.to_judge(pools, spark.createDataFrame([("a", "p"), ("b", "p")], "qid string, path string")).collect()] == ["a"]


def test_overlap(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"], ["a", "c", "x"]), ([], ["a"])], "q array<string>, b array<string>")
    assert [round(r[0], 6) for r in df.select(E.overlap(F.col("q"), F.col("b"))).collect()] == [0.666667, 0.0]


def test_source_mix_profile_and_counters(spark):
    s = [{"lexical": 1.0, "vector": 1.0}, {"lexical": 1.0}, {"vector": 1.0}, {}]
    lists = ranked(spark, [1.0, 0.9, 0.1, 0.05], s)
    mix = one(N.confidence(N.source_mix(lists, "hybrid")))
    assert mix == {"qid": "q", "n": 4, "both": 1, "lexical_only": 1, "vector_only": 1, "other": 1, "confidence": "strong"}
    assert one(N.source_mix(lists, "vector"))["vector_only"] == 2
    assert one(N.score_profile(lists)) == {"qid": "q", "n": 4, "top_score": 1.0, "tail_score": 0.05, "spread": 0.95, "flat": False, "has_knee": True}
    rising = one(N.score_profile(ranked(spark, [0.1, 0.2, 0.3, 0.4])))
    assert rising["flat"] and not rising["has_knee"] and rising["spread"] == -0.3
    counted = N.filter_counters(spark.createDataFrame([("q",), ("r",)], "qid string"), lists, lists.limit(3), lists.limit(1)).orderBy("qid").collect()
    assert tuple(counted[0]) == ("q", 4, 3, 1, 1, 2) and tuple(counted[1]) == ("r", 0, 0, 0, 0, 0)


def observations(spark, pos, neg):
    return spark.createDataFrame([("pos", float(s)) for s in pos] + [("neg", float(s)) for s in neg], "kind string, score double")


@pytest.mark.parametrize(("pos", "neg"), [([0.5, 0.6, 0.7, 0.2], [0.1, 0.1, 0.3]), ([0.1, 0.2], [0.3, 0.3]), ([0.4], [0.0]), ([0.2, 0.2], [0.2, 0.2])])
def test_floor_splits_best(spark, pos, neg):
    ge = lambda xs, t: sum(x >= t for x in xs) / len(xs)
    cands = sorted({*pos, *neg, max(neg) + 1e-4})
    want = max(cands, key=lambda t: (round(ge(pos, t) - ge(neg, t), 12), -t))
    obs = observations(spark, pos, neg)
    assert math.isclose(C.best_floor(C.split_curve(obs)).first().floor, want)
    r = C.report(obs).first()
    assert r.floor == round(want, 4) and r.n_pos == len(pos) and r.n_neg == len(neg) and r.pos_retained_at_floor == round(ge(pos, want), 3)
    assert r.floor_retention == round(sorted(pos)[max(0, min(len(pos) - 1, math.floor(0.15 * len(pos) + 1e-12)))], 4)
    assert [c.kept for c in r.curve] == [round(ge(pos, t), 3) for t in C.CURVE]


def test_report_without_positives(spark):
    r = C.report(observations(spark, [], [0.1])).first()
    assert r.floor == 0.0 and r.n_pos == 0


def test_pseudo_queries_are_reproducible(spark):
    d = spark.createDataFrame([(i, " ".join(f"word{chr(97 + (i + k) % 26)}x" for k in range(30))) for i in range(50)] + [(99, "too few words")], "doc_id long, body string")
    a, b = (sorted((r.qid, r.query) for r in C.pseudo_queries(C.sample_documents(x, 20, 3), 3).collect()) for x in (d, d.repartition(7)))
    assert a == b and all(len(q.split()) == 4 for _, q in a) and len(a) in (19, 20)
    assert C.gibberish(5, 1) == C.gibberish(5, 1) and all(len(q.split()) == 4 for _, q in C.gibberish(5, 1))


def test_recalibration_gate(spark):
    rows = spark.createDataFrame([(True, 99, 500), (True, 100, 500), (True, 999, 10_000), (True, 1000, 10_000), (False, 0, 10)], "have boolean, pending long, n long")
    assert [r[0] for r in rows.select(C.due(F.col("have"), F.col("pending"), F.col("n"))).collect()] == [False, True, False, True, True]


def test_query_set(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("relpath"), F.col("text").alias("body"))
    rows = G.query_set(d, 60).collect()
    assert len(rows) == 60 and {t: sum(r["type"] == t for r in rows) for t in G.KINDS} == {"unique": 20, "phrase": 20, "vague": 20}
    text = {r.relpath: r.body for r in d.collect()}
    for r in rows:
        body = text[r.expected]
        if r["type"] == "phrase":
            assert r.query in " ".join(body.split()) and 6 <= len(r.query.split()) <= 9
        else:
            assert all(w in body.lower() for w in r.query.split())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, G.query_set(d.repartition(9), 60).collect()))


def test_chats_and_styles(spark):
    c = spark.createDataFrame([(1, 0, "user", " hi "), (1, 1, "assistant", "ho"), (2, 0, "user", "alone"), (3, 0, "user", None), (3, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r.text.split("\n") for r in G.render_chats(c).collect()}
    assert rows.keys() == {1} and rows[1][1].endswith(" - User: hi") and rows[1][2].endswith(" - Assistant: ho")
    import re

    assert re.match(r"^\d{2}/\d{2}/\d{4}, \d{2}:\d{2} - ", rows[1][1])
    words = [r.word for r in G.made_up_words(spark, 6).collect()]
    bodies = spark.createDataFrame([(f"a text with {words[0]} and {words[3].upper()}.",), (None,)], "body string")
    asked = G.nomatch_queries(bodies, 7).collect()
    assert [r.qid for r in sorted(asked)] == [f"nomatch-{i:04d}" for i in range(7)] and all("{" not in r.query for r in asked)
    used = " ".join(r.query for r in asked).split()
    assert words[0] not in used and words[3] not in used and {words[1], words[2], words[4], words[5]} <= set(used)
    import hashlib

    kinds = spark.createDataFrame([(f"q{i}",) for i in range(20)], "qid string").select("qid", G.noise_kind(F.col("qid")).alias("k")).collect()
    assert all(r.k == int(hashlib.sha1(r.qid.encode()).hexdigest(), 16) % 4 for r in kinds)


def test_registry_has_sql_with_the_same_columns(spark):
    import duckdb

    from quern.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert set(Q.SQL) <= set(Q.QUERIES) and len(Q.QUERIES) > 60
    for name in ("title_extract", "chunk_offsets", "lexical_tiered", "trunc_knee", "sync_diff", "gen_phrase"):
        rel = db.sql(Q.SQL[name])
        got = Q.QUERIES[name](spark, sf)
        assert sorted(got.columns) == sorted(rel.columns)
        order = sorted(got.columns)
        a = sorted(repr(tuple(r[c] for c in order)) for r in got.collect())
        b = sorted(repr(x) for x in rel.project(", ".join(f'"{c}"' for c in order)).fetchall())
        assert a == b, name


def test_document_frequency_reads_whole_texts(spark):
    d = spark.createDataFrame([(1, "common " * 30_000 + "lastword"), (2, "common lastword")], "doc_id long, body string")
    assert {r.word: r.df for r in G.document_frequency(d).collect()} == {"common": 2, "lastword": 2}


def test_common_words_leave_before_words_are_joined(spark):
    """A word of every document is dropped where it is read; rare words and their counts stay."""
    d = spark.range(120).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("everywhere"), F.concat(F.lit("half"), F.col("id") % 2), F.concat(F.lit("single"), F.col("id"))).alias("body"))
    df = G.document_frequency(d, G.READ_CHARS)
    rows = G._words(d, df, 7, 60)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and plan.index("SortMergeJoin" if "SortMergeJoin" in plan else "Join") < plan.index("LeftAnti")
    got = sorted((r.doc_id, r.word, r.df) for r in rows.collect())
    assert got == sorted([(i, f"half{i % 2}", 60) for i in range(120)] + [(i, f"single{i}", 1) for i in range(120)])
    assert {r.doc_id for r in G.unique_queries(d, df).collect()} == set(range(120))


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_generated_queries_are_those_of_sql(spark, monkeypatch, limit):
    """With common words broadcast, and with too many for that."""
    import duckdb

    from quern.plans import queries as Q

    monkeypatch.setattr(G, "COMMON_WORDS", limit)
    db = duckdb.connect()
    db.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    for name in ("gen_unique", "gen_vague"):
        got = sorted((r.doc_id, r.query) for r in Q.QUERIES[name](spark, "/root/testdata/sf0.001").collect())
        assert got == sorted(db.sql(f"select doc_id, query from ({Q.SQL[name]})").fetchall()) and got
