import numpy as np

from quern.llm import language as G
from tests.llm import cases


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in G.language_id(docs).collect()}
    held = [(out[r.doc_id].lang_pred, r.lang) for r in docs.collect() if out[r.doc_id].held_out]
    assert len(held) > 150 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(r.held_out == (cases.crc_mod(d, 4) == 2) for d, r in out.items())
    assert all(0 <= r.score <= 1 for r in out.values())


def test_edge_rows(spark):
    got = cases.same_with_clashes(G.language_id, cases.documents(spark), "doc_id", "held_out", "lang_pred", "n_langs")
    by = {}
    for d, held, lang, n in got:
        by.setdefault(d, []).append((held, lang, n))
    assert all(x[1] == "und" for d in (2, 3, 7, 9) for x in by[d])
    assert len(by[5]) == 2 and len(by[None]) == 2
    assert {x[1] for v in by.values() for x in v} <= {"en", "fr", "und"}


def test_held_rows_teach_nothing(spark):
    rows = [(i, "aaa bbb ccc " * 5, "x", "s", 1) for i in range(40)] + [(i, "ddd eee fff " * 5, "y", "s", 1) for i in range(40, 200) if cases.crc_mod(i, 4) == 2]
    assert {r.lang_pred for r in G.language_id(cases.documents(spark, rows)).collect()} == {"x"}


def test_mixture_finds_both_languages():
    one, two = b"the cat and the dog ran over the hill " * 20, "le chat et le chien sur la colline ".encode() * 20
    counts = np.stack([np.bincount(G.buckets(x), minlength=G.BUCKETS) for x in (one, two)], axis=1).astype(float)
    p = (counts + 0.5) / (counts + 0.5).sum(axis=0)
    w, free, fit = G.infer(one[:300] + two[:300], p, np.log(p))
    assert (w > 0.3).all() and abs(w.sum() - 1) < 1e-9
    assert (free > 0.3).all() and fit > 0
    w, free, fit = G.infer(one[:100], p, np.log(p))
    assert list(w) == [1, 0] and 0.5 < free[0] <= 1 and fit > 0
    # trigrams that neither language has are explained worse than by noise
    assert G.infer(b"zqxj 8#vk" * 20, p, np.log(p))[2] < 0


def test_em_against_plain_loops():
    rng = np.random.default_rng(1)
    p, c = rng.dirichlet(np.ones(30), 3).T, rng.integers(1, 9, 30).astype(float)
    w = [1 / 3] * 3
    for _ in range(12):
        mix = [sum(w[k] * p[i, k] for k in range(3)) for i in range(30)]
        w = [sum(c[i] * w[k] * p[i, k] / mix[i] for i in range(30)) / c.sum() for k in range(3)]
    assert np.allclose(G.mixture(p, c)[0], w)


def told(rows):
    """ids of (doc_id, text, lang) whose letters are there and whose trigrams noise does not explain far better than the languages, by plain loops."""
    import re

    langs = sorted({r[2] for r in rows if r[2] is not None and r[1] is not None and cases.crc_mod(r[0], 4) != 2})
    counts = np.zeros((G.BUCKETS, len(langs)))
    for d, text, lang in rows:
        if lang is not None and text is not None and cases.crc_mod(d, 4) != 2:
            counts[:, langs.index(lang)] += np.bincount(G.buckets(text.lower().encode()), minlength=G.BUCKETS)
    p, out = (counts + 0.5) / (counts + 0.5).sum(axis=0), []
    for d, text, _ in rows:
        if langs and text and re.search(r"[^\W\d_]", text):
            x = G.buckets(text.lower().encode())
            w = np.full(len(langs), 1 / len(langs))
            for _ in range(12):
                w = (w * p[x] / (p[x] @ w)[:, None]).sum(axis=0) / len(x)
            if (np.log(p[x] @ w) + np.log(G.BUCKETS)).sum() > -5:
                out.append(d)
    return sorted(out, key=repr)


def test_stage_against_plain_loops(spark, sf):
    noise = [(10**6 + i, f"{i * 7919 % 99991:x} #{i * 104729 % 999983:o}!", "en", "a", 1) for i in range(9)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(cases.documents(spark, noise))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    kept = sorted((r.doc_id for r in G.keep_identified(docs).collect()), key=repr)
    assert kept == told(rows) and len(kept) >= 0.97 * (len(rows) - 9)


def test_scores_differ(spark, sf):
    got = [r.score for r in G.language_id(spark.read.parquet(f"{sf}/documents.parquet")).collect()]
    assert len(set(got)) > 50


def test_stage_and_no_rows(spark):
    docs = cases.crowded(cases.documents(spark))
    kept = G.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 5, 6, 8, 10]
    assert G.language_id(cases.documents(spark, [])).count() == 0
    assert G.keep_identified(cases.documents(spark, [])).count() == 0
