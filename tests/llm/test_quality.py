import re
from math import exp, log

from quern.llm import quality as Q
from tests.llm import cases

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    inside = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
    n, rep = len(words), len(inside)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def em(patterns, rounds=25):
    """The same model by loops over {votes: count}."""
    k = len(next(iter(patterns)))
    total = sum(patterns.values())
    strength = max(2.0, 0.01 * total)
    prior, g, b = Q.PRIOR, [Q.GOOD_SMOOTH] * k, [Q.BAD_SMOOTH] * k
    post = lambda v: 1 / (1 + exp(-(log(prior / (1 - prior)) + sum(0 if x == -1 else log(g[i] / b[i]) if x else log((1 - g[i]) / (1 - b[i])) for i, x in enumerate(v)))))
    for _ in range(rounds):
        q = {v: n * post(v) for v, n in patterns.items()}
        share = lambda i, w, s: (sum(w[v] for v in w if v[i] == 1) + strength * s) / (sum(w[v] for v in w if v[i] != -1) + strength)  # noqa: E731, B023
        rest = {v: patterns[v] - q[v] for v in patterns}
        prior, g, b = (sum(q.values()) + strength * Q.PRIOR) / (total + strength), [share(i, q, Q.GOOD_SMOOTH) for i in range(k)], [share(i, rest, Q.BAD_SMOOTH) for i in range(k)]
    return prior, g, b, {v: post(v) for v in patterns}


def test_counts_and_edge_rows(spark):
    docs = cases.documents(spark)
    got = cases.same_with_clashes(Q.quality_rules, docs, "doc_id", *Q.FEATURES, "base_failed")
    want = sorted([(r[0], b[0], b[1], b[2], b[3], b[4], b[5]) for r in cases.ROWS for b in [base(r[1])]], key=repr)
    assert got == want


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = Q.quality_rules(docs).collect()
    assert len(out) == len(texts)
    names = list(Q.votes())
    patterns = {}
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        v = tuple(r[f"v_{n}"] for n in names)
        patterns[v] = patterns.get(v, 0) + 1
    posterior = em(patterns)[3]
    for r in out:
        p = posterior[tuple(r[f"v_{n}"] for n in names)]
        assert abs(r.quality - p) < 1e-9
        assert r.kept == (not r.base_failed and p >= 0.5)


def test_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in Q.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == bool(labels[r.doc_id]) for r in out) >= 0.98 * len(out)


def test_keep_good_is_the_same_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = cases.rows(Q.quality_rules(docs).where("kept"), "doc_id")
    assert cases.rows(Q.keep_good(docs), "doc_id") == kept
    assert Q.keep_good(cases.crowded(docs)).columns == cases.crowded(docs).columns


def test_no_rows(spark):
    assert Q.quality_rules(cases.documents(spark, [])).count() == 0
    assert Q.keep_good(cases.documents(spark, [])).count() == 0
