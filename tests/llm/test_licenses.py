import re

import pytest

from quern.llm import licenses as S
from tests.llm import cases


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in S.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = ["Under the MIT License. under-the mit\nlicense; xunder the mit license", "CC BY-NC cc by nc 4", "apache license version 2.0, apache license version 20", "cc by nc by nc cc by nc", "Éunder the mit license", "under the mit licenseé", "Licensed under the Apache License, Version 2.0 (the \"License\")"]
ROWS = cases.ROWS + [(100 + i, t, "en", "a", 1) for i, t in enumerate(TEXTS)]
BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def test_base_columns(spark):
    got = cases.same_with_clashes(S.license_digest, cases.documents(spark, ROWS), *BASE)
    assert got == sorted([(r[0], *base(r[1])) for r in ROWS], key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert cases.rows(S.license_digest(docs), *BASE) == sorted([(r.doc_id, *base(r.text)) for r in docs.collect()], key=repr)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in S.license_digest(docs).collect())


def by_backtracking(nodes, words):
    """All accepted places of a nested template, by plain recursion: ('w', word), ('any', n), ('opt', nodes)."""

    def ends(i, k):
        if k == len(nodes):
            return {i}
        kind, x = nodes[k]
        if kind == "w":
            return ends(i + 1, k + 1) if i < len(words) and words[i] == x else set()
        if kind == "any":
            return set().union(*(ends(i + n, k + 1) for n in range(x + 1) if i + n <= len(words)))
        inner = by_backtracking_from(x, words, i)
        return ends(i, k + 1).union(*(ends(j, k + 1) for j in inner))

    return lambda i: ends(i, 0)


def by_backtracking_from(nodes, words, i):
    return by_backtracking(nodes, words)(i)


def test_automaton_against_backtracking():
    import random

    rng = random.Random(3)
    nodes = [("w", "a"), ("opt", [("w", "b"), ("opt", [("w", "c")])]), ("any", 2), ("w", "d"), ("opt", [("w", "a")])]
    a = S.compile_template("x", "a <<optional>>b <<optional>>c<<end>><<end>> <<any:2>> d <<optional>>a<<end>>")
    for _ in range(300):
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        want = [(i, max(e)) for i in range(len(words)) if (e := by_backtracking_from(nodes, words, i))]
        assert a.find(words) == want


def test_mandatory_wording_decides(spark):
    text = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    rows = [(1, text, "en", "a", 1), (2, text.replace("hereby ", ""), "en", "a", 1), (3, text.replace("/or", ""), "en", "a", 1)]
    got = {r.doc_id: r.labels for r in S.license_scan(cases.documents(spark, rows)).collect()}
    assert got == {1: "isc-text", 2: "", 3: "isc-text"}


@pytest.mark.parametrize("bad", ["a <<end>>", "<<optional>>a", "<<what>> a", "<<any:3>> a", "<<optional>>a<<end>>", ""])
def test_bad_markup(bad):
    with pytest.raises(ValueError):
        S.compile_template("x", bad)


def test_no_rows(spark):
    assert S.license_digest(cases.documents(spark, [])).count() == 0
