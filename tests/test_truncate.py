import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quern.operators.truncate import Spec, calibrated, calibrated_soft, min_score, truncate
from tests.small import ranked


def kept(spark, scores, spec, mode="hybrid", sources=None):
    return [r.doc_id for r in truncate(ranked(spark, scores, sources), spec, mode).orderBy("rank").collect()]


@pytest.mark.parametrize(
    ("scores", "spec", "n"),
    [
        ([0.3, 0.1, 0.099, 0.0], "abs:0.1", 2), ([10, 6, 4.9, 1], "ratio:0.5", 2), ([1, 0.6, 0.49, 0.1], "ratio:0.5", 2), ([1, 0.8, 0.39, 0.38], "gap:0.5", 2), ([1, 0.8, 0.39, 0.38], "gap", 2),
        ([1, 0.9, 0.1, 0.09], "knee", 2), ([1, 0.1, 0.01], "knee", 3), ([0.4] * 4, "knee", 4), ([1, 0.2, 0.19, 0.18, 0.17], "mad:3", 1), ([1, 0.1], "mad:3", 2), ([0.2] * 4, "mad:3", 4), ([0.0] * 4, "mad", 4),
        ([0.3, 0.2, 0.1], "mad:3", 0), ([0.5], "abs:0.6", 0), ([0.5], "knee", 1), ([1, 2, 3, 0.5], "off", 4), ([1, 2, 3, 0.5], None, 4), ([0.0, 0.0, -1.0], "gap:0.5", 3),
    ],
)
def test_counts(spark, scores, spec, n):
    assert kept(spark, scores, spec) == list(range(n))


def test_sources(spark):
    s = [{"vector": 0.31}, {"lexical": 0.21}, {"vector": 0.29, "lexical": 0.19}, {"vector": 0.1}, {}]
    assert kept(spark, [5, 4, 3, 2, 1], "source:0.3,0.2", "hybrid", s) == [0, 1]
    assert kept(spark, [0.31, 0.3, 0.29], "source:0.3,0.9", "vector") == [0, 1]
    assert kept(spark, [0.25, 0.19], "source:0.4,0.2", "lexical") == [0] and kept(spark, [0.31, 0.29], "source:0.3", "lexical") == [0]
    assert kept(spark, [1], "source:0.4,0.2", "hybrid", [{"vector": 0.1}]) == []


@pytest.mark.parametrize("bad", ["what", "abs", "abs:", "ratio", "source", "ratio:abc"])
def test_bad_specs(bad):
    with pytest.raises(ValueError):
        Spec.parse(bad)


def test_hybrid_source_needs_two(spark):
    with pytest.raises(ValueError):
        truncate(ranked(spark, [1.0]), "source:0.3", "hybrid")


def plain(scores, spec):
    """The same rules over a list."""
    name, p = Spec.parse(spec).name, Spec.parse(spec).params
    n = len(scores)
    if name == "abs":
        return [i for i in range(n) if scores[i] >= p[0]]
    if name == "ratio":
        return [i for i in range(n) if scores[i] >= p[0] * scores[0]]
    if name == "gap":
        cut = next((i for i in range(1, n) if scores[i - 1] > 0 and scores[i] < p[0] * scores[i - 1]), n)
        return list(range(cut))
    if name == "knee":
        if n < 4 or scores[0] <= scores[-1]:
            return list(range(n))
        d = [scores[0] + (scores[-1] - scores[0]) * (i / (n - 1)) - scores[i] for i in range(1, n - 1)]
        return list(range(d.index(max(d)) + 1 if max(d) > -1 else 1))
    if n < 3:
        return list(range(n))
    med = statistics.median(scores)
    mad = statistics.median(abs(s - med) for s in scores)
    return [i for i in range(n) if mad <= 0 or scores[i] >= med + p[0] * mad]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(-3, 40).map(lambda x: x / 8), min_size=1, max_size=9), min_size=1, max_size=30))
def test_batches_of_lists_against_plain_rules(spark, lists):
    df = None
    for k, scores in enumerate(lists):
        rows = ranked(spark, scores, qid=str(k))
        df = rows if df is None else df.unionByName(rows)
    df = df.coalesce(2).persist()
    for spec in ("abs:1", "ratio:0.5", "gap:0.6", "knee", "mad:1"):
        got = {}
        for r in truncate(df, spec).orderBy("qid", "rank").collect():
            got.setdefault(int(r.qid), []).append(r.doc_id)
        assert got == {k: v for k, s in enumerate(lists) if (v := plain(s, spec))}, spec
    df.unpersist()


def test_calibrated(spark):
    scores = [1.0, 0.9, 0.3, 0.2, 0.05]
    floor = [s for s in scores if s >= 0.1]
    assert [r.doc_id for r in calibrated(ranked(spark, scores), 0.1).orderBy("rank").collect()] == plain(floor, "knee")
    assert [r.doc_id for r in calibrated(ranked(spark, scores), None).orderBy("rank").collect()] == plain(scores, "knee")
    assert calibrated(ranked(spark, scores), 5.0).count() == 0
    assert [r.doc_id for r in calibrated_soft(ranked(spark, [1.0] * 8), 1.0).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_min_score(spark):
    assert min_score(ranked(spark, [0.5, 0.4]), 0.45).count() == 1 and min_score(ranked(spark, [0.5, 0.4]), None).count() == 2
