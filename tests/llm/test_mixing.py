import random
import re
from collections import defaultdict

from quern.llm import mixing as M
from tests.llm import cases


def targets(sizes):
    """Targets by resharing the excess until none is above, as the contract has it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in open_}
        fixed |= {s: 3 * sizes[s] for s in over}


def check(docs, rows, **how):
    out = M.mix(docs, **how).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r.size) for r in out), key=repr) == sorted(((r[0], size(r[1])) for r in rows), key=repr)
    per = defaultdict(int)
    for r in rows:
        per[r[3]] += size(r[1])
    want, taken, largest = targets(per), defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == per[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in per:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1
    return out


def test_edge_rows(spark):
    check(cases.documents(spark), cases.ROWS)
    cases.same_with_clashes(M.mix, cases.documents(spark))


def test_whole_table_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = check(docs, [tuple(r) for r in docs.collect()])
    assert cases.rows(M.mix(docs.repartition(7))) == sorted(map(tuple, out), key=repr)


def test_many_levels(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 60), "en", rng.choice("aaab"), 1) for i in range(600)]
    docs = cases.documents(spark, rows)
    out = M.mix(docs, block=16).collect()
    for s in "ab":
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 130
        assert abs(sum(r.copies for r in own) - len(own) * own[0].target / own[0].source_size) <= 3


def test_equal_rows_in_bulk(spark):
    """5,000 equal rows without id or text beside 300 others: no block gets them all."""
    rows = [(None, None, "en", "a", 1)] * 3000 + [(7, "w w w", "en", "a", 1)] * 2000 + [(100 + i, "w " * (i % 40 + 1), "en", "ab"[i % 2], 1) for i in range(300)]
    docs = cases.documents(spark, rows)
    step = M._step

    def watched(level, final, seed):
        run = step(level, final, seed)
        return lambda frame: run(frame) if len(frame) <= 300 or final else (_ for _ in ()).throw(AssertionError(len(frame)))

    M._step = watched
    try:
        check(docs, rows, block=128)
    finally:
        M._step = step


def test_flight_keeps_both_totals_and_the_means():
    sizes = [random.Random(2).randint(1, 40) for _ in range(60)]
    mean = [0.0] * 60
    for seed in range(600):
        p = [0.3] * 60
        left = M.flight(sizes, p, random.Random(seed))
        assert len(left) <= 2 and abs(sum(p) - 18) < 1e-6 and abs(sum(a * b for a, b in zip(p, sizes, strict=True)) - 0.3 * sum(sizes)) < 1e-5
        M.land(sizes, p, random.Random(seed))
        assert set(p) <= {0.0, 1.0}
        mean = [m + x / 600 for m, x in zip(mean, p, strict=True)]
    assert max(abs(m - 0.3) for m in mean) < 0.1


def test_stage(spark):
    docs = cases.crowded(cases.documents(spark))
    got = M.apply_mix(docs)
    assert got.columns == docs.columns and {r.size for r in got.collect()} <= {"size"}
    drawn = defaultdict(int)
    for r in M.mix(cases.documents(spark)).collect():
        drawn[r.doc_id] += r.copies
    seen = defaultdict(int)
    for r in got.collect():
        seen[r.doc_id] += 1
    assert seen == {k: v for k, v in drawn.items() if v}


def test_no_rows(spark):
    assert M.mix(cases.documents(spark, [])).count() == 0 and M.apply_mix(cases.documents(spark, [])).count() == 0
