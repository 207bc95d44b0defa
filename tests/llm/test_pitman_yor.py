import random
from collections import Counter
from math import log10

import numpy as np
import pytest

from quern.llm import pitman_yor as P
from tests.llm import cases
from tests.llm.test_quality import SPACE


def words(text):
    import re

    return SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)"""
    c = Counter(w for r in rows if cases.crc_mod(r[0], 7) != 2 for w in words(r[1]))
    n, v = sum(c.values()), len(c)
    return sorted([(r[0], cases.crc_mod(r[0], 7) == 2, len(t), sum(c[w] > 0 for w in t), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for r in rows for t in [words(r[1])]], key=repr)


def shown(df):
    return sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()], key=repr)


def test_base_columns_on_edge_rows(spark):
    assert shown(P.pitman_yor_scores(cases.documents(spark))) == base(cases.ROWS)
    assert shown(P.pitman_yor_scores(cases.crowded(cases.documents(spark)))) == base(cases.ROWS)


def test_base_columns_on_the_whole_table_and_in_many_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = base([tuple(r) for r in docs.select("doc_id", "text").collect()])
    one, many = P.pitman_yor_scores(docs).toPandas(), P.pitman_yor_scores(docs, hot=40, group=3000).toPandas()
    for out in (one, many):
        assert shown(spark.createDataFrame(out)) == want
    # other draws in other groups, with split contexts: the same model up to sampling
    assert abs(one.score.sum() - many.score.sum()) < 0.002 * -one.score.sum()


def test_reruns_agree(spark):
    docs = cases.documents(spark)
    assert cases.rows(P.pitman_yor_scores(docs)) == cases.rows(P.pitman_yor_scores(docs))


def test_a_text_longer_than_one_piece(spark):
    rows = [(i, " ".join(f"w{k * k % 5003}" for k in range(n)), "en", "a", 1) for i, n in enumerate((400_000, 30, 0))]
    for got, want in zip(shown(P.pitman_yor_scores(cases.documents(spark, rows))), base(rows), strict=True):
        assert got[:5] == want[:5] and abs(got[5] - want[5]) < 1e-9 * -want[5] + 1e-6


@pytest.mark.parametrize("chunk", [1, 2, 7, 50])
def test_pieces_are_the_words(monkeypatch, chunk):
    monkeypatch.setattr(P, "CHUNK", chunk)
    for text in ("", " ", "a", "One two  THREE\n\tfour é日本 five ", "x" * 90 + " y"):
        assert [w for p in P._pieces(text) for w in p] == text.encode().lower().split() + [P.END]


def test_better_than_the_base_on_held_out_texts(spark):
    out = [r for r in P.pitman_yor_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score < 0 and abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in out)


class Brute:
    """The same model, seat by seat: tables are lists of customers, every move is made with all totals up to date."""

    def __init__(self, texts, seed):
        self.rng = random.Random(seed)
        self.tokens = [(u, w) for t in texts for u, w in zip([""] + words(t)[:-1], words(t), strict=True)]
        self.at, self.n, self.t, self.root = {}, Counter(), Counter(), Counter()
        for u, w in self.tokens:
            self.sit(u, w)

    def parent(self, w):
        (d, s), k = P.ROOT, sum(self.root.values())
        return (self.root[w] - d) / (s + k) if self.root[w] else (s + d * len(+self.root)) / (s + k)

    def sit(self, u, w):
        (d, s), here = P.CONTEXT, self.at.setdefault((u, w), [])
        odds = [x - d for x in here] + [(s + d * self.t[u]) * self.parent(w)]
        k = self.rng.choices(range(len(odds)), odds)[0]
        if k == len(here):
            here.append(0)
            self.t[u] += 1
            self.root[w] += 1
        here[k] += 1
        self.n[u] += 1

    def leave(self, u, w):
        here = self.at[u, w]
        k = self.rng.choices(range(len(here)), here)[0]
        here[k] -= 1
        self.n[u] -= 1
        if not here[k]:
            del here[k]
            self.t[u] -= 1
            self.root[w] -= 1

    def sweep(self):
        for u, w in self.tokens:
            self.leave(u, w)
            self.sit(u, w)

    def p(self, u, w):
        (d, s), here = P.CONTEXT, self.at.get((u, w), ())
        return (sum(here) - d * len(here) + (s + d * self.t[u]) * self.parent(w)) / (s + self.n[u])


def test_scores_against_a_seat_by_seat_sampler(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(25)]
    rows = []
    for i in range(60):
        text = ["w0"]
        while len(text) < 40:
            text.append(vocabulary[(int(text[-1][1:]) * 3 + int(rng.paretovariate(1.2))) % 25])
        rows.append((i, " ".join([*text, *(["new"] if i % 9 == 0 else [])]), "en", "a", 1))
    got = {r.doc_id: r.score for r in P.pitman_yor_scores(cases.documents(spark, rows)).collect()}
    brute = Brute([r[1] for r in rows if cases.crc_mod(r[0], 7) != 2], 1)
    mean: dict = {}
    for i in range(40):
        brute.sweep()
        if i == 20:
            for u in {u for u, _ in brute.tokens}:  # every context's words and the unknown one share 1
                assert abs(sum(brute.p(u, w) for w in +brute.root) + brute.p(u, "neverseen") - 1) < 1e-9
        if i >= 10:
            for r in rows:
                for pair in zip([""] + words(r[1])[:-1], words(r[1]), strict=True):
                    mean.setdefault((r[0], pair), []).append(brute.p(*pair))
    want = {r[0]: sum(log10(np.mean(mean[r[0], pair])) for pair in zip([""] + words(r[1])[:-1], words(r[1]), strict=True)) for r in rows}
    # three samples against thirty: single texts differ by the draw, all of them together hardly
    assert max(abs(got[k] / want[k] - 1) for k in want) < 0.03 and abs(sum(got.values()) / sum(want.values()) - 1) < 0.005
    # word order matters
    salad = [(100, " ".join(random.Random(5).sample(rows[1][1].split(), 40)), "en", "a", 1)]
    both = {r.doc_id: r.score for r in P.pitman_yor_scores(cases.documents(spark, rows + salad)).collect()}
    assert both[1] > both[100]


def test_sweeps_keep_the_exact_distribution_of_tables():
    """Chances of t tables for c customers: S(c, t) * strength (strength + d) ... * parent ** t."""
    (d, s), c, p, n = (0.5, 2.0), 6, 0.1, 6000
    chance = {0: {0: 1.0}}
    for k in range(1, c + 1):
        chance[k] = {t: chance[k - 1].get(t - 1, 0) + (k - 1 - d * t) * chance[k - 1].get(t, 0) for t in range(1, k + 1)}
    weight = np.array([chance[c][t] * np.prod([s + d * k for k in range(t)]) * p**t for t in range(1, c + 1)])
    t, served = np.ones(n, np.int64), np.ones(n)
    rng = np.random.default_rng(3)
    for _ in range(12):
        P.sweep(np.full(n, c), t, np.arange(n), served, np.full(n, p), rng, (d, s))
    got = np.bincount(t, minlength=c + 1)[1:] / n
    assert (served == t).all() and np.abs(got - weight / weight.sum()).max() < 0.03


def test_pairs_of_a_slice_in_little_memory():
    """Two slices of two million tokens are in an executor at a time: a token may cost some tens of bytes, and the pairs are right."""
    import tracemalloc

    rng, n, v, groups = np.random.default_rng(2), 400_000, 60_000, 20
    tokens = (rng.pareto(0.6, n) * 50 % v).astype(np.int32)
    lens = [n // 4, 0, n // 4, n // 2]
    held, before = [False, False, True, False], [0, 0, 5, 0]
    hashes = rng.integers(0, 1 << 63, v).astype(np.uint64) * np.uint64(2)
    row = {"words": hashes.tobytes(), "tokens": tokens.tobytes(), "lens": lens, "held": held, "before": before}
    hot = np.unique(hashes[:3] >> np.uint64(16))
    tracemalloc.start()
    left, right, counts, cuts, pair = P._Slice(row, groups, hot).pairs()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    previous = np.concatenate([[0], tokens[:-1]])
    previous[[0, n // 4, n // 2]] = [0, 5, 0]
    assert (left[pair] == previous).all() and (right[pair] == tokens).all()
    train = np.r_[0 : n // 4, n // 2 : n]
    want = Counter(zip(previous[train].tolist(), tokens[train].tolist()))
    assert len(left) == len(set(zip(left.tolist(), right.tolist()))) and cuts[0] == 0 and cuts[-1] == len(left)
    assert {(a, b): k for a, b, k in zip(left.tolist(), right.tolist(), counts.tolist()) if k} == want
    assert peak < 60 * n


def test_a_sweep_moves_every_customer_of_a_large_dish():
    """As many moves as customers, made one by one, from one table: far more than sixteen of them."""
    (d, s), c, p, n = (0.5, 2.0), 700, 0.08, 3000
    rng, others = np.random.default_rng(6), 40.0
    t = np.ones(n, np.int64)
    for _ in range(c):
        left = t - (rng.random(n) < P.alone(np.full(n, c), t, d))
        fresh = (s + d * (others + left)) * p
        t = left + (rng.random(n) < fresh / (fresh + c - 1 - d * left))
    got, served = np.ones(n, np.int64), np.full(n, others + 1)
    P.sweep(np.full(n, c), got, np.arange(n), served, np.full(n, p), rng, (d, s))
    assert (served == others + got).all() and t.mean() > 2
    assert abs(got.mean() - t.mean()) < 0.1 and abs(got.std() - t.std()) < 0.1


def test_a_very_large_dish_takes_time_by_its_changes():
    c = np.array([2, 40, 10**12])
    t, served = np.ones(3, np.int64), np.ones(3)
    P.sweep(c, t, np.arange(3), served, np.full(3, 1e-4), np.random.default_rng(1))
    assert ((t >= 1) & (t <= c)).all() and (served == t).all()


def test_chance_of_sitting_alone_beyond_the_table():
    c = np.array([200, 250, 256])
    assert np.allclose(P.alone(c, np.array([2, 3, 4]), 0.7), 0.7 * np.array([1, 2, 3]) / (c - 1), rtol=0.15)
    assert (P.alone(np.array([2, 5, 900]), np.array([1, 1, 1]), 0.7) == 0).all() and P.alone(np.array([4]), np.array([4]), 0.7)[0] == 1


def test_seating_against_one_customer_at_a_time():
    rng, n = np.random.default_rng(1), 4000
    got = P.tables(np.full(n, 12), np.full(n, 0.05), np.full(n, 30.0), 0.5, 2.0, rng)
    fresh, many = (2.0 + 0.5 * 30) * 0.05, []
    for _ in range(n):
        t = 1
        for seated in range(1, 12):
            t += rng.random() < fresh / (fresh + seated - 0.5 * t)
        many.append(t)
    assert abs(got.mean() - np.mean(many)) < 0.1 and got.min() >= 1 and got.max() <= 12


@pytest.mark.parametrize("customers", [[0, 1, 2, 5000], [17]])
def test_tables_stay_within_customers(customers):
    c = np.array(customers)
    t = P.tables(c, np.full(len(c), 0.01), np.full(len(c), 3.0), 0.5, 1.0, np.random.default_rng(2))
    assert ((t <= c) & ((t > 0) == (c > 0))).all()


def test_no_rows(spark):
    assert P.pitman_yor_scores(cases.documents(spark, [])).count() == 0
