import random

import pytest
import xxhash

from quern.llm import simhash as H
from quern.llm.common import connected_components
from tests.llm import cases


def fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    """[(id, class)] by looking at all pairs; the class is its smallest id."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(items):
        if x[0] is not None:
            least[find(i)] = min(x[0], least.get(find(i), x[0]))
    return [least.get(find(i)) for i in range(len(items))]


def want(rows, radius=2):
    items = [(r[0], fingerprint(r[1])) for r in rows]
    comp = classes(items, lambda a, b: bin(a[1] ^ b[1]).count("1") <= radius)
    return sorted([(d, f"{f:016x}", c) for (d, f), c in zip(items, comp, strict=True)], key=repr)


def test_edge_rows(spark):
    assert cases.same_with_clashes(H.simhash_near_duplicates, cases.documents(spark)) == want(cases.ROWS)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert cases.rows(H.simhash_near_duplicates(docs)) == want([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("radius", [0, 1, 2])
@pytest.mark.parametrize("long", [2, 64])
def test_links_of_crowded_fingerprints(spark, radius, long):
    """Chains, stars and dense clouds of fingerprints, with lists both paired and tied through codes."""
    rng = random.Random(radius)
    prints = set()
    for _ in range(6):
        seed = rng.getrandbits(64)
        cloud = [seed]
        for _ in range(40):
            x = rng.choice(cloud)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            cloud.append(x)
        prints |= set(cloud)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    rows = list(enumerate(signed))
    comp = classes(rows, lambda a, b: bin((a[1] ^ b[1]) & (1 << 64) - 1).count("1") <= radius)
    got = {r.fp: r.component_id for r in H.components(spark.createDataFrame(rows, "doc_id long, fp long"), radius, long).collect()}
    assert got == {fp: c for (_, fp), c in zip(rows, comp, strict=True)}


def test_count_filter_keeps_pairs_with_enough_shared_bytes(spark):
    """Pairs that agree in six or more positional bytes, and no pair that agrees in five: those meet in a list, but in too few."""
    rng = random.Random(8)
    prints = set()
    for _ in range(30):
        seed = rng.getrandbits(63)
        prints.add(seed)
        for _ in range(6):
            x = seed
            for place in rng.sample(range(8), rng.randint(1, 4)):
                x ^= rng.randint(1, 127) << (8 * place)
            prints.add(x)
    agree = lambda a, b: sum((a ^ b) >> (8 * i) & 255 == 0 for i in range(8))
    pairs = {(a, b): agree(a, b) for a in prints for b in prints if a < b}
    shared = H.postings(spark.createDataFrame([(x,) for x in prints], "fp long"))
    for radius in (1, 2):
        got = {tuple(r) for r in H.candidates(shared, radius).collect()}
        assert got == {p for p, n in pairs.items() if n >= 8 - radius}
    assert 5 in pairs.values() and 6 in pairs.values()


def test_components_of_a_path_and_null_ends(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(i + 1, i) for i in range(n)] + [(5, 5), (None, 3), (9000, 9001)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == n + 3 and len({got[i] for i in range(n + 1)}) == 1 and got[9000] == got[9001] != got[0]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stage(spark):
    docs = cases.crowded(cases.documents(spark))
    kept = H.keep_one_per_group(docs)
    comps = {c for *_, c in want(cases.ROWS)}
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(comps)
    assert {r.key for r in kept.collect()} == {"key"}


def test_no_rows(spark):
    none = cases.documents(spark, [])
    assert H.simhash_near_duplicates(none).count() == 0 and H.keep_one_per_group(none).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return a[1] == b[1] or 5 * len(a[1] & b[1]) >= 4 * len(a[1] | b[1])


def test_stage_takes_near_copies_by_five_word_jaccard(spark):
    """Copies with a few words changed, on both sides of 0.8, and boilerplate in every text; all pairs by brute force."""
    rng = random.Random(3)
    rows = []
    for g in range(40):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(6, 220))]
        for edits in (0, 1, 2, 3, 4, 6, 9)[: rng.randint(1, 7)]:
            own = list(text)
            for _ in range(edits):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(["all rights reserved by the holders of this text"] * (g % 2) + own), "en", "a", 1))
    items = [(r[0], shingles(r[1])) for r in rows]
    expect = sorted(set(classes(items, alike)))
    got = sorted(r.doc_id for r in H.keep_one_per_group(cases.documents(spark, rows)).collect())
    assert got == expect and len(expect) < len({r[2] for r in want([(r[0], r[1]) for r in rows])})


def generated(spark, run):
    """The result of run, and the most rows that one Generate of its plans made."""
    store = spark._jsparkSession.sharedState().statusStore()
    done = store.executionsList().size()
    out, most = run(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    every = store.executionsList()
    for i in range(done, every.size()):
        number = every.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                got = values.get(metric.accumulatorId())
                if node.name() == "Generate" and metric.name() == "number of output rows" and got.isDefined():
                    most = max(most, int(got.get().replace(",", "")))
    return out, most


def test_long_lists_across_groups_make_no_pairs(spark):
    """All texts share most words, and each a rarer part with one other: one long list, many groups, links inside and across them."""
    rng, rows, most = random.Random(12), [], 82
    body = [f"c{k}" for k in range(most)]
    for g in range(200):
        tail = [f"t{g}_{k}" for k in range(rng.choice((8, 10, 12, 14, 16, 18)))]
        for _ in range(2):
            rows.append((len(rows), " ".join(body + tail + [f"x{rng.randrange(10**9)}" for _ in range(rng.choice((0, 1, 3)))]), "en", "a", 1))
    docs = cases.documents(spark, rows)
    got, made = generated(spark, lambda: sorted(r.doc_id for r in H.keep_one_per_group(docs).collect()))
    expect = sorted(set(classes([(r[0], shingles(r[1])) for r in rows], alike)))
    assert got == expect and 10 < len(expect) < 200
    assert 0 < made <= 64 * len(rows)


def test_stage_verifies_what_simhash_finds(spark, monkeypatch):
    """The stage takes candidates from the index over fingerprints; near ones of unlike sets and unlike ones of near sets come out right."""
    rng, calls, near_pairs = random.Random(9), [], H.near_pairs
    monkeypatch.setattr(H, "near_pairs", lambda prints, *a, **k: calls.append(sorted(r.fp for r in prints.collect())) or near_pairs(prints, *a, **k))
    body = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    short = [f"s{k}" for k in range(40)]
    texts = [body, [*body[:-1], "other"], [*body, "more"], short, [*short[:20], "x", *short[21:]], ["lone"] * 9]
    rows = [(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)]
    got = sorted(r.doc_id for r in H.keep_one_per_group(cases.documents(spark, rows)).collect())
    assert got == sorted(set(classes([(r[0], shingles(r[1])) for r in rows], alike))) == [0, 3, 4, 5]
    assert len(calls) == 1
    # candidates of given fingerprints: one bit apart, equal, and far
    sims = {11: 0b1, 12: 0b11, 13: 0b1, 14: -1, 15: -2}
    cand = H.simhash_candidates(spark.createDataFrame(list(sims.items()), "fp long, sim long"))
    assert {tuple(sorted(r)) for r in cand.collect()} == {(11, 12), (11, 13), (14, 15)}
    # and their verification, by sets of five-word shingles
    sets = spark.createDataFrame([(11, list(range(10))), (12, list(range(1, 10))), (13, list(range(5))), (14, [1]), (16, [1])], "fp long, s array<int>")
    assert {tuple(sorted(r)) for r in H._verified(cand, sets, 0.8).collect()} == {(11, 12)}


def test_stage_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [(d, shingles(t)) for d, t in rows]
    assert sorted(r.doc_id for r in H.keep_one_per_group(docs).collect()) == sorted(set(classes(items, alike)))
