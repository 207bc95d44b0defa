import corpus_pipeline as C
from quern.llm import bpe, language, mixing, queries, quality, simhash
from tests.llm import cases
from tests.llm.test_bpe import digests
from tests.llm.test_language import told as identified
from tests.llm.test_mixing import targets
from tests.llm.test_quality import base
from tests.llm.test_simhash import alike, classes, shingles


def test_stages_one_by_one_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["language_id", "quality_rules", "simhash_near_dedup", "mix_sources", "byte_bpe"]
    told = C.STAGES[0][1](spark, docs, sf)
    assert cases.rows(told, "doc_id") == [(d,) for d in identified([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()])]
    good = C.STAGES[1][1](spark, told, sf)
    assert all(not base(r.text)[5] for r in good.collect())
    assert cases.rows(good, "doc_id") == cases.rows(quality.quality_rules(told).where("kept"), "doc_id")
    single = C.STAGES[2][1](spark, good, sf)
    comps = classes([(r.doc_id, shingles(r.text)) for r in good.collect()], alike)
    assert cases.rows(single, "doc_id") == sorted({(c,) for c in comps}, key=repr)
    mixed = C.STAGES[3][1](spark, single, sf)
    assert mixed.columns == docs.columns
    size = {r.doc_id: len(r.text.split()) for r in single.collect()}
    per, taken = {}, {}
    for r in single.collect():
        per[r.source] = per.get(r.source, 0) + size[r.doc_id]
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    for s, t in targets(per).items():
        assert abs(taken.get(s, 0) - t) <= 2 * max(size.values())
    assert cases.rows(C.STAGES[4][1](spark, mixed, sf)) == digests([tuple(r) for r in mixed.select("doc_id", "text").collect()])


def test_run_is_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for step in (language.keep_identified, quality.keep_good, simhash.keep_one_per_group, mixing.apply_mix, bpe.bpe_digests):
        docs = step(docs)
    assert cases.rows(C.run(spark, sf)) == cases.rows(docs)


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
