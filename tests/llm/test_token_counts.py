import public_tokenizers as public
from tokenizers import Tokenizer

from quern.llm.token_counts import token_counts
from tests.llm import cases


def want(rows):
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    out = []
    for r in rows:
        text = r[1] or ""
        n = len(t.encode(text, add_special_tokens=False))
        out.append((r[0], len(text.encode()), n, n > 512))
    return sorted(out, key=repr)


SPECIAL = [(20, "a <|endoftext|> b<|endoftext|>", "en", "a", 1), (21, "<|endoftext|>", "en", "a", 1), (22, "it's  we'll\n\n x  \t1234 ünï ", "en", "a", 1), (23, "<|endoftext", "en", "a", 1)]


def test_edge_rows(spark):
    rows = cases.ROWS + SPECIAL
    assert cases.same_with_clashes(token_counts, cases.documents(spark, rows)) == want(rows)


def test_many_groups(spark):
    rows = cases.ROWS + SPECIAL
    assert cases.rows(token_counts(cases.documents(spark, rows), group=50)) == want(rows)


def test_a_slice_names_each_pre_token_once(spark):
    """What is counted is the distinct pre-tokens, not the documents' own: the sum of entries dealt out is the vocabulary's size."""
    from quern.llm import token_counts as T

    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    docs = cases.documents(spark, [(i, "the same words here", "en", "a", 1) for i in range(500)]).coalesce(1)
    rows = docs.select("doc_id", "text").mapInArrow(T._slices(shared), "slice long, ids array<long>, sizes array<long>, bags array<int>, places binary, times binary, tokens binary, v long").collect()
    assert [r.v for r in rows] == [4] and rows[0].bags == [4] * 500
    assert sorted(T._read_strings(bytes(rows[0].tokens)).to_pylist()) == [" here", " same", " words", "the"]


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert cases.rows(token_counts(docs)) == want([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_no_rows(spark):
    assert token_counts(cases.documents(spark, [])).count() == 0
