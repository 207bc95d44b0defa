import base64
import hashlib

import public_tokenizers as public
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe as B
from tests.llm import cases

V = B.load()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def digests(rows):
    out = []
    for r in rows:
        ids = LIBRARY.encode_ordinary(r[1] or "")
        out.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return sorted(out, key=repr)


HARD = [(200, "a" * 5000, "x", "s", 1), (201, "日本語" * 900, "x", "s", 1), (202, " " * 3000 + "x", "x", "s", 1), (203, "ab" * 2500 + "\n\n\t" * 100, "x", "s", 1), (204, "<|endoftext|> 😀👍🏽", "x", "s", 1)]


def test_edge_rows(spark):
    rows = cases.ROWS + HARD
    assert cases.same_with_clashes(B.bpe_digests, cases.documents(spark, rows)) == digests(rows)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert cases.rows(B.bpe_digests(docs)) == digests([tuple(r) for r in docs.select("doc_id", "text").collect()])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefeinstr éü日本 ", max_size=400))
def test_tree_is_the_library(text):
    assert V.encode(text) == LIBRARY.encode_ordinary(text)
    assert V.decode(V.encode(text)) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=120), st.integers(0, 119))
def test_join_is_independent_of_the_cut(raw, at):
    at = min(at, len(raw))
    assert V.join(V.merge(raw[:at]), V.merge(raw[at:])) == V.merge(raw)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeinrst \n-=*é日", min_size=B.SHORT, max_size=300))
def test_the_heap_merges_as_the_definition(text):
    raw = text.encode()
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        ranked = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
        if not ranked:
            break
        i = min(ranked)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert V._merge_long(raw) == [RANKS[p] for p in parts]


def test_ordinary_pieces_go_through_joins(spark):
    """Of the pieces of sf0.01 that are no tokens, nearly all are joined from halves, and all come out as the library has them."""
    v, joined = B.load(), set()
    join = v.join
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(200).collect()]
    pieces = {p for t in texts for p in v.find(t)}
    for p in pieces:
        v.join = lambda a, b, p=p: (joined.add(p), join(a, b))[1]
        assert v.encode_piece(p.encode()) == LIBRARY.encode_ordinary(p) or v.find(p) != [p]
    others = [p for p in pieces if p.encode() not in RANKS and len(p.encode()) > B.LEAF]
    # what is left was remembered as the half of a longer piece
    assert len(others) > 1000 and len(joined) > 0.9 * len(others)


def test_the_library_is_not_used():
    import inspect

    assert "tiktoken." not in inspect.getsource(B).replace(".tiktoken", "")


def test_columns(spark):
    docs = cases.documents(spark)
    there = B.bpe_decode(B.bpe_encode(docs))
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in there.collect())


def test_no_rows(spark):
    assert B.bpe_digests(cases.documents(spark, [])).count() == 0
