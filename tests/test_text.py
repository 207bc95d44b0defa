import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.chunking import chunk, chunks
from quern.functions.porter import stem


def column(spark, value, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], "x string").select(f(F.col("x"))).collect()]


def test_terms_fold_case_and_accents(spark):
    assert column(spark, ["Don't foo_bar CAFÉ 3.14 x-ray 日本語 😀", None, ""], T.terms) == [["don", "t", "foo", "bar", "cafe", "3", "14", "x", "ray", "日本語"], [], []]


def test_query_tokens_and_phrases(spark):
    q = ['auth "rolling restart" don\'t', '"', "!!!", "a-b (c) AND OR NOT *"]
    assert column(spark, q, lambda c: T.query_tokens(T.without_quoted(c))) == [["auth", "don't"], [], [], ["a", "b", "c", "AND", "OR", "NOT"]]
    assert column(spark, q, T.quoted_phrases) == [["rolling restart"], [], [], []]


def test_titles(spark):
    texts = ["intro\n## Real title  \nbody", "\n  first line \nsecond", "", "x" * 300, "a\r\n# H\r\n"]
    got = column(spark, texts, lambda c: T.title(c, F.lit("fallback")))
    assert got[:4] == ["Real title", "first line", "fallback", "x" * 120]


def test_lines_are_those_of_splitlines(spark):
    texts = ["a\nb", "a\n", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e f g", "a\n\nb\n\n"]
    assert column(spark, texts, T.lines) == [t.splitlines() for t in texts]
    assert column(spark, [""], T.lines) == [[]]


def test_text_documents(spark):
    dense = "x" * 60
    texts = ["plain words here", "", "a\0b", "\n".join([dense, dense, "a b", "c d"]), "\n".join([dense, "a b", "c d", "e f"])]
    assert column(spark, texts, T.is_text_document) == [True, False, False, False, True]


def test_content_words(spark):
    got = column(spark, ["The quick brown-fox it's don't foo9 ab can_do 9lives THESE"], T.content_words)[0]
    words = [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_'-]{2,}", "The quick brown-fox it's don't foo9 ab can_do 9lives THESE")]
    assert got == [w for w in words if w not in T.STOPWORDS and len(w) > 3]


def test_paths(spark):
    assert column(spark, ["src/a.py", "vendor/x.py", "a/.git/x", "a/build/b", "building/x"], T.indexable_path) == [True, False, False, False, True]
    assert column(spark, ["alt.atheism/49960.txt", "a___b/c d!.md", "x/.hidden", "//a//", "$x/ü_y.tar.gz"], T.slug_path) == ["alt-atheism/49960.txt", "a/b/c-d.md", "x/.hidden", "a", "$x/ü-y-tar.gz"]
    rows = spark.createDataFrame([("a/b.txt", "b.txt"), ("ab.txt", "b.txt"), ("b.txt", "b.txt")], "p string, e string")
    assert [r[0] for r in rows.select(T.path_matches(F.col("p"), F.col("e"))).collect()] == [True, False, True]


def test_hash_embedding(spark):
    import hashlib
    import math

    v = column(spark, ["The cat the dog", "", None], T.hash_embedding)
    want = [0.0] * 64
    for w in "the cat the dog".split():
        want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
    norm = math.sqrt(sum(x * x for x in want))
    assert v[0] == pytest.approx([x / norm for x in want]) and v[1] == v[2] == [0.0] * 64


def test_stems_are_those_of_the_index_library():
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing failing filing happy sky relational conditional valenci digitizer conformabli radicalli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption communism activate angulariti homologous effective bowdlerize probate rate cease controll roll by is on".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    for i, w in enumerate(words):
        db.execute("insert into t(rowid, x) values (?, ?)", (i + 1, w))
    want = {doc: term for term, doc, *_ in db.execute("select term, doc from v")}
    assert {w: stem(w) for w in words} == {w: want[i + 1] for i, w in enumerate(words)}


WORDS = "lorem ipsum dolor sit amet "


@pytest.mark.parametrize("text", ["", "  \n\t", None])
def test_blank_texts_have_no_chunk(text):
    assert chunk(text) == []


def test_chunks_cover_overlap_and_move(spark):
    text = "\n\n".join(WORDS * 16 for _ in range(30))
    out = chunk(text, 1000, 150, 300)
    assert len(out) > 3 and out[0][1] == 0 and out[-1][1] + out[-1][2] == len(text)
    assert all(b[1] < a[1] + a[2] and b[1] > a[1] for a, b in zip(out, out[1:], strict=False))
    assert [tuple(c) for c in column(spark, [text], lambda c: chunks(c, 1000, 150, 300))[0]] == out
    assert chunk("short") == [(0, 0, 5)]


def test_chunks_end_at_headings():
    filler = WORDS * 30
    text = "".join(f"## part {i}\n\n{filler}\n\n" for i in range(3))
    starts = {m.start() for m in re.finditer("^## ", text, re.M)}
    assert {p + n for _, p, n in chunk(text, 900, 100, 400)} & starts


def test_no_chunk_starts_inside_a_fence():
    fence = "```\n" + "\n".join(f"code line {i}" for i in range(120)) + "\n```\n"
    text = WORDS * 20 + "\n\n" + fence + "\n" + WORDS * 40
    a = text.index("```")
    b = text.index("```", a + 3)
    assert not any(a < p <= b for _, p, _ in chunk(text, 800, 100, 300))


def test_an_odd_fence_is_no_fence():
    text = "```\n" + "line\n" * 500
    assert len(chunk(text, 300, 50, 100)) > 5


def test_first_of_equal_breaks_wins():
    text = "a" * 90 + "\n# x\n" + "b" * 400
    assert chunk(text, 100, 10, 60)[0] == (0, 0, 91)
