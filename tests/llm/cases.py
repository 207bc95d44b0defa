"""Rows that every operator has to stand: nulls, empty and long texts, ties, repeated rows, clashing names, no rows."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the cat sat on a mat and then it ran over the hill to see what the dog had done with an old red ball".split()
LONG = " ".join(WORDS[i * 7 % len(WORDS)] + str(i % 997) for i in range(60_000))
TEXTS = [
    (1, " ".join(WORDS * 4), "en", "a"),
    (2, "", "en", "a"),
    (3, None, "en", "b"),
    (4, LONG, "en", "b"),
    (5, "Le chat dort. " * 30, "fr", "c"),
    (5, "Le chat dort. " * 30, "fr", "c"),
    (6, " ".join(WORDS * 4), "en", None),
    (None, " ".join(WORDS * 3), None, "a"),
    (None, None, None, None),
    (7, "  \n\t ", "fr", "c"),
    (8, "x", "en", "d"),
    (9, "12345 !!! ###", None, "d"),
    (10, "İstanbul ÇAĞ naïve 日本語 emoji 😀 text", "fr", "e"),
]
ROWS = [(a, b, c, d, len(b or "")) for a, b, c, d in TEXTS]
#: Names that operators use inside.
CLASHING = ["key", "fp", "h", "a", "b", "n", "word", "root", "_t", "_w", "_lang", "_fp", "_size", "_n", "_row", "_rest", "score", "rid", "here", "rest", "size", "tokens", "rule"]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def crowded(df):
    """df with columns of clashing names, in front and behind."""
    extra = [c for c in CLASHING if c not in df.columns]
    return df.select(*(F.lit(c).alias(c) for c in extra[:5]), *df.columns, *(F.lit(c).alias(c) for c in extra[5:]))


def rows(df, *order):
    out = [tuple(r) for r in (df.select(*order) if order else df).collect()]
    return sorted(out, key=repr)


def same_with_clashes(op, docs, *order):
    """The operator's rows, after checking that columns of clashing names change nothing."""
    got = rows(op(docs), *order)
    assert rows(op(crowded(docs)), *order) == got
    return got


def crc_mod(doc_id, mod):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % mod if doc_id is not None else -1
