"""Text functions as Column expressions; all run in the JVM but the Porter stemmer, which sees distinct terms only."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters read for a title, longest title, docid length.
TITLE_CHARS, TITLE_MAX, DOCID_CHARS = 4000, 120, 6

#: The words that never count as content.
STOPWORDS = sorted(
    set(
        "the and for that with this from have are was were you your not but all can our out they them then than has had who whom what when where which"
        " while will would there their about into over under just like some more most other been being does did doing she her his him its it's don't can't"
        " won't isn't how why these those each very much many may might must shall could should a an is in on at to of as by or if we he it no yes one two"
        " three also any new now get got make made use used using".split()
    )
)
#: A content word's pattern, and the start of a chat line.
CONTENT_PATTERN = r"[A-Za-z][A-Za-z0-9_'\-]{2,}"
CHAT_PREFIX = r"^\d{2}/\d{2}/\d{4}, \d{2}:\d{2} - [^:]*: "
#: What ends a line for the functions that read lines: \r\n, \n, \r, \v, \f, x1c-x1e, x85, u2028, u2029.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


@cache
def accent_map() -> tuple[str, str]:
    """Lower-case letters whose decomposition is one ASCII letter and marks, and these letters; by rule, from the Latin blocks."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(cp).lower())
        if len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(c) for c in parts[1:]) and len(chr(cp).lower()) == 1:
            pairs.append((chr(cp).lower(), parts[0]))
    pairs = sorted(set(pairs))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), *accent_map())


def terms(text: Column) -> Column:
    """Index terms of the simple analyzer, in order: runs of letters and digits, folded. Null gives an empty array."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_tokens(query: Column) -> Column:
    """Tokens of a query: runs of letters, digits, underscores and apostrophes."""
    return F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))


def quoted_phrases(query: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit('"([^"]+)"'), F.lit(1))


def without_quoted(query: Column) -> Column:
    return F.regexp_replace(F.coalesce(query, F.lit("")), '"[^"]+"', " ")


def lines(text: Column) -> Column:
    """Lines without their ends; a break at the very end opens no further line, an empty text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def title(text: Column, fallback: Column) -> Column:
    """First heading within the first 4,000 characters, else the first line that is not blank (120 characters), else the fallback."""
    heading = F.regexp_extract(F.substring(F.coalesce(text, F.lit("")), 1, TITLE_CHARS), r"(?dmU)^#{1,6}\s+(.+?)\s*$", 1)
    first = F.get(F.filter(F.transform(lines(text), strip), lambda x: x != ""), F.lit(0))
    return F.when(heading != "", strip(heading)).otherwise(F.coalesce(F.substring(first, 1, TITLE_MAX), fallback))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def docid(hash_: Column) -> Column:
    return F.substring(hash_, 1, DOCID_CHARS)


def content_words(text: Column) -> Column:
    """Content words in order, repeats kept: lower case, over three characters, no stop words."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CONTENT_PATTERN), F.lit(0)), F.lower)
    # a set of literals: looked up by hash, not compared one by one
    return F.filter(found, lambda w: (F.length(w) > 3) & ~w.isin(STOPWORDS))


def is_text_document(body: Column) -> Column:
    """False for texts with a NUL, without a line, or with over a quarter of lines that are long and have no space."""
    rows = F.transform(lines(body), strip)
    dense = F.filter(rows, lambda x: (F.length(x) > 40) & (F.instr(x, " ") == 0))
    return (F.instr(F.coalesce(body, F.lit("")), "\0") == 0) & (F.size(rows) > 0) & (F.size(dense) <= 0.25 * F.size(rows))


def indexable_path(path: Column) -> Column:
    """False where a path has a hidden part or one of the build folders."""
    return ~F.exists(F.split(path, "/"), lambda x: x.isin("vendor", "node_modules", "dist", "build") | x.startswith("."))


def path_matches(path: Column, expected: Column) -> Column:
    """The path is the expected one, or ends with it after a slash."""
    return (path == expected) | path.endswith(F.concat(F.lit("/"), expected))


def slug_path(path: Column) -> Column:
    """Display form of a path: other than letters, digits and $ become one dash; the last part keeps its ending."""
    dashed = lambda x: F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}$]+", "-"), "^-+|-+$", "")
    parts = F.filter(F.split(F.replace(path, F.lit("___"), F.lit("/")), "/"), lambda x: x != "")
    ending = lambda x: F.regexp_extract(x, r"(\.[A-Za-z0-9]+)$", 1)
    last = F.size(parts) - 1
    cleaned = F.transform(parts, lambda x, i: F.when(i == last, F.concat(dashed(F.substring(x, F.lit(1), F.length(x) - F.length(ending(x)))), ending(x))).otherwise(dashed(x)))
    return F.array_join(F.filter(cleaned, lambda x: x != ""), "/")


def let(value: Column, body) -> Column:
    """body(value) with value computed once; a plain reference is computed again for every element of a lambda around it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Normalised bag-of-words vector: white-space tokens, lower case, counted at md5(token) modulo dim."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda x: x != "")
    places = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim)
    # sorted together with one mark for each place and one beyond, a place's words stand between its mark and the next
    marks = F.sequence(F.lit(0).cast("long"), F.lit(dim).cast("long"))
    first = lambda row: F.transform(marks, lambda i: F.array_position(row, i))
    count = lambda at: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.get(at, i + 1) - F.get(at, i) - 1).cast("double"))
    places = let(let(F.sort_array(F.concat(places, marks)), first), count)
    return normalise(places)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    scaled = lambda own: let(F.sqrt(dot(own, own)), lambda norm: F.transform(own, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm)))
    return let(v, scaled)


def stemmed(df: DataFrame, term: str = "term") -> DataFrame:
    """df with `term` replaced by its Porter stem. Python sees every distinct term once, not every occurrence."""
    from quern.functions.porter import stem

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem)

    book = df.select(F.col(term).alias("_word")).distinct().withColumn("_stem", stems("_word"))
    return df.join(book, F.col(term) == F.col("_word")).withColumn(term, F.col("_stem")).drop("_word", "_stem")
