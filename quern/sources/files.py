"""Text files as documents: globs below a root, UTF-8 with replacement, one line ending."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is read where no glob is given.
GLOBS = ("**/*.md", "**/*.markdown", "**/*.txt")


def glob_pattern(glob: str) -> str:
    """A regular expression for paths below the root: ** crosses folders, * and ? do not, {a,b} and [..] choose."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def decode(content):
    """Bytes as UTF-8, undecodable ones replaced, every line ending \\n."""

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"))

    return run(content)


def scan(spark: SparkSession, root: str, globs: tuple[str, ...] | list[str] = GLOBS) -> DataFrame:
    """relpath, mtime, size, content of the files below root that one of the globs fits; a file that several fit comes once.

    Listing and reading are Spark's own, so root may be in any store that it reads; only the paths that fit are read.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  file:/ and file:/// are the same
    rel = F.substring(plain(F.col("path")), F.length(plain(F.lit(base))) + 2, 1 << 20)
    fits = F.lit(False)
    for g in globs:
        fits = fits | rel.rlike(glob_pattern(g))
    return files.withColumn("relpath", rel).where(fits).select("relpath", F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"), "content")


def read_texts(spark: SparkSession, root: str, globs: tuple[str, ...] | list[str] = GLOBS) -> DataFrame:
    """relpath, mtime, body."""
    return scan(spark, root, globs).select("relpath", "mtime", decode(F.col("content")).alias("body"))


def code_files(files: DataFrame, suffixes: list[str], excluded: list[str], most_bytes: int = 512_000) -> DataFrame:
    """Files (relpath, size) with one of the suffixes, of at most that size, and in none of the folders."""
    parts = F.split("relpath", "/")
    fits = F.lit(False)
    for s in suffixes:
        fits = fits | F.col("relpath").endswith(s)
    return files.where(fits & (F.col("size") <= most_bytes) & ~F.arrays_overlap(parts, F.array(*map(F.lit, excluded)).cast("array<string>")))


def archive_members(archives: DataFrame) -> DataFrame:
    """archive, member, body of zip and tar archives (path, content); members that are no files are left out."""
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    @F.pandas_udf(ArrayType(StructType([StructField("member", StringType()), StructField("body", StringType())])))
    def unpack(content: pd.Series) -> pd.Series:
        import io
        import tarfile
        import zipfile

        def one(raw: bytes) -> list[dict]:
            if zipfile.is_zipfile(io.BytesIO(raw)):
                z = zipfile.ZipFile(io.BytesIO(raw))
                return [{"member": n, "body": z.read(n).decode("utf-8", "replace")} for n in z.namelist() if not n.endswith("/")]
            with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                return [{"member": m.name, "body": t.extractfile(m).read().decode("utf-8", "replace")} for m in t if m.isfile()]

        return content.map(one)

    return archives.select(F.col("path").alias("archive"), F.explode(unpack("content")).alias("m")).select("archive", "m.member", "m.body")


def delimited(lines: DataFrame, names: list[str], separator: str = " +++$+++ ") -> DataFrame:
    """Columns of lines (value) split at a separator of several characters; missing ones are null."""
    parts = F.split("value", r"\Q" + separator + r"\E")
    return lines.select(*(F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)))


def dialogs(lines: DataFrame, conversations: DataFrame, titles: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, title from lines (line_id, speaker, text), conversations (conv_id, movie_id, line_ids array) and titles (movie_id, title); unknown lines are left out."""
    each = conversations.select("conv_id", "movie_id", F.posexplode("line_ids").alias("turn", "line_id")).join(lines, "line_id")
    return each.join(titles, "movie_id", "left").select("conv_id", "turn", F.col("speaker").alias("role"), "text", F.coalesce("title", "movie_id").alias("title"))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def paths_sink(results: DataFrame) -> DataFrame:
    """value: collection/relpath per result, best first within a query."""
    return results.orderBy("qid", "rank").select(F.concat_ws("/", "collection", "relpath").alias("value"))


def text_sink(results: DataFrame, snippet: int = 160) -> DataFrame:
    """value: score, #docid, path and title of each result, with the snippet on the next line."""
    return results.orderBy("qid", "rank").select(F.concat(F.format_string("%.3f  #%s  %s/%s — %s", "score", "docid", "collection", "relpath", "title"), F.lit("\n    "), F.substring(F.coalesce("snippet", F.lit("")), 1, snippet)).alias("value"))
