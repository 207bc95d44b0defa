"""Index maintenance by snapshots: what changed, what is pending, what is orphaned; new snapshots by anti-joins and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import chunking
from quern.functions import text as T

CHANGES = ("added", "removed", "updated", "touched", "unchanged")


class PinError(ValueError):
    """The index was built with another profile, size or backend."""


def diff(stored: DataFrame, found: DataFrame, key: str = "relpath") -> DataFrame:
    """key, doc_id, change from stored (key, doc_id, hash, mtime) and found (key, hash, mtime), within one collection.

    removed: gone; added: new; unchanged: same mtime (a change of content behind it stays unseen); touched: same content at
    another mtime; updated: other content. One full outer join on the key.
    """
    s = stored.select(F.col(key).alias("_k"), "doc_id", F.col("hash").alias("_h"), F.col("mtime").alias("_m"))
    j = s.join(found.select(key, "hash", "mtime"), F.col("_k") == F.col(key), "full_outer")
    change = (
        F.when(F.col(key).isNull(), "removed").when(F.col("_k").isNull(), "added").when(F.col("_m") == F.col("mtime"), "unchanged").when(F.col("_h") == F.col("hash"), "touched").otherwise("updated")
    )
    return j.select(F.coalesce(F.col(key), F.col("_k")).alias(key), "doc_id", change.alias("change"))


def diff_counts(changes: DataFrame) -> DataFrame:
    """One row: added, updated, removed, unchanged (touched ones included)."""
    n = lambda *names: F.count_if(F.col("change").isin(*names)).alias(names[0])
    return changes.agg(n("added"), n("updated"), n("removed"), n("unchanged", "touched"))


def next_documents(stored: DataFrame, found: DataFrame, changes: DataFrame, key: str = "relpath") -> DataFrame:
    """The new snapshot: kept rows (touched ones with the new mtime), and found rows for what is added or updated, under new ids.

    New ids follow the highest stored one, in no particular order. found has all columns of stored but doc_id.
    """
    kept = stored.join(changes.where("change in ('unchanged', 'touched')").select(key, F.lit(True).alias("_same")), key).drop("_same")
    seen = found.select(key, F.col("mtime").alias("_mtime"))
    kept = kept.join(seen, key, "left").withColumn("mtime", F.coalesce("_mtime", "mtime")).drop("_mtime")
    fresh = found.join(changes.where("change in ('added', 'updated')").select(key), key, "left_semi")
    top = stored.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("_top"))
    fresh = fresh.crossJoin(top).withColumn("doc_id", F.col("_top") + 1 + F.monotonically_increasing_id()).drop("_top")
    return kept.select(*stored.columns).unionByName(fresh.select(*stored.columns))


def cascade(gone: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and vectors without the documents in gone (doc_id)."""
    ids = gone.select("doc_id").distinct()
    dead = chunks.join(ids, "doc_id", "left_semi").select("chunk_id")
    return documents.join(ids, "doc_id", "left_anti"), chunks.join(ids, "doc_id", "left_anti"), vectors.join(dead, "chunk_id", "left_anti")


def pending(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents without a chunk; blank ones stay pending, as they have none."""
    return documents.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")


def orphans(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks of known documents that have no vector."""
    return chunks.join(documents.select("doc_id"), "doc_id", "left_semi").join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def cut(documents: DataFrame, first_id: int = 0, **sizes: int) -> DataFrame:
    """chunk_id, doc_id, seq, pos, length of documents (doc_id, body); ids are unique, from first_id up."""
    rows = documents.select("doc_id", F.explode(chunking.chunks(F.col("body"), **sizes)).alias("c"))
    return rows.select((F.monotonically_increasing_id() + first_id).alias("chunk_id"), "doc_id", "c.seq", "c.pos", "c.length")


def upsert(collections: DataFrame, new: DataFrame) -> DataFrame:
    """Collections by name; a new row replaces the stored one."""
    return collections.join(new.select("name"), "name", "left_anti").unionByName(new)


def pin(meta: dict[str, str], **wanted: str) -> dict[str, str]:
    """meta with the wanted values added; raises PinError where a stored one differs."""
    for k, v in wanted.items():
        if meta.get(k, v) != v:
            raise PinError(f"{k} is {meta[k]}, not {v}; rebuild the index to change it")
    return {**wanted, **meta}


def from_files(files: DataFrame, collection: str) -> DataFrame:
    """Documents of one collection (without ids) from files (relpath, body, mtime): title, hash and state added."""
    stem = F.regexp_replace(F.element_at(F.split("relpath", "/"), -1), r"(?<=.)\.[^.]*$", "")
    return files.select(F.lit(collection).alias("collection"), "relpath", T.title(F.col("body"), stem).alias("title"), "body", T.content_hash(F.col("body")).alias("hash"), "mtime", F.lit(True).alias("active"))
