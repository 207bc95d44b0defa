"""Structured Streaming around the batch operators: an index that follows arriving documents, and streams of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import maintain
from quern.plans.engine import Engine
from quern.plans.index import Index


def follow(files: DataFrame, index: Index, collection: str, checkpoint: str, **trigger):
    """Starts a query that adds or updates the documents of each micro-batch (relpath, mtime, body) in one collection.

    Of several versions of a path in a batch the newest counts. Nothing is removed: a stream says what arrived, not what is
    gone. A batch that is run again after a failure finds its documents unchanged.
    """

    def batch(rows: DataFrame, _: int) -> None:
        if rows.isEmpty():
            return
        newest = rows.groupBy("relpath").agg(F.max_by(F.struct("mtime", "body"), "mtime").alias("r")).select("relpath", "r.mtime", "r.body")
        arrived = maintain.from_files(newest, collection)
        known = index.store.read("documents").where(F.col("collection") == collection)
        kept = known.join(arrived.select("relpath"), "relpath", "left_anti").drop("doc_id")
        index.sync_documents(collection, kept.select(*arrived.columns).unionByName(arrived))
        index._relex()
        index.embed()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def answer(queries: DataFrame, engine: Engine, sink: str, checkpoint: str, **trigger):
    """Starts a query that answers a stream of requests (qid, query, ...), a micro-batch at a time, as Parquet rows in sink, one folder a batch."""

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            engine.search(rows).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
