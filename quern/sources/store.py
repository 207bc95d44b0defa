"""A saved index: documents, chunks, vectors, postings, lengths, collections and meta as Parquet, snapshot by snapshot.

Every table has numbered snapshots and a writer makes a new one, so what is being read is never overwritten. The pointer file
names the current snapshot and is written last.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quern.operators.vector import Cells

SCHEMAS = {
    "collections": "name string, root string, globs array<string>, created_at timestamp",
    "documents": "doc_id bigint, collection string, relpath string, title string, body string, hash string, mtime double, active boolean",
    "chunks": "chunk_id bigint, doc_id bigint, seq int, pos int, length int",
    "vectors": "chunk_id bigint, embedding array<float>",
    "postings": "term string, field string, doc_id bigint, tf bigint, positions array<int>",
    "lengths": "doc_id bigint, dl bigint",
    "meta": "key string, value string",
}


class Store:
    """Tables of an index below one folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path("current.json").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> dict[str, int]:
        """table -> number of its current snapshot."""
        if not self._fs().exists(self._path("current.json")):
            return {}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/current.json").toLocalIterator()))

    def read(self, table: str) -> DataFrame:
        """The table's current snapshot; no rows where there is none."""
        n = self.current().get(table)
        if n is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{table}/{n}")

    def write(self, **tables: DataFrame) -> None:
        """New snapshots of the named tables, made current together. Postings are sorted by term, so a lookup skips row groups."""
        now = self.current()
        new = dict(now)
        for name, df in tables.items():
            new[name] = now.get(name, 0) + 1
            df = df.to(self.spark.createDataFrame([], SCHEMAS[name]).schema)
            if name == "postings":
                df = df.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
            writer = df.write.mode("overwrite")
            (writer.partitionBy("collection") if name == "documents" else writer).parquet(f"{self.root}/{name}/{new[name]}")
        out = self._fs().create(self._path("current.json"), True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()

    def meta(self) -> dict[str, str]:
        return {r.key: r.value for r in self.read("meta").toLocalIterator()}

    def set_meta(self, **values: str) -> None:
        rows = {**self.meta(), **values}
        self.write(meta=self.spark.createDataFrame(list(rows.items()), SCHEMAS["meta"]))

    def vacuum(self) -> None:
        """Deletes the snapshots that are not current."""
        now = self.current()
        for table in SCHEMAS:
            if self._fs().exists(self._path(table)):
                for s in self._fs().listStatus(self._path(table)):
                    if s.getPath().getName() != str(now.get(table)):
                        self._fs().delete(s.getPath(), True)


def write_cells(index: Cells, path: str) -> None:
    """Keeps an index of `build_cells`: its vectors in order of cell, so a lookup skips row groups, and a row per cell."""
    index.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    rows = [(c, [float(v) for v in centre], float(angle)) for c, (centre, angle) in enumerate(zip(index.centres, index.angles, strict=True))]
    index.vectors.sparkSession.createDataFrame(rows, "cell int, centre array<double>, angle double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def read_cells(spark: SparkSession, path: str) -> Cells:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # MOST_CELLS at most
    return Cells(spark.read.parquet(f"{path}/vectors"), np.array([r.centre for r in rows]), np.array([r.angle for r in rows]))
