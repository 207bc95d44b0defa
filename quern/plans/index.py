"""The life of a stored index: collections, synchronisation, embedding, calibration, and an engine over the current snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import calibrate, maintain
from quern.operators.lexical import FIELD_WEIGHTS, LexicalIndex, build_index
from quern.operators.vector import Embedder, HashEmbedder, embedding_input
from quern.plans.engine import Engine
from quern.sources.files import GLOBS, read_texts
from quern.sources.store import Store


class Index:
    """Operations on a Store. Every one writes new snapshots and leaves the old ones readable."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, profile: str = "hash-64"):
        self.spark, self.store, self.profile = spark, Store(spark, root), profile
        self.embedder = embedder or HashEmbedder()

    def add_collection(self, name: str, root: str, globs=GLOBS) -> None:
        """Registers a collection; one of the same name is replaced."""
        new = self.spark.createDataFrame([(name, root, list(globs))], "name string, root string, globs array<string>").withColumn("created_at", F.current_timestamp())
        self.store.write(collections=maintain.upsert(self.store.read("collections"), new))

    def collections(self) -> DataFrame:
        """name, root, globs, documents; in order of name."""
        counts = self.store.read("documents").where("active").groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("documents"))
        return self.store.read("collections").join(counts, "name", "left").select("name", "root", "globs", F.coalesce("documents", F.lit(0)).alias("documents")).orderBy("name")

    def remove_collection(self, name: str) -> None:
        docs = self.store.read("documents")
        d, c, v = maintain.cascade(docs.where(F.col("collection") == name), docs, self.store.read("chunks"), self.store.read("vectors"))
        self.store.write(collections=self.store.read("collections").where(F.col("name") != name), documents=d, chunks=c, vectors=v)
        self._relex()

    def sync(self, name: str) -> dict[str, int]:
        """Brings one collection in line with its files; returns counts of added, updated, removed, unchanged and of new ids."""
        row = self.store.read("collections").where(F.col("name") == name).first()
        if row is None:
            raise ValueError(f"no such collection: {name}")
        return self.sync_documents(name, maintain.from_files(read_texts(self.spark, row["root"], row["globs"]), name))

    def sync_documents(self, name: str, found: DataFrame) -> dict[str, int]:
        """As `sync`, from documents (relpath, title, body, hash, mtime, ...) that are already at hand. Other collections stay as they are."""
        every = self.store.read("documents")
        own = every.where(F.col("collection") == name)
        changes = maintain.diff(own, found).persist()
        counts = maintain.diff_counts(changes).first().asDict()
        # new ids follow the highest of all collections
        top = every.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        fresh = found.join(changes.where("change in ('added', 'updated')").select("relpath"), "relpath", "left_semi").withColumn("doc_id", F.lit(top + 1) + F.monotonically_increasing_id())
        kept = own.join(changes.where("change in ('unchanged', 'touched')").select("relpath"), "relpath", "left_semi")
        seen = found.select("relpath", F.col("mtime").alias("_mtime"))
        kept = kept.join(seen, "relpath", "left").withColumn("mtime", F.coalesce("_mtime", "mtime")).drop("_mtime")
        gone = own.join(changes.where("change in ('removed', 'updated')").select("relpath"), "relpath", "left_semi")
        _, chunks, vectors = maintain.cascade(gone, every, self.store.read("chunks"), self.store.read("vectors"))
        documents = every.where(F.col("collection") != name).select(*every.columns).unionByName(kept.select(*every.columns)).unionByName(fresh.select(*every.columns))
        self.store.write(documents=documents, chunks=chunks, vectors=vectors)
        changes.unpersist()
        return counts

    def _relex(self) -> None:
        """Postings for documents that have none yet, none for those that are gone; the rest is kept."""
        docs = self.store.read("documents")
        lengths = self.store.read("lengths").join(docs.select("doc_id"), "doc_id", "left_semi")
        new = build_index(docs.join(lengths.select("doc_id"), "doc_id", "left_anti"), list(FIELD_WEIGHTS))
        postings = self.store.read("postings").join(docs.select("doc_id"), "doc_id", "left_semi")
        self.store.write(postings=postings.unionByName(new.postings.select(*postings.columns)), lengths=lengths.unionByName(new.lengths))

    def embed(self) -> int:
        """Chunks and embeds what is pending in any collection, embeds chunks without a vector, and returns how many vectors were made."""
        meta = self.store.meta()
        pinned = maintain.pin(meta, profile=self.profile, dim=str(self.embedder.dim))
        docs, chunks, vectors = (self.store.read(t) for t in ("documents", "chunks", "vectors"))
        top = chunks.agg(F.coalesce(F.max("chunk_id"), F.lit(-1))).first()[0]
        fresh = maintain.cut(maintain.pending(docs, chunks), top + 1)
        self.store.write(chunks=chunks.unionByName(fresh))
        chunks = self.store.read("chunks")
        bare = maintain.orphans(docs, chunks, vectors).persist()
        n = bare.count()
        made = embedding_input(bare, docs).select("chunk_id", self.embedder.documents(F.col("text")).cast("array<float>").alias("embedding"))
        self.store.write(vectors=vectors.unionByName(made))
        bare.unpersist()
        if pinned != meta:
            self.store.set_meta(**pinned)
        return n

    def index(self, names: list[str] | None = None, recalibrate: bool = True, fraction: float = 0.1) -> dict[str, int]:
        """Syncs the named collections (all), embeds all that is pending, and calibrates when enough has changed."""
        names = [r["name"] for r in self.store.read("collections").orderBy("name").toLocalIterator()] if names is None else names
        total = {"added": 0, "updated": 0, "removed": 0, "unchanged": 0}
        for name in names:
            for k, v in self.sync(name).items():
                total[k] += v
        self._relex()
        total["embedded"] = self.embed()
        meta = self.store.meta()
        changed = int(meta.get("calib_changes", "0")) + total["added"] + total["updated"] + total["removed"]
        n = self.store.read("documents").where("active").count()
        threshold = max(calibrate.LEAST_CHANGES, int(fraction * n))
        if recalibrate and n and ("truncate_floor" not in meta or changed >= threshold):
            self.store.set_meta(truncate_floor=str(self.engine().calibrate().first()["floor"]), calib_changes="0")
        else:
            self.store.set_meta(calib_changes=str(changed))
        return total

    def engine(self) -> Engine:
        docs, lengths = self.store.read("documents"), self.store.read("lengths")
        stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        try:
            floor = float(self.store.meta()["truncate_floor"])
        except (KeyError, ValueError):
            floor = None
        return Engine(docs, LexicalIndex(self.store.read("postings"), lengths, stats), self.store.read("chunks"), self.store.read("vectors"), self.embedder, floor, collections=self.store.read("collections"))
