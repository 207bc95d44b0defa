"""Batch search: a table of requests is answered in one plan, whatever mix of modes, scopes, limits and truncations it holds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import envelope, fusion, truncate
from quern.operators.lexical import CANDIDATES, RANK_DIGITS, LexicalIndex, match_snippets, search_lexical
from quern.operators.vector import OVERFETCH, Embedder, chunk_snippets, search_vector

MODES = ("hybrid", "lexical", "vector")
#: Results that a batch asks for at most, up to which their ids (16 bytes or so) are broadcast.
FEW_RESULTS = 1_000_000
#: Defaults of a request.
REQUEST = {"mode": "'hybrid'", "collections": "cast(array() as array<string>)", "limit": "10", "min_score": "cast(null as double)", "truncate": "'off'"}


@dataclass
class Engine:
    """documents (doc_id, collection, relpath, title, body, hash, active), a lexical index, chunks, vectors, and how queries are embedded."""

    documents: DataFrame
    lexical: LexicalIndex
    chunks: DataFrame
    vectors: DataFrame
    embedder: Embedder | None = None
    floor: float | None = None
    prefilter: bool = False
    collections: DataFrame | None = None
    weights: dict[str, float] | None = field(default=None)

    def requests(self, queries: DataFrame) -> DataFrame:
        """queries (qid, query, and any request columns) with defaults for what is missing or null. Raises ValueError for an unknown mode or spec."""
        for name, default in REQUEST.items():
            queries = queries.withColumn(name, F.coalesce(F.col(name), F.expr(default)) if name in queries.columns else F.expr(default))
        seen = queries.groupBy("mode", "truncate").agg(F.sum("limit").alias("rows")).collect()  # as many rows as there are settings
        for r in seen:
            if r["mode"] not in MODES:
                raise ValueError(f"no such mode: {r['mode']}")
            if r["truncate"] != "calibrated":
                truncate.Spec.parse(r["truncate"])
        self._settings = [(r["mode"], r["truncate"]) for r in seen]
        self._most = sum(r["rows"] or 0 for r in seen)
        return queries

    def _with_vectors(self, queries: DataFrame) -> DataFrame:
        if "embedding" in queries.columns:
            return queries
        if self.embedder is None:
            return queries.withColumn("embedding", F.lit(None).cast("array<double>"))
        return queries.withColumn("embedding", self.embedder.queries(F.col("query")))

    def rank(self, requests: DataFrame) -> DataFrame:
        """qid, doc_id, rank, score, sources, tier, chunk_id before any filter, at most `limit` a query."""
        modes = {m for m, _ in self._settings}
        wide = F.when(F.col("mode") == "hybrid", CANDIDATES).otherwise(F.col("limit"))
        lists = []
        none = F.lit(None)
        if modes & {"hybrid", "lexical"}:
            lex = search_lexical(self.lexical, requests.where("mode in ('hybrid', 'lexical')"), self.documents, wide, self.weights)
            lists.append(lex.select("qid", F.lit("lexical").alias("source"), "doc_id", "rank", "score", "tier", none.cast("bigint").alias("chunk_id")))
        if modes & {"hybrid", "vector"}:
            wanted = self._with_vectors(requests.where("mode in ('hybrid', 'vector')"))
            # a list of `limit` documents is taken from the nearest chunks, OVERFETCH times as many; all queries run together
            vec = search_vector(self.vectors, self.chunks, self.documents, wanted, wide, self.prefilter, wide * OVERFETCH)
            lists.append(vec.select("qid", F.lit("vector").alias("source"), "doc_id", "rank", "score", none.cast("string").alias("tier"), "chunk_id"))
        rows = lists[0]
        for more in lists[1:]:
            rows = rows.unionByName(more)
        # the first lexical result's tier weighs the whole list; a window sees it without computing the lists again
        full = (F.col("source") == "lexical") & (F.col("rank") == 1) & F.col("tier").isin("phrase", "and")
        rows = rows.withColumn("lead", F.max(F.when(full, fusion.FULL_MATCH_WEIGHT).otherwise(1.0)).over(Window.partitionBy("qid")))
        rows = rows.join(requests.select("qid", "mode", "limit"), "qid")
        worth = fusion.contribution(F.col("rank"), F.when(F.col("source") == "lexical", F.col("lead")).otherwise(1.0))
        merged = rows.groupBy("qid", "mode", "limit", "doc_id").agg(
            F.sum(worth).alias("fused"), F.max("score").alias("own"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "score")))).alias("sources"),
            F.min("rank").alias("place"), F.max("tier").alias("tier"), F.max("chunk_id").alias("chunk_id"),
        )
        # one arm keeps its own order, as tiers are not in the order of scores; both arms are in the order of what they add up to
        hybrid = F.col("mode") == "hybrid"
        order = Window.partitionBy("qid").orderBy(F.when(hybrid, F.lit(0)).otherwise(F.col("place")), F.round("fused", RANK_DIGITS).desc(), "doc_id")
        out = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("limit"))
        return out.select("qid", "mode", "doc_id", "rank", F.when(hybrid, F.col("fused")).otherwise(F.col("own")).alias("score"), "sources", "tier", "chunk_id")

    def filter(self, ranked: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """After the least score, and after truncation too."""
        after_min = truncate.min_score(ranked.join(requests.select("qid", "min_score", "truncate"), "qid"), F.col("min_score")).drop("min_score")
        parts = []
        for mode, spec in self._settings:
            rows = after_min.where((F.col("mode") == mode) & (F.col("truncate") == spec))
            parts.append(truncate.calibrated(rows, self.floor, mode) if spec == "calibrated" else truncate.truncate(rows, spec, mode))
        final = parts[0] if parts else after_min
        for p in parts[1:]:
            final = final.unionByName(p)
        return after_min, final

    def describe(self, final: DataFrame, requests: DataFrame) -> DataFrame:
        """Results with their document's fields and a snippet; titles are worked out and bodies kept for these rows only.

        The ids of a bounded batch's results travel to the documents, so no other document is shuffled."""
        found = final.select("doc_id").distinct()
        documents = self.documents.join(F.broadcast(found) if self._most <= FEW_RESULTS else found, "doc_id", "left_semi")
        rows = final.join(documents.select("doc_id", "collection", "relpath", "title", T.docid(F.col("hash")).alias("docid")), "doc_id")
        rows = match_snippets(rows, documents, requests).withColumnRenamed("snippet", "_match")
        rows = chunk_snippets(rows, self.chunks, documents)
        lexical = F.array_contains(F.map_keys("sources"), F.lit("lexical"))
        return rows.withColumn("snippet", F.when(lexical & (F.coalesce("_match", F.lit("")) != ""), F.col("_match")).otherwise(F.coalesce("snippet", F.lit("")))).drop("_match")

    def search(self, queries: DataFrame) -> DataFrame:
        """qid, rank, doc_id, collection, relpath, title, docid, score, snippet, sources, tier of every request."""
        requests = self.requests(queries)
        _, final = self.filter(self.rank(requests), requests)
        return self.describe(final, requests).select("qid", "rank", "doc_id", "collection", "relpath", "title", "docid", "score", "snippet", "sources", "tier")

    def envelopes(self, queries: DataFrame) -> DataFrame:
        """qid, envelope (JSON) of every request, unanswered ones included."""
        requests = self.requests(queries)
        raw = self.rank(requests).persist()
        after_min, final = self.filter(raw, requests)
        names = self.collections if self.collections is not None else self.documents.select(F.col("collection").alias("name")).distinct()
        n = self.documents.where("active").count()
        return envelope.envelopes(requests.drop("embedding"), raw, after_min, self.describe(final, requests), names, n, self.floor)

    def get(self, target: str, head: bool = False) -> DataFrame:
        """Documents by collection/relpath or by #docid (a prefix of the content hash; several may share it). head: the first 40 lines."""
        if target.startswith("#"):
            found = self.documents.where(F.col("hash").startswith(target[1:]))
        else:
            found = self.documents.where(F.concat_ws("/", "collection", "relpath") == target)
        body = F.array_join(F.slice(T.lines(F.col("body")), 1, 40), "\n") if head else F.col("body")
        return found.select("doc_id", "collection", "relpath", "title", T.docid(F.col("hash")).alias("docid"), body.alias("body"))

    def status(self) -> DataFrame:
        """name, value: counts of documents, chunks and vectors, and documents of each collection."""
        count = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value")
        live = self.documents.where("active")
        by = live.groupBy("collection").agg(F.count("*").alias("value")).select(F.concat(F.lit("collection:"), "collection").alias("name"), "value")
        return count(live, "documents").unionByName(count(self.chunks, "chunks")).unionByName(count(self.vectors, "vectors")).unionByName(by)

    def calibrate(self, sample: int = 200, negatives: int = 100, seed: int = 0, target: float = 0.85, reject: float = 0.9) -> DataFrame:
        """`calibrate.report` over hybrid searches of the corpus's own pseudo-queries and of made-up words: one batch."""
        from quern.operators import calibrate as C

        live = self.documents.where("active")
        spark = live.sparkSession
        pos = C.pseudo_queries(C.sample_documents(live.select("doc_id", "body"), sample, seed), seed).persist()
        neg = spark.createDataFrame(C.gibberish(negatives, seed), "qid string, query string")
        requests = self.requests(pos.select("qid", "query").unionByName(neg).withColumn("limit", F.lit(C.DEPTH)))
        results = self.rank(requests).persist()
        return C.report(C.observations(pos, neg, results), target, reject)
