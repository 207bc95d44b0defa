"""Vector retrieval: exact cosine nearest neighbours in blocks or by stored cells, documents by their best chunk, embedders."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions import text as T
from quern.operators.lexical import CANDIDATES, RANK_DIGITS, in_scope, ranked

#: Chunks fetched per wanted document, characters of a chunk's snippet.
OVERFETCH, SNIPPET_CHARS = 4, 240
#: Query vectors that travel to the tasks at once: this many numbers at most (64 MB); more queries run block by block.
BLOCK_NUMBERS = 8_000_000
#: Numbers in one product of a block of queries with vectors (32 MB).
PRODUCT_NUMBERS = 4_000_000
#: Vectors that k-means sees, cells at most, and rounds of k-means.
CELL_SAMPLE, MOST_CELLS, ROUNDS = 50_000, 1024, 8


class Embedder(Protocol):
    """Turns a text column into a normalised vector column; documents and queries may differ by a prefix."""

    dim: int

    def documents(self, text: Column) -> Column: ...

    def queries(self, text: Column) -> Column: ...


class HashEmbedder:
    """Bag-of-words vectors by md5, the same in every process; for tests and where no model is at hand."""

    def __init__(self, dim: int = 64, document_prefix: str = "", query_prefix: str = ""):
        self.dim, self.document_prefix, self.query_prefix = dim, document_prefix, query_prefix

    def documents(self, text: Column) -> Column:
        return T.hash_embedding(F.concat(F.lit(self.document_prefix), text), self.dim)

    def queries(self, text: Column) -> Column:
        return T.hash_embedding(F.concat(F.lit(self.query_prefix), text), self.dim)


class ModelEmbedder:
    """A model of the caller's: encode(list of texts) -> array of vectors, loaded once a worker by load()."""

    def __init__(self, load, dim: int, max_chars: int = 768 * 4, document_prefix: str = "", query_prefix: str = "", batch: int = 64):
        self.load, self.dim, self.max_chars, self.document_prefix, self.query_prefix, self.batch = load, dim, max_chars, document_prefix, query_prefix, batch

    def _embed(self, text: Column) -> Column:
        load, batch = self.load, self.batch

        @F.pandas_udf("array<float>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for texts in parts:
                rows: list = []
                for at in range(0, len(texts), batch):
                    v = np.asarray(encode(texts.iloc[at : at + batch].tolist()), np.float32)
                    norm = np.linalg.norm(v, axis=1, keepdims=True)
                    rows += list(v / np.where(norm == 0, 1, norm))
                yield pd.Series(rows)

        return run(F.substring(text, 1, self.max_chars))

    def documents(self, text: Column) -> Column:
        return self._embed(F.concat(F.lit(self.document_prefix), text))

    def queries(self, text: Column) -> Column:
        return self._embed(F.concat(F.lit(self.query_prefix), text))


def _merge(best: np.ndarray, ids: np.ndarray, sims: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of best/ids together with sims of the vectors `own`; ties by id. All rows at once."""
    able = (sims >= best[:, -1:]).any(axis=0)  # a vector below every row's k-th best changes nothing
    if not able.any():
        return best, ids
    s = np.concatenate([best, sims[:, able]], axis=1)
    n = np.concatenate([ids, np.broadcast_to(own[able], (len(sims), int(able.sum())))], axis=1)
    at = np.lexsort((n, -s), axis=1)[:, :k]
    return np.take_along_axis(s, at, 1), np.take_along_axis(n, at, 1)


def _usable(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of a batch (chunk_id, embedding, ...), their ids, and their rows; zero, non-finite and ill-sized ones are left out."""
    v = batch.column(1)
    rows = np.nonzero(v.value_lengths().fill_null(0).to_numpy() == dim)[0]
    x = v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    norm = np.linalg.norm(x, axis=1)
    fine = np.isfinite(norm) & (norm > 0)
    return x[fine] / norm[fine, None], batch.column(0).to_numpy()[rows[fine]], rows[fine]


def _nearest(shared, k: int, kind: pa.DataType):
    """Keeps the k best per query over a task's batches. Batches may carry a cell; queries that cannot gain from a cell skip it."""

    def run(batches):
        qids, q, least, reach = shared.value
        best, ids = np.full((len(qids), k), -np.inf), np.full((len(qids), k), np.iinfo(np.int64).max)
        step = max(1, PRODUCT_NUMBERS // max(1, len(qids)))

        def meet(x, own, some):
            for at in range(0, len(x), step):
                sims = np.round(q[some] @ x[at : at + step].T, RANK_DIGITS)
                best[some], ids[some] = _merge(best[some], ids[some], sims, own[at : at + step], k)

        for batch in batches:
            x, own, rows = _usable(batch, q.shape[1])
            if reach is None:
                meet(x, own, slice(None))
                continue
            cells = batch.column(2).to_numpy()[rows]
            for c in np.unique(cells):
                inside = cells == c
                some = np.nonzero(reach[:, c] >= np.maximum(least, best[:, -1]) - 1e-8)[0]
                if len(some):
                    meet(x[inside], own[inside], some)
        for i, qid in enumerate(qids):
            have = np.isfinite(best[i])
            if have.any():
                yield pa.RecordBatch.from_arrays([pa.array([qid] * int(have.sum()), kind), pa.array(ids[i][have], pa.int64()), pa.array(best[i][have])], ["qid", "chunk_id", "score"])

    return run


def _blocks(queries: DataFrame, k: int, more: int = 0) -> Iterator[tuple[list, np.ndarray]]:
    """qids and unit vectors of the queries (qid, embedding), block by block; only one block is held at a time.

    A block's vectors, its k best and `more` numbers a query stay within BLOCK_NUMBERS."""
    ids, rows, size = [], [], queries.agg(F.max(F.size("embedding"))).first()[0] or 0
    step = max(1, BLOCK_NUMBERS // (size + 2 * k + more + 1))
    for r in queries.select("qid", "embedding").where(F.size("embedding") == size).toLocalIterator():
        v = np.asarray(r.embedding, np.float64)
        norm = np.linalg.norm(v)
        if size and np.isfinite(norm) and norm > 0:
            ids.append(r.qid)
            rows.append(v / norm)
        if len(ids) == step:
            yield ids, np.stack(rows)
            ids, rows = [], []
    if ids:
        yield ids, np.stack(rows)


def _union(parts: list[DataFrame], spark, kind: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], f"qid {kind}, chunk_id long, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _top(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(ranked("score", "qid", tie="chunk_id"))).where(F.col("rank") <= k)


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, chunk_id, score, rank: the k nearest vectors (chunk_id, embedding) of each query (qid, embedding), exact, by cosine.

    The batch of queries, a bounded block at a time, goes to every task; each task multiplies its vectors with the block, in
    steps of bounded size, and keeps k per query, so a shuffle sees k rows per query and task, never all pairs. Zero vectors,
    null vectors and vectors of another length are nobody's neighbours.
    """
    spark, kind, arrow = vectors.sparkSession, dict(queries.dtypes)["qid"], to_arrow_type(queries.schema["qid"].dataType)
    rows = vectors.select(F.col("chunk_id").cast("long"), "embedding")
    parts = []
    for qids, q in _blocks(queries, k):
        shared = spark.sparkContext.broadcast((qids, q, None, None))
        parts.append(rows.mapInArrow(_nearest(shared, k, arrow), f"qid {kind}, chunk_id long, score double"))
    return _top(_union(parts, spark, kind), k)


@dataclass(frozen=True)
class Cells:
    """vectors(chunk_id, embedding, cell), in order of cell, and for every cell its centre (a unit vector) and its angle to the farthest member."""

    vectors: DataFrame
    centres: np.ndarray
    angles: np.ndarray


def build_cells(vectors: DataFrame, cells: int | None = None, seed: int = 7) -> Cells:
    """Every usable vector under its nearest centre, for `knn_cells`; to be stored or persisted by the caller.

    Centres come from k-means over at most CELL_SAMPLE vectors, chosen by hash of their ids; all vectors are put in a cell.
    cells: about the square root of the number of vectors, MOST_CELLS at most. Vectors of another length than the longest,
    zero and non-finite ones are left out: they are nobody's neighbours.
    """
    n, size = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    cells = cells or max(1, min(MOST_CELLS, int(n**0.5)))
    pick = vectors.select(F.col("chunk_id").cast("long"), "embedding").where(F.size("embedding") == size)
    drawn = pick.where(F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(max(1, -(-2 * n // CELL_SAMPLE)))) == 0).limit(CELL_SAMPLE).toArrow()
    sample = np.concatenate([_usable(b, size)[0] for b in drawn.to_batches()]) if drawn.num_rows else np.zeros((0, size))
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]] if len(sample) else np.zeros((1, size))
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(axis=1) if len(sample) else np.zeros(0, int)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.where(norm > 1e-12, norm, 1), centres)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def place(batches):
        c = shared.value
        for batch in batches:
            x, own, rows = _usable(batch, size)
            sims = x @ c.T
            cell = sims.argmax(axis=1) if len(x) else np.zeros(0, int)
            angle = np.arccos(np.clip(sims[np.arange(len(x)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), batch.column(1).take(pa.array(rows)), pa.array(cell, pa.int32()), pa.array(angle)], ["chunk_id", "embedding", "cell", "angle"])

    kind = dict(vectors.dtypes)["embedding"]
    placed = pick.mapInArrow(place, f"chunk_id long, embedding {kind}, cell int, angle double")
    angles = np.full(len(centres), -1.0)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("angle")).toLocalIterator():  # a row a cell
        angles[r.cell] = r.angle
    return Cells(placed.drop("angle").repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell"), centres, angles)


def knn_cells(index: Cells, queries: DataFrame, k: int) -> DataFrame:
    """As `knn`, over vectors kept in cells; exact.

    The first pass reads each query's nearest cell only; its k-th best there is a floor. No member of a cell is nearer to the query
    than the angle to its centre less the cell's own angle, so the second pass skips every cell that cannot reach the floor.
    Vectors that gather in clusters skip most cells; vectors spread evenly skip few, and then this is `knn` with two passes.
    """
    spark, kind, arrow = index.vectors.sparkSession, dict(queries.dtypes)["qid"], to_arrow_type(queries.schema["qid"].dataType)
    schema, live = f"qid {kind}, chunk_id long, score double", index.angles >= 0
    parts = []
    for qids, q in _blocks(queries, k, 3 * len(index.centres)) if live.any() else ():
        if q.shape[1] != index.centres.shape[1]:
            continue
        away = np.arccos(np.clip(q @ index.centres.T, -1, 1))
        reach = np.where(live, np.cos(np.maximum(away - index.angles, 0)), -np.inf)
        home = np.where(live, away, np.inf).argmin(axis=1)
        only = np.full_like(reach, -np.inf)
        only[np.arange(len(q)), home] = 1
        visit = lambda rows, least, can: rows.mapInArrow(_nearest(spark.sparkContext.broadcast((qids, q, least, can)), k, arrow), schema)  # noqa: B023, E731
        first = visit(index.vectors.where(F.col("cell").isin([int(c) for c in np.unique(home)])), np.full(len(q), -2.0), only)
        floor = {r.qid: r.score for r in _top(first, k).where(F.col("rank") == k).select("qid", "score").toLocalIterator()}
        least = np.array([floor.get(i, -2.0) for i in qids])
        parts.append(visit(index.vectors, least, reach))
    return _top(_union(parts, spark, kind), k)


def search_vector(vectors: DataFrame, chunks: DataFrame, documents: DataFrame, queries: DataFrame, limit: int | Column = CANDIDATES, prefilter: bool = False, fetch: int | Column = CANDIDATES * OVERFETCH) -> DataFrame:
    """qid, doc_id, rank, score, chunk_id: documents by their best chunk among the `fetch` nearest; queries (qid, embedding, collections).

    As specified, a scope filters after the nearest chunks are found, so a scoped query may come back short; `prefilter=True`
    searches inside each scope instead. The nearest chunks are few, so they are joined before anything else is read.
    limit and fetch may be columns of queries: all queries run together, each list is then cut to its own length.
    """
    most = fetch
    if isinstance(fetch, Column):
        most = queries.agg(F.max(fetch)).first()[0] or 1
    if prefilter and "collections" in queries.columns:
        scopes = [list(r.collections or []) for r in queries.select(F.sort_array("collections").alias("collections")).distinct().toLocalIterator()]
        found = None
        for scope in scopes:
            own = queries.where(F.sort_array(F.coalesce("collections", F.array().cast("array<string>"))) == F.array(*map(F.lit, sorted(scope))).cast("array<string>"))
            inside = documents.where(F.col("collection").isin(scope)) if scope else documents
            some = knn(vectors.join(chunks.join(inside.select("doc_id"), "doc_id", "left_semi").select("chunk_id"), "chunk_id", "left_semi"), own, most)
            found = some if found is None else found.unionByName(some)
    else:
        found = knn(vectors, queries, most)
    if isinstance(fetch, Column):
        found = found.join(queries.select("qid", fetch.alias("_fetch")), "qid").where(F.col("rank") <= F.col("_fetch")).drop("_fetch")
    met = in_scope(found.drop("rank").join(chunks.select("chunk_id", "doc_id"), "chunk_id"), queries, documents)
    best = met.groupBy("qid", "doc_id").agg(F.max_by(F.struct("score", "chunk_id"), F.struct(F.round("score", RANK_DIGITS), -F.col("chunk_id"))).alias("m")).select("qid", "doc_id", "m.score", "m.chunk_id")
    rows = best.withColumn("rank", F.row_number().over(ranked("score", "qid")))
    if isinstance(limit, Column):
        rows = rows.join(queries.select("qid", limit.alias("_limit")), "qid")
        limit = F.col("_limit")
    return rows.where(F.col("rank") <= limit).select("qid", "doc_id", "rank", "score", "chunk_id")


def chunk_snippets(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """hits (qid, doc_id, chunk_id, ...) with the start of the chunk, white space collapsed."""
    rows = hits.join(chunks.select("chunk_id", "pos", "length"), "chunk_id", "left").join(documents.select("doc_id", F.col("body").alias("_body")), "doc_id", "left")
    return rows.withColumn("snippet", T.collapse(F.substring(F.col("_body"), F.col("pos") + 1, F.least(F.col("length"), F.lit(SNIPPET_CHARS))))).drop("pos", "length", "_body")


def embedding_input(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunk_id, text: every chunk's text after its document's title, where it has one."""
    rows = chunks.join(documents.select("doc_id", "title", "body"), "doc_id")
    part = F.substring(F.col("body"), F.col("pos") + 1, F.col("length"))
    return rows.select("chunk_id", F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.col("title"), F.lit("\n"), part)).otherwise(part).alias("text"))
