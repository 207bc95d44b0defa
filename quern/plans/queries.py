"""The registered queries: one per operator, over whole tables, and DuckDB SQL for the same rows.

Tables stand in for an index: a document's collection is its language, its path is source/doc_id.txt; vector v is a chunk of
document v div 2; the questions are the passages of `benchmark`, each with the vector of its own number; labels are judgments.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import chunking
from quern.functions import text as T
from quern.operators import calibrate, envelope, evaluate, fusion, maintain, querygen, scan, truncate
from quern.operators import lexical as L
from quern.operators import vector as V
from quern.plans.engine import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_cache: dict[tuple, object] = {}


def _register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _once(make):
    """The same frames for all queries of a session and folder; persisted ones are computed again if an executor is lost."""

    def run(spark: SparkSession, sf: str):
        key = (make.__name__, spark.sparkContext.applicationId, sf)
        if key not in _cache:
            _cache[key] = make(spark, sf)
        return _cache[key]

    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    rel = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", F.col("lang").alias("collection"), rel.alias("relpath"), T.title(F.col("text"), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body"), T.content_hash(F.col("text")).alias("hash"), F.lit(True).alias("active"))


@_once
def indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as indexed: where a scope is asked of the same frame, the index's own scan knows it."""
    return documents(spark, sf)


@_once
def body_index(spark: SparkSession, sf: str) -> L.LexicalIndex:
    x = L.build_index(indexed(spark, sf), ["body"])
    return replace(x, postings=x.postings.persist(), lengths=x.lengths.persist())


@_once
def field_index(spark: SparkSession, sf: str) -> L.LexicalIndex:
    x = L.build_index(indexed(spark, sf), ["title", "body", "relpath"])
    return replace(x, postings=x.postings.persist(), lengths=x.lengths.persist())


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 2).alias("doc_id"), (F.col("vec_id") % 2).cast("int").alias("seq"), F.lit(0).alias("pos"), F.lit(1800).alias("length"))


def question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    return questions(spark, sf).join(own, "qid").withColumn("collections", F.array().cast("array<string>"))


@_once
def lexical_lists(spark: SparkSession, sf: str) -> DataFrame:
    return L.search_lexical(body_index(spark, sf), questions(spark, sf), limit=50, weights={"body": 1.0}).persist()


@_once
def vector_lists(spark: SparkSession, sf: str) -> DataFrame:
    return V.search_vector(vectors(spark, sf), chunk_table(spark, sf), documents(spark, sf), question_vectors(spark, sf)).persist()


@_once
def hybrid_lists(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.hybrid(lexical_lists(spark, sf), vector_lists(spark, sf), 20).persist()


def r6(c: str):
    return F.round(c, 6).alias(c)


# --------------------------------------------------------------------------------------------------------------- SQL parts

TOKENS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
LEX = rf"""
tk AS (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM tk),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tk) GROUP BY ALL),
df AS (SELECT term, count(*) AS ni FROM post GROUP BY term),
q AS (SELECT item_id AS qid, text AS query, {TOKENS.format("text")} AS t FROM benchmark),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(t) AS term FROM q) GROUP BY ALL),
need AS (SELECT qid, sum(times) AS needed FROM qt GROUP BY qid),
part AS (
  SELECT qid, doc_id, sum(times * CASE WHEN ln((n - ni + 0.5) / (ni + 0.5)) > 0 THEN ln((n - ni + 0.5) / (ni + 0.5)) ELSE 1e-6 END
           * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tk.t) / avgdl))) AS raw, sum(times) AS matched
  FROM qt JOIN post USING (term) JOIN df USING (term) JOIN tk USING (doc_id) CROSS JOIN st GROUP BY qid, doc_id)"""
TIERS = rf"""{LEX},
ws AS (SELECT doc_id, len(t) AS dl, list_aggregate(list_transform(t, lambda x: ' ' || x || ' '), 'string_agg', '') AS s FROM tk),
qs AS (SELECT qid, list_aggregate(list_transform(t, lambda x: ' ' || x || ' '), 'string_agg', '') AS p FROM q WHERE len(t) > 1),
wtf AS (SELECT qid, doc_id, dl, ((length(s) - length(replace(s, p, ''))) / length(p))::DOUBLE AS tf FROM qs JOIN ws ON contains(s, p)),
wdf AS (SELECT qid, count(*) AS ni FROM wtf GROUP BY qid),
whole AS (
  SELECT qid, doc_id, CASE WHEN ln((n - ni + 0.5) / (ni + 0.5)) > 0 THEN ln((n - ni + 0.5) / (ni + 0.5)) ELSE 1e-6 END
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS raw FROM wtf JOIN wdf USING (qid) CROSS JOIN st),
tiered AS (
  SELECT part.qid, part.doc_id, CASE WHEN whole.raw IS NOT NULL THEN 0 WHEN matched = needed THEN 1 ELSE 2 END AS t, coalesce(whole.raw, part.raw) AS raw
  FROM part JOIN need USING (qid) LEFT JOIN whole ON whole.qid = part.qid AND whole.doc_id = part.doc_id),
lexl AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY t, round(score, 9) DESC, doc_id) AS rank
  FROM (SELECT qid, doc_id, t, CASE WHEN raw > 0 THEN raw / (1 + raw) ELSE 0.0 END AS score FROM tiered)
  QUALIFY rank <= 50)"""
KNN = """
kn AS (
  SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT a.vec_id AS qid, b.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
        FROM embeddings a CROSS JOIN embeddings b WHERE {queries})
  QUALIFY rank <= {k})"""
VEC = (
    KNN.format(queries="a.vec_id IN (SELECT item_id FROM benchmark)", k=200)
    + """,
vecl AS (
  SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT qid, d.doc_id, max(score) AS score FROM kn JOIN documents d ON d.doc_id = kn.chunk_id // 2 GROUP BY qid, d.doc_id) QUALIFY rank <= 50)"""
)
HYB = f"""{TIERS}, {VEC},
lead AS (SELECT qid, CASE WHEN t < 2 THEN 2.0 ELSE 1.0 END AS w FROM lexl WHERE rank = 1),
contrib AS (
  SELECT qid, doc_id, 'lexical' AS source, score, w / (60 + rank) + CASE rank WHEN 1 THEN 0.05 WHEN 2 THEN 0.02 WHEN 3 THEN 0.02 ELSE 0 END AS c FROM lexl JOIN lead USING (qid)
  UNION ALL
  SELECT qid, doc_id, 'vector', score, 1.0 / (60 + rank) + CASE rank WHEN 1 THEN 0.05 WHEN 2 THEN 0.02 WHEN 3 THEN 0.02 ELSE 0 END FROM vecl),
fused AS (SELECT qid, doc_id, sum(c) AS score, max(score) FILTER (source = 'lexical') AS lex, max(score) FILTER (source = 'vector') AS vec FROM contrib GROUP BY qid, doc_id),
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fused QUALIFY rank <= 20)"""
SHOW = "SELECT qid, rank::BIGINT AS rank, doc_id, round(score, 6) AS score FROM"
KNEE = """
kp AS (SELECT *, count(*) OVER w AS n, first_value(score) OVER (w ORDER BY rank) AS y0, last_value(score) OVER (w ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS yn,
         row_number() OVER (w ORDER BY rank) AS p FROM {of} WINDOW w AS (PARTITION BY qid)),
kd AS (SELECT *, y0 + (yn - y0) * ((p - 1) / (n - 1)) - score AS d FROM kp WHERE p > 1 AND p < n),
kc AS (SELECT qid, arg_max(p - 1, (d, -p)) AS cut FROM kd WHERE d > -1 GROUP BY qid),
knee AS (SELECT kp.* FROM kp LEFT JOIN kc USING (qid) WHERE n < 4 OR y0 - yn <= 0 OR p <= coalesce(cut, 1))"""
JUDGED = "j AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'noise' WHEN quality = 1 THEN 'relevant' ELSE 'related' END AS label FROM labels)"


def show(df: DataFrame) -> DataFrame:
    return df.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", r6("score"))


def judgments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "noise").when(F.col("quality") == 1, "relevant").otherwise("related").alias("label"))


# ------------------------------------------------------------------------------------------------------- scans and columns


@_register("SELECT doc_id, lang AS collection, source || '/' || doc_id || '.txt' AS relpath FROM documents WHERE lang IN ('en', 'fr')")
def scan_scope_filter(spark, sf):
    return documents(spark, sf).where("active").where(F.col("collection").isin("en", "fr")).select("doc_id", "collection", "relpath")


@_register("WITH c AS (SELECT item_id AS qid, unnest(['en', 'zz', 'item' || item_id]) AS name FROM benchmark), m AS (SELECT qid, name FROM c ANTI JOIN documents d ON d.lang = c.name) SELECT b.item_id AS qid, coalesce(list_sort(list(m.name) FILTER (m.name IS NOT NULL)), []) AS unknown FROM benchmark b LEFT JOIN m ON m.qid = b.item_id GROUP BY b.item_id")
def unknown_collections(spark, sf):
    asked = questions(spark, sf).withColumn("collections", F.array(F.lit("en"), F.lit("zz"), F.concat(F.lit("item"), F.col("qid").cast("string"))))
    return envelope.unknown_collections(asked, documents(spark, sf).select(F.col("collection").alias("name")).distinct())


@_register("SELECT 'documents' AS name, count(*) AS value FROM documents UNION ALL SELECT 'chunks', count(*) FROM embeddings UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'collection:' || lang, count(*) FROM documents GROUP BY lang")
def status_counts(spark, sf):
    return Engine(documents(spark, sf), body_index(spark, sf), chunk_table(spark, sf), vectors(spark, sf)).status()


@_register("SELECT doc_id, lang AS collection, source || '/' || doc_id || '.txt' AS relpath, sha256(text)[:6] AS docid FROM documents WHERE sha256(text)[:6] IN (SELECT sha256(text)[:6] FROM documents GROUP BY 1 HAVING count(*) > 1)")
def get_by_docid(spark, sf):
    d = documents(spark, sf).withColumn("docid", T.docid(F.col("hash")))
    shared = d.groupBy("docid").agg(F.count("*").alias("n")).where("n > 1")
    return d.join(shared, "docid", "left_semi").select("doc_id", "collection", "relpath", "docid")


@_register(r"SELECT doc_id, array_to_string((CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END)[:40], chr(10)) AS head FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents)")
def get_head(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(F.slice(T.lines(F.col("body")), 1, 40), "\n").alias("head"))


@_register("SELECT doc_id, trim(regexp_replace(substr(text, 1, 240), '\\s+', ' ', 'g')) AS snippet FROM documents")
def chunk_snippet(spark, sf):
    d = documents(spark, sf)
    return V.chunk_snippets(d.select("doc_id", F.col("doc_id").alias("chunk_id")), d.select(F.col("doc_id").alias("chunk_id"), F.lit(0).alias("pos"), F.length("body").alias("length")), d).select("doc_id", "snippet")


@_register(r"""SELECT doc_id, NOT contains(text, chr(0)) AND len(l) > 0 AND len(list_filter(l, lambda x: length(x) > 40 AND NOT contains(x, ' '))) <= 0.25 * len(l) AS is_text
FROM (SELECT doc_id, text, list_transform(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END, lambda x: trim(x, ' ' || chr(9))) AS l FROM (SELECT doc_id, text, string_split_regex(text, '\r\n|[\n\r\x0b\x0c]') AS l FROM documents))""")
def text_document_filter(spark, sf):
    return documents(spark, sf).select("doc_id", T.is_text_document(F.col("body")).alias("is_text"))


@_register(r"""SELECT doc_id, CASE WHEN h <> '' THEN h ELSE coalesce(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c]'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '')[1][:120], doc_id::VARCHAR) END AS title
FROM (SELECT doc_id, text, regexp_extract(substr(text, 1, 4000), '(?m)^#{1,6}\s+(.+?)\s*$', 1) AS h FROM documents)""")
def title_extract(spark, sf):
    return documents(spark, sf).select("doc_id", "title")


@_register("SELECT doc_id, sha256(text) AS hash, sha256(text)[:6] AS docid FROM documents")
def docid_hash(spark, sf):
    return documents(spark, sf).select("doc_id", "hash", T.docid(F.col("hash")).alias("docid"))


@_register(r"SELECT item_id AS qid, regexp_extract_all(text, '[\p{L}\p{N}_'']+') AS tokens, regexp_extract_all(text, '\"([^\"]+)\"', 1) AS phrases FROM benchmark".replace('\\"', '"'))
def query_tokens(spark, sf):
    return questions(spark, sf).select("qid", T.query_tokens(F.col("query")).alias("tokens"), T.quoted_phrases(F.col("query")).alias("phrases"))


STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS)
WORDS_SQL = rf"list_filter(list_transform(regexp_extract_all({{}}, '[A-Za-z][A-Za-z0-9_''\-]{{{{2,}}}}'), lambda x: lower(x)), lambda w: length(w) > 3 AND NOT list_contains([{STOP_SQL}], w))".replace("{{{{", "{{").replace("}}}}", "}}")


@_register(f"SELECT doc_id, {WORDS_SQL.format('text')} AS words FROM documents")
def content_words(spark, sf):
    return documents(spark, sf).select("doc_id", T.content_words(F.col("body")).alias("words"))


SLUG_SQL = r"trim(regexp_replace({}, '[^\p{{L}}\p{{N}}$]+', '-', 'g'), '-')"
ENDING_SQL = r"'\.[A-Za-z0-9]+$'"


@_register(f"""SELECT page_id, path, array_to_string(list_filter(list_transform(parts, lambda x, i: CASE WHEN i < len(parts) THEN {SLUG_SQL.format('x')}
  ELSE {SLUG_SQL.format(f"regexp_replace(x, {ENDING_SQL}, '')")} || regexp_extract(x, {ENDING_SQL}) END), lambda x: x <> ''), '/') AS slug
FROM (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages))""")
def path_slugs(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return p.select("page_id", "path", T.slug_path(F.col("path")).alias("slug"))


# ------------------------------------------------------------------------------------------------------- lexical retrieval


@_register(f"WITH {LEX} SELECT term, doc_id, tf FROM post")
def tokenize_postings(spark, sf):
    return body_index(spark, sf).postings.select("term", "doc_id", "tf")


@_register(f"SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct({WORDS_SQL.format('text')})) AS word FROM documents) GROUP BY word")
def df_table(spark, sf):
    return querygen.document_frequency(documents(spark, sf))


@_register(f"WITH {LEX} SELECT n::BIGINT AS n, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark, sf):
    return body_index(spark, sf).stats.select("n", r6("avgdl"))


TOP10 = "rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT qid, doc_id, raw / (1 + raw) AS score FROM {}) QUALIFY rank <= 10)"


def _top(index: L.LexicalIndex, spark, sf, weights: dict[str, float], how: str = "or", k: int = 10) -> DataFrame:
    q = questions(spark, sf)
    return show(L.top(index, q, L.query_phrases(q), k, weights, how=how))


@_register(f"WITH {LEX} SELECT qid, doc_id, round(score, 6) AS score, {TOP10.format('part')}")
def bm25_or(spark, sf):
    return _top(body_index(spark, sf), spark, sf, {"body": 1.0})


@_register(f"WITH {LEX} SELECT qid, doc_id, round(score, 6) AS score, {TOP10.format('(SELECT * FROM part JOIN need USING (qid) WHERE matched = needed)')}")
def bm25_and(spark, sf):
    return _top(body_index(spark, sf), spark, sf, {"body": 1.0}, "and")


@_register(f"WITH {TIERS} SELECT qid, doc_id, round(tf, 0)::BIGINT AS tf FROM wtf")
def phrase_match(spark, sf):
    p = L.query_phrases(questions(spark, sf)).where("role = 'whole'")
    return L.phrase_frequencies(body_index(spark, sf), p).join(F.broadcast(p.select("qid", L.phrase_key().alias("phrase"))), "phrase").select("qid", "doc_id", "tf")


@_register(f"WITH {TIERS} SELECT qid, rank::BIGINT AS rank, doc_id, round(score, 6) AS score, ['phrase', 'and', 'or'][t + 1] AS tier FROM lexl")
def lexical_tiered(spark, sf):
    return lexical_lists(spark, sf).select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", r6("score"), "tier")


@_register(rf"""WITH f AS (SELECT doc_id, {TOKENS.format("text")} AS body, {TOKENS.format("source || '/' || doc_id || '.txt'")} AS relpath,
  {TOKENS.format("coalesce(list_filter(list_transform(string_split_regex(text, '[\n\r]+'), lambda x: trim(x)), lambda x: x <> '')[1][:120], doc_id::VARCHAR)")} AS title FROM documents),
dl AS (SELECT doc_id, len(body) + len(relpath) + len(title) AS dl FROM f), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
post AS (SELECT doc_id, term, sum(w) AS f FROM (SELECT doc_id, unnest(title) AS term, 4.0 AS w FROM f UNION ALL SELECT doc_id, unnest(body), 1.0 FROM f UNION ALL SELECT doc_id, unnest(relpath), 2.0 FROM f) GROUP BY ALL),
df AS (SELECT term, count(*) AS ni FROM post GROUP BY term),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
part AS (SELECT qid, doc_id, sum(times * CASE WHEN ln((n - ni + 0.5) / (ni + 0.5)) > 0 THEN ln((n - ni + 0.5) / (ni + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS raw
  FROM qt JOIN post USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY qid, doc_id)
SELECT qid, doc_id, round(score, 6) AS score, {TOP10.format("part")}""")
def bm25_fields(spark, sf):
    return _top(field_index(spark, sf), spark, sf, L.FIELD_WEIGHTS)


@_register()
def bm25_porter(spark, sf):
    index = L.build_index(documents(spark, sf).select("doc_id", "body"), ["body"], porter=True)
    return show(L.search_lexical(index, questions(spark, sf), limit=10, weights={"body": 1.0}))


@_register()
def snippet_match(spark, sf):
    return L.match_snippets(lexical_lists(spark, sf).where("rank <= 10").select("qid", "doc_id", "rank"), documents(spark, sf), questions(spark, sf))


# ------------------------------------------------------------------------------------------------- chunks and vectors


@_register(r"""WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE regexp_matches(text, '\S')),
step(doc_id, seq, pos, fin) AS (
  SELECT doc_id, -1, -1, 0 FROM t
  UNION ALL
  SELECT doc_id, seq + 1, s, CASE WHEN s + 1800 >= n THEN n WHEN contains(sub, chr(10)) THEN lo + length(sub) - instr(reverse(sub), chr(10))
      WHEN instr(substr(text, s + 1802), chr(10)) > 0 THEN s + 1800 + instr(substr(text, s + 1802), chr(10)) ELSE n END
  FROM (SELECT *, substr(text, lo + 1, s + 1801 - lo) AS sub FROM (
    SELECT step.doc_id, seq, text, n, s, greatest(s + 271, s + 1200) AS lo FROM (
      SELECT *, CASE WHEN seq < 0 THEN 0 ELSE greatest(fin - 270, pos + 1) END AS s FROM step) step JOIN t ON t.doc_id = step.doc_id WHERE seq < 0 OR fin < n)))
SELECT doc_id, seq, pos, fin - pos AS length FROM step WHERE seq >= 0""")
def chunk_offsets(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.explode(chunking.chunks(F.col("body"))).alias("c"))
    return rows.select("doc_id", "c.seq", "c.pos", "c.length")


@_register(f"WITH {KNN.format(queries='a.vec_id % 20 = 0', k=10)} SELECT qid, chunk_id, round(score, 6) AS score, rank::BIGINT AS rank FROM kn")
def knn_exact(spark, sf):
    e = vectors(spark, sf)
    return V.knn(e, e.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "qid"), 10).select("qid", "chunk_id", r6("score"), F.col("rank").cast("long").alias("rank"))


@_once
def vector_cells(spark: SparkSession, sf: str) -> V.Cells:
    x = V.build_cells(vectors(spark, sf))
    return V.Cells(x.vectors.persist(), x.centres, x.angles)


@_register(SQL["knn_exact"])
def knn_cells(spark, sf):
    found = V.knn_cells(vector_cells(spark, sf), vectors(spark, sf).where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "qid"), 10)
    return found.select("qid", "chunk_id", r6("score"), F.col("rank").cast("long").alias("rank"))


@_register(f"WITH {VEC} {SHOW} vecl")
def vector_docs(spark, sf):
    return show(vector_lists(spark, sf))


@_register(f"""WITH {KNN.format(queries="a.vec_id IN (SELECT item_id FROM benchmark)", k=200)},
v AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT qid, d.doc_id, max(score) AS score FROM kn JOIN documents d ON d.doc_id = kn.chunk_id // 2 WHERE d.lang = ['en', 'fr', 'de', 'es'][qid % 4 + 1] GROUP BY qid, d.doc_id) QUALIFY rank <= 50) {SHOW} v""")
def vector_scoped_postfilter(spark, sf):
    own = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("qid") % 4).cast("int") + 1)
    return show(V.search_vector(vectors(spark, sf), chunk_table(spark, sf), documents(spark, sf), question_vectors(spark, sf).withColumn("collections", F.array(own))))


@_register(r"""SELECT doc_id, k::INTEGER AS place, round(coalesce(c, 0) / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) AS value FROM (
  SELECT doc_id, k, c, sqrt(sum(coalesce(c, 0) ** 2) OVER (PARTITION BY doc_id)) AS norm FROM (SELECT doc_id, unnest(range(64)) AS k FROM documents) LEFT JOIN (
    SELECT doc_id, k, count(*)::DOUBLE AS c FROM (SELECT doc_id, ('0x' || md5(w)[:8])::BIGINT % 64 AS k FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents) WHERE w <> '') GROUP BY ALL) USING (doc_id, k))""")
def hash_embed(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(T.hash_embedding(F.col("body"))).alias("place", "value")).select("doc_id", "place", r6("value"))


@_register("SELECT vec_id, generate_subscripts(e, 1)::INTEGER - 1 AS place, round(unnest(list_transform(e, lambda x: x / norm)), 6) AS value FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))")
def l2_normalize(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(T.normalise(F.col("embedding"))).alias("place", "value")).select("vec_id", "place", r6("value"))


# -------------------------------------------------------------------------------------------------- fusion and truncation


@_register(f"WITH {HYB} {SHOW} h")
def rrf_fuse(spark, sf):
    return show(hybrid_lists(spark, sf))


@_register(f"WITH {HYB} SELECT qid, rank::BIGINT AS rank, doc_id, round(score, 6) AS score, round(lex, 6) AS lexical, round(vec, 6) AS vector FROM h WHERE rank <= 10")
def hybrid_search(spark, sf):
    req = question_vectors(spark, sf)
    e = Engine(indexed(spark, sf), body_index(spark, sf), chunk_table(spark, sf), vectors(spark, sf), weights={"body": 1.0})
    rows = e.rank(e.requests(req))
    arm = lambda a: F.round(F.try_element_at("sources", F.lit(a)), 6).alias(a)
    return rows.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", r6("score"), arm("lexical"), arm("vector"))


@_register(f"WITH {HYB} {SHOW} h WHERE score >= 0.04")
def min_score(spark, sf):
    return show(truncate.min_score(hybrid_lists(spark, sf), 0.04))


@_register(f"WITH {HYB} {SHOW} h WHERE score >= 0.03")
def trunc_abs(spark, sf):
    return show(truncate.truncate(hybrid_lists(spark, sf), "abs:0.03"))


@_register(f"WITH {HYB} {SHOW} (SELECT *, first_value(score) OVER (PARTITION BY qid ORDER BY rank) AS y0 FROM h) WHERE score >= 0.3 * y0")
def trunc_ratio(spark, sf):
    return show(truncate.truncate(hybrid_lists(spark, sf), "ratio:0.3"))


@_register(f"WITH {HYB} {SHOW} (SELECT *, sum(fall) OVER (PARTITION BY qid ORDER BY rank) AS falls FROM (SELECT *, CASE WHEN lag(score) OVER (PARTITION BY qid ORDER BY rank) > 0 AND score < 0.6 * lag(score) OVER (PARTITION BY qid ORDER BY rank) THEN 1 ELSE 0 END AS fall FROM h)) WHERE falls = 0")
def trunc_gap(spark, sf):
    return show(truncate.truncate(hybrid_lists(spark, sf), "gap:0.6"))


@_register(f"WITH {HYB}, {KNEE.format(of='h')} {SHOW} knee")
def trunc_knee(spark, sf):
    return show(truncate.truncate(hybrid_lists(spark, sf), "knee"))


@_register(f"WITH {HYB}, m AS (SELECT qid, median(score) AS med, count(*) AS n FROM h GROUP BY qid), a AS (SELECT qid, median(abs(score - med)) AS mad FROM h JOIN m USING (qid) GROUP BY qid) {SHOW} (SELECT h.*, med, mad, n FROM h JOIN m USING (qid) JOIN a USING (qid)) WHERE n < 3 OR mad <= 0 OR score >= med + 2 * mad")
def trunc_mad(spark, sf):
    return show(truncate.truncate(hybrid_lists(spark, sf), "mad:2"))


@_register(f"WITH {HYB} {SHOW} h WHERE coalesce(vec >= 0.35, false) OR coalesce(lex >= 0.9, false)")
def trunc_source(spark, sf):
    return show(truncate.truncate(hybrid_lists(spark, sf), "source:0.35,0.9"))


@_register(f"WITH {HYB}, a AS (SELECT * FROM h WHERE score >= 0.02), {KNEE.format(of='a')} {SHOW} knee")
def trunc_calibrated(spark, sf):
    return show(truncate.calibrated(hybrid_lists(spark, sf), 0.02))


@_register(f"WITH {HYB} {SHOW} (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS p FROM h WHERE score >= 0.98 * 0.02) WHERE p <= 5")
def trunc_calibrated_soft(spark, sf):
    return show(truncate.calibrated_soft(hybrid_lists(spark, sf), 0.02))


# ------------------------------------------------------------------------------------------------------------- diagnostics

MIX = "mix AS (SELECT qid, count(*) AS n, count(*) FILTER (lex IS NOT NULL AND vec IS NOT NULL) AS both, count(*) FILTER (vec IS NULL) AS lexical_only, count(*) FILTER (lex IS NULL) AS vector_only, 0::BIGINT AS other FROM h GROUP BY qid)"


@_register(f"WITH {HYB}, {MIX} SELECT * FROM mix")
def source_mix(spark, sf):
    return envelope.source_mix(hybrid_lists(spark, sf), "hybrid")


@_register(f"WITH {HYB}, {MIX} SELECT qid, CASE WHEN mix.both > 0 THEN 'strong' WHEN n <= 2 THEN 'narrow' ELSE 'mixed' END AS confidence FROM mix")
def confidence(spark, sf):
    return envelope.confidence(envelope.source_mix(hybrid_lists(spark, sf), "hybrid")).select("qid", "confidence")


@_register(f"WITH {HYB}, {KNEE.format(of='h')}, k AS (SELECT qid, count(*) AS kept FROM knee GROUP BY qid) SELECT qid, n, round(y0, 5) AS top_score, round(yn, 5) AS tail_score, round(y0 - yn, 5) AS spread, y0 - yn <= 1e-12 AS flat, n >= 4 AND y0 - yn > 1e-12 AND kept < n AS has_knee FROM (SELECT DISTINCT qid, n, y0, yn FROM kp) JOIN k USING (qid)")
def score_profile(spark, sf):
    return envelope.score_profile(hybrid_lists(spark, sf))


@_register(f"WITH {HYB}, a AS (SELECT * FROM h WHERE score >= 0.03), {KNEE.format(of='a')}, x AS (SELECT item_id AS qid, (SELECT count(*) FROM h WHERE qid = item_id) AS raw_count, (SELECT count(*) FROM a WHERE qid = item_id) AS after_min_score, (SELECT count(*) FROM knee WHERE qid = item_id) AS after_truncate FROM benchmark) SELECT *, raw_count - after_min_score AS dropped_by_min_score, after_min_score - after_truncate AS dropped_by_truncate FROM x")
def filter_counters(spark, sf):
    raw = hybrid_lists(spark, sf)
    after = truncate.min_score(raw, 0.03)
    return envelope.filter_counters(questions(spark, sf), raw, after, truncate.truncate(after, "knee"))


@_register()
def envelope_json(spark, sf):
    e = Engine(indexed(spark, sf), body_index(spark, sf), chunk_table(spark, sf), vectors(spark, sf), floor=0.02, weights={"body": 1.0})
    mode = F.element_at(F.array(*map(F.lit, ("hybrid", "lexical", "vector"))), (F.col("qid") % 3).cast("int") + 1)
    spec = F.element_at(F.array(*map(F.lit, ("off", "knee", "calibrated"))), (F.col("qid") % 3).cast("int") + 1)
    return e.envelopes(question_vectors(spark, sf).withColumn("mode", mode).withColumn("truncate", spec))


# ------------------------------------------------------------------------------------------------------------- maintenance

#: A snapshot before the present one: one path in ten is new since, one gone, one changed, one touched.
OLD_SQL = "s AS (SELECT doc_id + 1000000 AS doc_id, 'src/' || doc_id AS relpath, sha256(text || CASE WHEN doc_id % 10 = 1 THEN ' old' ELSE '' END) AS hash, doc_id::DOUBLE AS mtime FROM documents WHERE doc_id % 10 <> 0), f AS (SELECT 'src/' || doc_id AS relpath, sha256(text) AS hash, doc_id + CASE WHEN doc_id % 10 IN (1, 2) THEN 0.5 ELSE 0 END::DOUBLE AS mtime FROM documents WHERE doc_id % 10 <> 9)"


def _snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").withColumn("relpath", F.concat(F.lit("src/"), F.col("doc_id").cast("string")))
    k = F.col("doc_id") % 10
    old = d.where(k != 0).select((F.col("doc_id") + 1000000).alias("doc_id"), "relpath", F.sha2(F.concat("text", F.when(k == 1, " old").otherwise("")), 256).alias("hash"), F.col("doc_id").cast("double").alias("mtime"))
    now = d.where(k != 9).select("relpath", F.sha2("text", 256).alias("hash"), (F.col("doc_id") + F.when(k.isin(1, 2), 0.5).otherwise(0.0)).alias("mtime"))
    return old, now


@_register(f"WITH {OLD_SQL} SELECT coalesce(f.relpath, s.relpath) AS relpath, s.doc_id, CASE WHEN f.relpath IS NULL THEN 'removed' WHEN s.relpath IS NULL THEN 'added' WHEN s.mtime = f.mtime THEN 'unchanged' WHEN s.hash = f.hash THEN 'touched' ELSE 'updated' END AS change FROM s FULL JOIN f ON s.relpath = f.relpath")
def sync_diff(spark, sf):
    return maintain.diff(*_snapshots(spark, sf))


@_register("WITH x AS (SELECT count(*) FILTER (doc_id % 10 = 0) AS added, count(*) FILTER (doc_id % 10 = 1) AS updated, count(*) FILTER (doc_id % 10 = 9) AS removed, count(*) AS n FROM documents) SELECT added, updated, removed, n - added - updated - removed AS unchanged FROM x")
def sync_counts(spark, sf):
    return maintain.diff_counts(maintain.diff(*_snapshots(spark, sf)))


@_register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id // 2 FROM embeddings)")
def pending_docs(spark, sf):
    return maintain.pending(documents(spark, sf), chunk_table(spark, sf)).select("doc_id")


@_register("SELECT e.vec_id AS chunk_id, e.vec_id // 2 AS doc_id FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id // 2 WHERE e.label = 3")
def orphan_chunks(spark, sf):
    # vectors of one label are taken as lost
    there = table(spark, sf, "embeddings").where("label <> 3").select(F.col("vec_id").alias("chunk_id"))
    return maintain.orphans(documents(spark, sf), chunk_table(spark, sf), there).select("chunk_id", "doc_id")


@_register("SELECT 'documents' AS name, count(*) AS n FROM documents WHERE lang <> 'de' UNION ALL SELECT 'chunks', count(*) FROM embeddings WHERE vec_id // 2 NOT IN (SELECT doc_id FROM documents WHERE lang = 'de') UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id // 2 NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def cascade_delete(spark, sf):
    d = documents(spark, sf)
    parts = maintain.cascade(d.where("collection = 'de'"), d, chunk_table(spark, sf), vectors(spark, sf))
    out = [p.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, p in zip(("documents", "chunks", "vectors"), parts, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@_register("SELECT source AS name, CASE WHEN source = 'src1' THEN '/new' ELSE '/old/' || source END AS root FROM (SELECT DISTINCT source FROM documents UNION SELECT 'src1')")
def collection_upsert(spark, sf):
    have = table(spark, sf, "documents").select(F.col("source").alias("name")).distinct().withColumn("root", F.concat(F.lit("/old/"), "name"))
    return maintain.upsert(have, spark.createDataFrame([("src1", "/new")], "name string, root string"))


@_register("SELECT e.vec_id AS chunk_id, CASE WHEN t <> '' THEN t || chr(10) ELSE '' END || substr(text, 1, 1800) AS text FROM embeddings e JOIN (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '[\\n\\r]+'), lambda x: trim(x)), lambda x: x <> '')[1][:120] AS t FROM documents) d ON d.doc_id = e.vec_id // 2")
def embedding_input(spark, sf):
    return V.embedding_input(chunk_table(spark, sf), documents(spark, sf))


# ------------------------------------------------------------------------------------------------------------- calibration


@_register("SELECT 'pos-' || doc_id AS qid, doc_id, array_to_string(list_transform(list_sort(list_transform(w, lambda x, i: {'h': md5('0:' || doc_id || ':' || (i - 1)), 'i': i, 'w': x}))[:4], lambda s: s.w), ' ') AS query FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z'']{3,}') AS w FROM documents) WHERE len(w) >= 6")
def calib_pseudo_queries(spark, sf):
    return calibrate.pseudo_queries(documents(spark, sf))


OBS_SQL = "obs AS (SELECT CASE WHEN quality = 1 THEN 'pos' ELSE 'neg' END AS kind, round(n_chars / (n_chars + 1000.0), 6) AS score FROM labels JOIN documents USING (doc_id))"


def _observations(spark, sf) -> DataFrame:
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return d.select(F.when(F.col("quality") == 1, "pos").otherwise("neg").alias("kind"), F.round(F.col("n_chars") / (F.col("n_chars") + 1000.0), 6).alias("score"))


@_register(f"WITH {OBS_SQL}, c AS (SELECT DISTINCT score AS t FROM obs UNION SELECT max(score) + 1e-4 FROM obs WHERE kind = 'neg'), k AS (SELECT t, count(*) FILTER (kind = 'pos' AND score >= t) / count(*) FILTER (kind = 'pos') - count(*) FILTER (kind = 'neg' AND score >= t) / count(*) FILTER (kind = 'neg') AS j FROM c CROSS JOIN obs GROUP BY t) SELECT round(arg_max(t, (round(j, 12), -t)), 6) AS floor, round(max(j), 6) AS j FROM k")
def calib_floor(spark, sf):
    return calibrate.best_floor(calibrate.split_curve(_observations(spark, sf))).select(r6("floor"), r6("j"))


@_register(f"WITH {OBS_SQL}, c AS (SELECT unnest(range(1, 16)) / 100 AS t) SELECT round(t, 6) AS t, round(count(*) FILTER (kind = 'pos' AND score >= t) / count(*) FILTER (kind = 'pos'), 6) AS kept_pos, round(count(*) FILTER (kind = 'neg' AND score >= t) / count(*) FILTER (kind = 'neg'), 6) AS kept_neg FROM c CROSS JOIN obs GROUP BY t")
def calib_curve(spark, sf):
    floors = spark.createDataFrame([(t,) for t in calibrate.CURVE], "t double")
    return calibrate.split_curve(_observations(spark, sf), floors).select(r6("t"), r6("kept_pos"), r6("kept_neg"))


@_register("SELECT source, n, pending, greatest(100, floor(0.1 * n))::BIGINT AS threshold, n % 2 = 0 OR pending >= greatest(100, floor(0.1 * n)) AS due FROM (SELECT source, count(*) AS n, count(*) FILTER (length(text) > 300) AS pending FROM documents GROUP BY source)")
def recalib_gate(spark, sf):
    g = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 300).alias("pending"))
    return g.withColumn("threshold", calibrate.change_threshold(F.col("n"))).withColumn("due", calibrate.due(F.col("n") % 2 != 0, F.col("pending"), F.col("n")))


@_register()
def calib_report(spark, sf):
    d = indexed(spark, sf)
    chunks = d.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(0).alias("seq"), F.lit(0).alias("pos"), F.length("body").alias("length"))
    embedder = V.HashEmbedder()
    vecs = d.select(F.col("doc_id").alias("chunk_id"), embedder.documents(F.col("body")).alias("embedding"))
    return Engine(d, body_index(spark, sf), chunks, vecs, embedder, weights={"body": 1.0}).calibrate()


# -------------------------------------------------------------------------------------------------------------- evaluation

EXPECTED = "ex AS (SELECT b.item_id AS qid, ['unique', 'phrase', 'vague'][b.item_id % 3 + 1] AS type, min(d.doc_id) AS expected FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1, 2)"
PATHS = f"WITH {TIERS}, {EXPECTED}, hits AS (SELECT ex.qid, type, min(rank) - 1 AS hit FROM ex LEFT JOIN lexl ON lexl.qid = ex.qid AND lexl.doc_id = ex.expected AND rank <= 10 GROUP BY ex.qid, type)"


@_once
def expected_docs(spark: SparkSession, sf: str) -> DataFrame:
    """qid, type, expected: the first document that holds the passage. Candidates come from the phrase index, then texts are compared."""
    q = questions(spark, sf)
    p = L.query_phrases(q).where("role = 'whole'")
    asked = p.select("qid", L.phrase_key().alias("phrase")).join(q, "qid")
    # a hit brings its body along from the scan, so bodies are not read again, nor shuffled
    near = scan.hits(indexed(spark, sf), ["body"], scan.batch(p, L.phrase_key()), False, ("body",))
    sure = near.join(F.broadcast(asked), "phrase").where(F.contains("body", "query"))
    kind = F.element_at(F.array(*map(F.lit, querygen.KINDS)), (F.col("qid") % 3).cast("int") + 1)
    return sure.groupBy("qid").agg(F.min("doc_id").alias("expected")).withColumn("type", kind).persist()


def _hits(spark, sf) -> DataFrame:
    name = lambda c: F.concat(F.col(c).cast("string"), F.lit(".txt"))
    paths = lexical_lists(spark, sf).where("rank <= 10").groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("docs/"), name("doc_id")).alias("p")))), lambda x: x["p"]).alias("paths"))
    lists = expected_docs(spark, sf).withColumn("expected", name("expected")).join(paths, "qid", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
    return evaluate.hit_ranks(lists, "type")


@_register(f"{PATHS} SELECT coalesce(type, 'all') AS type, count(*) AS n, round_even(avg((coalesce(hit, 99) < 1)::INT), 4) AS recall_1, round_even(avg((coalesce(hit, 99) < 3)::INT), 4) AS recall_3, round_even(avg((coalesce(hit, 99) < 10)::INT), 4) AS recall_10 FROM hits GROUP BY ROLLUP (type)")
def recall_at_k(spark, sf):
    return evaluate.recall_by_type(_hits(spark, sf))


@_register("SELECT lang, count(*) AS n, round_even(list_sort(list(v))[round_even(0.5 * (count(*) - 1), 0)::INT + 1], 1) AS p50, round_even(list_sort(list(v))[round_even(0.99 * (count(*) - 1), 0)::INT + 1], 1) AS p99, round_even(avg(v), 1) AS mean FROM (SELECT lang, n_chars / 8.0 AS v FROM documents) GROUP BY lang")
def latency_percentiles(spark, sf):
    return evaluate.latency(table(spark, sf, "documents").withColumn("ms", F.col("n_chars") / 8.0), "lang")


PERQ = f"""WITH {HYB}, {JUDGED}, {EXPECTED}, r AS (SELECT h.qid, coalesce(label, 'unjudged') AS label, coalesce(h.doc_id = expected, false) AS is_hit FROM h LEFT JOIN j USING (doc_id) LEFT JOIN ex USING (qid) WHERE rank <= 10),
pq AS (SELECT item_id AS qid, ['en', 'fr', 'de', 'es'][item_id % 4 + 1] AS corpus, count(label) AS n, count(*) FILTER (label = 'relevant') AS relevant, count(*) FILTER (label = 'related') AS related, count(*) FILTER (label = 'noise') AS noise, count(*) FILTER (label = 'unjudged') AS unjudged, coalesce(max(is_hit::INT), 0) AS hit FROM benchmark LEFT JOIN r ON r.qid = item_id GROUP BY ALL)"""


def _per_query(spark, sf) -> DataFrame:
    rows = hybrid_lists(spark, sf).where("rank <= 10").join(expected_docs(spark, sf).select("qid", "expected"), "qid", "left")
    rows = evaluate.judged(rows.withColumn("is_hit", F.coalesce(F.col("doc_id") == F.col("expected"), F.lit(False))), judgments(spark, sf), "doc_id")
    corpus = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("qid") % 4).cast("int") + 1)
    return evaluate.per_query(questions(spark, sf), rows, "qid").withColumn("corpus", corpus)


@_register(f"{PERQ} SELECT corpus, count(*) AS queries, sum(n)::BIGINT AS results, round(avg(hit), 6) AS recall, round(coalesce(sum(noise) / nullif(sum(n), 0), 0), 6) AS noise_micro, round(avg((noise = 0)::INT), 6) AS clean, round(sum(related) / sum(n), 6) AS related, round(sum(relevant) / sum(n), 6) AS relevant, sum(unjudged)::BIGINT AS unjudged FROM pq GROUP BY corpus")
def purity_micro(spark, sf):
    p = evaluate.purity(_per_query(spark, sf), "corpus")
    return p.select("corpus", "queries", "results", r6("recall"), r6("noise_micro"), r6("clean"), r6("related"), r6("relevant"), "unjudged")


@_register(f"{PERQ} SELECT corpus, round(avg(noise / n) FILTER (n > 0), 6) AS noise_macro, round(avg((noise = 0)::INT) FILTER (n > 0), 6) AS nonempty_clean, round(avg((n > 0 AND noise = 0)::INT), 6) AS strict_clean, round(avg((n = 0)::INT), 6) AS abstained, round(avg(n), 6) AS avg_len, round(1 - sum(unjudged) / sum(n), 6) AS coverage FROM pq GROUP BY corpus")
def purity_macro(spark, sf):
    p = evaluate.purity(_per_query(spark, sf), "corpus")
    return p.select("corpus", r6("noise_macro"), r6("nonempty_clean"), r6("strict_clean"), r6("abstained"), r6("avg_len"), r6("coverage"))


SWEEP = {"off": "true", "abs:0.03": "score >= 0.03", "ratio:0.3": "score >= 0.3 * y0", "source:0.35,0.9": "coalesce(vec >= 0.35, false) OR coalesce(lex >= 0.9, false)"}
SWEEP_SQL = " UNION ALL ".join(f"SELECT '{s}' AS spec, qid, doc_id, rank FROM hh WHERE {w}" for s, w in SWEEP.items())


@_register(f"WITH {HYB}, {JUDGED}, {EXPECTED}, hh AS (SELECT *, first_value(score) OVER (PARTITION BY qid ORDER BY rank) AS y0 FROM h), {KNEE.format(of='h')}, s AS ({SWEEP_SQL} UNION ALL SELECT 'knee', qid, doc_id, rank FROM knee), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY spec, qid ORDER BY rank) <= 10), g AS (SELECT spec, qid FROM (SELECT DISTINCT qid FROM h) CROSS JOIN (SELECT unnest([{', '.join(repr(x) for x in [*SWEEP, 'knee'])}]) AS spec)), p AS (SELECT g.spec, g.qid, count(t.doc_id) AS n, count(label) AS labelled, count(*) FILTER (label = 'noise') AS noise, max(coalesce(t.doc_id = expected, false)::INT) AS hit FROM g LEFT JOIN t USING (spec, qid) LEFT JOIN j USING (doc_id) LEFT JOIN ex ON ex.qid = g.qid GROUP BY 1, 2) SELECT spec, round(avg(hit), 6) AS recall, round(sum(CASE WHEN labelled > 0 THEN noise / labelled ELSE 0 END) / count(*), 6) AS noise_macro, round(avg((noise = 0)::INT), 6) AS clean, round(avg(n), 6) AS avg_len, round(avg((n = 0)::INT), 6) AS abstained, sum(n - labelled)::BIGINT AS uncovered FROM p GROUP BY spec")
def trunc_sweep(spark, sf):
    name = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    lists = hybrid_lists(spark, sf).withColumn("path", name).join(expected_docs(spark, sf).select("qid", F.col("expected").cast("string").alias("expected")), "qid", "left")
    known = lists.join(judgments(spark, sf), "doc_id").select("qid", "path", "label")
    s = evaluate.sweep(lists, known, [*SWEEP, "knee"])
    return s.select("spec", r6("recall"), r6("noise_macro"), r6("clean"), r6("avg_len"), r6("abstained"), "uncovered")


@_register(f"{PERQ} SELECT corpus, count(*) AS queries, count(*) FILTER (n > 0) AS returned, round(avg((n = 0)::INT), 6) AS abstained, round(avg(n), 6) AS avg_len, round(avg(noise / n) FILTER (n > 0), 6) AS noise, round(avg((noise = 0)::INT), 6) AS clean, count(*) FILTER (relevant > 0) AS false_positives FROM pq GROUP BY corpus")
def nomatch_report(spark, sf):
    p = evaluate.nomatch_report(_per_query(spark, sf), "corpus")
    return p.select("corpus", "queries", "returned", r6("abstained"), r6("avg_len"), r6("noise"), r6("clean"), "false_positives")


@_register(f"{PATHS}, w AS (SELECT item_id AS qid, CASE WHEN len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_'']+')) <= 25 THEN 'short' ELSE 'long' END AS stratum FROM benchmark) SELECT type, stratum, count(*) AS n, round_even(avg((coalesce(hit, 99) < 1)::INT), 4) AS recall_1, round_even(avg((coalesce(hit, 99) < 3)::INT), 4) AS recall_3, round_even(avg((coalesce(hit, 99) < 10)::INT), 4) AS recall_10 FROM hits JOIN w USING (qid) GROUP BY ALL")
def stratified_recall(spark, sf):
    size = F.when(F.size(T.query_tokens(F.col("query"))) <= 25, "short").otherwise("long")
    return evaluate.recall(_hits(spark, sf).join(questions(spark, sf).select("qid", size.alias("stratum")), "qid"), "type", "stratum")


@_register(f"WITH {HYB}, {KNEE.format(of='h')}, {EXPECTED} SELECT d.source AS grp, count(*) AS n, count(knee.doc_id) AS kept, round(count(knee.doc_id) / count(*), 6) AS share FROM ex JOIN documents d ON d.doc_id = ex.expected LEFT JOIN knee ON knee.qid = ex.qid AND knee.doc_id = ex.expected GROUP BY d.source")
def knee_by_group(spark, sf):
    ex = expected_docs(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("expected"), F.col("source").alias("grp")), "expected")
    knee = truncate.truncate(hybrid_lists(spark, sf), "knee").select("qid", F.col("doc_id").alias("expected"), F.lit(1).alias("k"))
    return ex.join(knee, ["qid", "expected"], "left").groupBy("grp").agg(F.count("*").alias("n"), F.count("k").alias("kept"), F.round(F.count("k") / F.count("*"), 6).alias("share"))


@_register(f"WITH {HYB} SELECT lang || '/' || source || '/' || doc_id || '.txt' AS value FROM h JOIN documents USING (doc_id) WHERE rank <= 10")
def paths_sink(spark, sf):
    from quern.sources.files import paths_sink as sink

    return sink(hybrid_lists(spark, sf).where("rank <= 10").join(documents(spark, sf).select("doc_id", "collection", "relpath"), "doc_id"))


@_register(f"WITH {HYB}, {EXPECTED} SELECT type, count(*) FILTER (lex IS NOT NULL AND vec IS NOT NULL) AS both, count(*) FILTER (vec IS NULL) AS lexical_only, count(*) FILTER (lex IS NULL) AS vector_only FROM h JOIN ex ON ex.qid = h.qid AND ex.expected = h.doc_id GROUP BY type")
def source_attribution(spark, sf):
    e = expected_docs(spark, sf)
    return evaluate.attribution(hybrid_lists(spark, sf).join(e, ["qid"]).where(F.col("doc_id") == F.col("expected")), "type")


@_register(f"WITH {EXPECTED}, a AS (SELECT item_id AS qid, ['unique', 'phrase', 'vague'][item_id % 3 + 1] AS type FROM benchmark) SELECT a.type, count(*) AS n, count(ex.qid) AS reachable, round_even(avg((ex.qid IS NOT NULL)::INT), 4) AS ceiling FROM a LEFT JOIN ex USING (qid) GROUP BY a.type")
def recall_ceiling(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, querygen.KINDS)), (F.col("qid") % 3).cast("int") + 1)
    asked = questions(spark, sf).join(expected_docs(spark, sf).select("qid", "expected"), "qid", "left").select("qid", kind.alias("type"), F.coalesce(F.concat(F.col("expected").cast("string"), F.lit(".txt")), F.lit("nowhere")).alias("expected"))
    files = documents(spark, sf).select(F.col("relpath").alias("path"))
    return evaluate.ceiling(asked, files, "type")


@_register(f"WITH {TIERS}, w AS (SELECT item_id AS qid, list_distinct({WORDS_SQL.format('text')}) AS w FROM benchmark) SELECT lexl.qid, lexl.doc_id, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_intersect(w, {WORDS_SQL.format('d.text')})) / len(w) END, 6) AS overlap FROM lexl JOIN w USING (qid) JOIN documents d USING (doc_id) WHERE rank <= 10")
def overlap_fraction(spark, sf):
    rows = lexical_lists(spark, sf).where("rank <= 10").select("qid", "doc_id").join(questions(spark, sf), "qid").join(documents(spark, sf).select("doc_id", "body"), "doc_id")
    return rows.select("qid", "doc_id", F.round(evaluate.overlap(T.content_words(F.col("query")), T.content_words(F.col("body"))), 6).alias("overlap"))


@_register(f"WITH {HYB}, {EXPECTED}, l AS (SELECT qid, doc_id FROM lexl WHERE rank <= 10 UNION ALL SELECT qid, doc_id FROM vecl WHERE rank <= 10), u AS (SELECT qid, doc_id FROM l UNION SELECT qid, expected FROM ex) SELECT qid, list_sort(list('docs/' || doc_id)) AS pool FROM u GROUP BY qid HAVING count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) > 0")
def judging_pool(spark, sf):
    name = lambda c: F.concat(F.lit("docs/"), F.col(c).cast("string"))
    lists = lexical_lists(spark, sf).where("rank <= 10").select("qid", name("doc_id").alias("path")).unionByName(vector_lists(spark, sf).where("rank <= 10").select("qid", name("doc_id").alias("path")))
    pools = evaluate.pool(lists, expected_docs(spark, sf).select("qid", name("expected").alias("expected")))
    done = pools.select("qid", F.explode("pool").alias("path")).join(table(spark, sf, "labels").select(name("doc_id").alias("path")), "path", "left_semi")
    return evaluate.to_judge(pools, done)


@_register("SELECT item_id AS qid, mode FROM benchmark CROSS JOIN (SELECT unnest(['hybrid', 'lexical', 'vector']) AS mode) WHERE NOT (mode = 'lexical' AND item_id % 2 = 0)")
def outstanding_runs(spark, sf):
    planned = questions(spark, sf).select("qid", F.explode(F.array(*map(F.lit, ("hybrid", "lexical", "vector")))).alias("mode"))
    return evaluate.outstanding(planned, planned.where("mode = 'lexical' and qid % 2 = 0"), "qid", "mode")


@_register("SELECT lang AS corpus, doc_id AS qid FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def validated_queries(spark, sf):
    asked = table(spark, sf, "documents").select(F.col("lang").alias("corpus"), F.col("doc_id").alias("qid"))
    verdicts = asked.join(table(spark, sf, "labels").select(F.col("doc_id").alias("qid"), (F.col("quality") == 1).alias("valid")), "qid")
    return evaluate.validated(asked, verdicts)


@_register("SELECT label AS qid, d AS path, place::BIGINT AS place FROM (SELECT label, vec_id // 2 % 50 AS d, row_number() OVER (PARTITION BY label ORDER BY min(vec_id)) AS place FROM embeddings GROUP BY 1, 2) WHERE place <= 10")
def first_distinct(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("qid"), F.col("vec_id").alias("rank"), (F.floor(F.col("vec_id") / 2) % 50).alias("path"))
    return evaluate.first_distinct(e, 10).select("qid", "path", F.col("place").cast("long").alias("place"))


# -------------------------------------------------------------------------------------------------------------- generation

GEN = f"w AS (SELECT doc_id, w AS word, min(i) AS fst FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {WORDS_SQL.format('substr(text, 1, 200000)')} AS w FROM documents)) GROUP BY ALL), f AS (SELECT word, count(*) AS df FROM w GROUP BY word), x AS (SELECT doc_id, word, df, fst, md5('7:' || doc_id || ':' || word) AS h FROM w JOIN f USING (word))"


@_once
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return querygen.document_frequency(documents(spark, sf), querygen.READ_CHARS).persist()


@_register(f"WITH {GEN}, r AS (SELECT *, df <= 3 AS rare, row_number() OVER (PARTITION BY doc_id, df <= 3 ORDER BY df, h) AS n FROM x WHERE df <= 50) SELECT doc_id, string_agg(word, ' ' ORDER BY NOT rare, n) AS query FROM r WHERE n <= CASE WHEN rare THEN 2 ELSE 1 END GROUP BY doc_id HAVING bool_or(rare)")
def gen_unique(spark, sf):
    return querygen.unique_queries(documents(spark, sf), word_counts(spark, sf))


@_register(f"WITH {GEN}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY h, word) AS n, count(*) OVER (PARTITION BY doc_id) AS c FROM x WHERE df BETWEEN 5 AND 500) SELECT doc_id, string_agg(word, ' ' ORDER BY n) AS query FROM r WHERE n <= 6 AND c >= 4 GROUP BY doc_id")
def gen_vague(spark, sf):
    return querygen.vague_queries(documents(spark, sf), word_counts(spark, sf))


@_register(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c]'), lambda x: string_split(trim(regexp_replace(trim(x), '\s+', ' ', 'g')), ' ')), lambda w: len(w) >= 8) AS l FROM (SELECT doc_id, substr(text, 1, 200000) AS text FROM documents)),
p AS (SELECT doc_id, l[('0x' || md5('7:' || doc_id || ':line')[:8])::BIGINT % len(l) + 1] AS w FROM l WHERE len(l) > 0),
s AS (SELECT doc_id, w, ('0x' || md5('7:' || doc_id || ':start')[:8])::BIGINT % greatest(len(w) - 8, 1) AS a, 6 + ('0x' || md5('7:' || doc_id || ':length')[:8])::BIGINT % 4 AS n FROM p)
SELECT doc_id, array_to_string(w[a + 1 : a + n], ' ') AS query FROM s""")
def gen_phrase(spark, sf):
    return querygen.phrase_queries(documents(spark, sf))


@_register()
def gen_query_set(spark, sf):
    return querygen.query_set(documents(spark, sf), 500, df=word_counts(spark, sf))


@_register("""WITH t AS (SELECT conv_id, turn, strftime(make_timestamp((epoch(TIMESTAMP '2020-01-01 08:00:00')::BIGINT + (('0x' || md5(conv_id || ':day')[:8])::BIGINT % 1500) * 86400 + turn * 90) * 1000000), '%d/%m/%Y, %H:%M') || ' - ' || upper(role[1]) || role[2:] || ': ' || trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS line FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, 'Chat export: conversation ' || conv_id || chr(10) || string_agg(line, chr(10) ORDER BY turn, line) || chr(10) AS text FROM t GROUP BY conv_id HAVING count(*) > 1""")
def render_chat(spark, sf):
    return querygen.render_chats(table(spark, sf, "conversations"))


@_register(f"""WITH i AS (SELECT unnest(range(1000)) AS i), v AS (SELECT i, {querygen.ADJECTIVES}[i % 14 + 1] AS adj, {querygen.NOUNS}[i // 14 % 14 + 1] AS noun, {querygen.TOPICS}[i % 10 + 1] AS topic, lpad(i::VARCHAR, 4, '0') AS num FROM i)
SELECT i::BIGINT AS doc_id, 'doc' || num || '.md' AS relpath, '# ' || upper(topic[1]) || topic[2:] || ' field note ' || num || chr(10) || chr(10) || 'This note about ' || topic || ' concerns the ' || adj || '-' || noun || '-' || num || '. The ' || adj || ' ' || noun || ' is studied here through the lens of ' || topic || ', with observations on its ' || topic || ' behaviour and seasonal change.' || chr(10) AS body FROM v""")
def gen_e2e_corpus(spark, sf):
    return querygen.generated_corpus(spark)


@_register(f"""WITH h AS (SELECT i, md5('nomatch:' || i) AS h FROM (SELECT unnest(range(800)) AS i)),
d AS (SELECT i, list_transform(range(8), lambda k: instr('0123456789abcdef', h[k + 1]) - 1) AS x FROM h),
w AS (SELECT min(i) AS i, word FROM (SELECT i, list_aggregate(list_transform(range(4), lambda k: 'bdfghklmnprstvwz'[x[2 * k + 1] + 1] || 'aeiou'[x[2 * k + 2] % 5 + 1]), 'string_agg', '') AS word FROM d) GROUP BY word),
free AS (SELECT word, row_number() OVER (ORDER BY i) - 1 AS k FROM w WHERE word NOT IN (SELECT unnest({WORDS_SQL.format('text')}) FROM documents WHERE text IS NOT NULL)),
q AS (SELECT a.k // 2 AS q, a.word AS a, b.word AS b FROM free a JOIN free b ON b.k = a.k + 1 WHERE a.k % 2 = 0 AND a.k < 200)
SELECT 'nomatch-' || lpad(q::VARCHAR, 4, '0') AS qid, replace(replace(['parts that supplier @a ships to @b', 'orders of customer @a from the nation @b', 'pages on @a under the host @b', 'what @a told @b in a conversation', 'documents that name both @a and @b'][q % 5 + 1], '@a', a), '@b', b) AS query FROM q""")
def gen_nomatch(spark, sf):
    return querygen.nomatch_queries(documents(spark, sf))


@_register("SELECT doc_id, ['plain', 'terse', 'chatty'][(row_number() OVER (ORDER BY doc_id) - 1) % 3 + 1] AS style, (instr('0123456789abcdef', sha1(doc_id::VARCHAR)[40]) - 1) % 4 AS noise FROM documents".replace("sha1(doc_id::VARCHAR)[40]", "right(sha1(doc_id::VARCHAR), 1)"))
def gen_styles(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    # ids count up from 0 without gaps, so an id is its row's place
    return d.select("doc_id", querygen.substyle(F.col("doc_id"), ["plain", "terse", "chatty"]).alias("style"), querygen.noise_kind(F.col("doc_id").cast("string")).cast("long").alias("noise"))
