"""Retrieval metrics over result lists, judgments and captures: recall, percentiles, purity, sweeps, attribution, ceilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import truncate as cut

#: Depths of recall, labels that count, specs of a sweep by mode.
DEPTHS = (1, 3, 10)
LABELS = ("relevant", "related", "noise")
UNJUDGED = "unjudged"


def hit_ranks(lists: DataFrame, *keep: str) -> DataFrame:
    """Each list (qid, expected, paths array) with hit: the first place, from 0, of the expected path; null without."""
    # a path ends with /expected: both are compared in the row, nothing is joined
    at = F.filter(F.transform("paths", lambda p, i: F.when(T.path_matches(p, F.col("expected")), i)), lambda i: i.isNotNull())
    return lists.select("qid", *keep, F.get(at, F.lit(0)).alias("hit"))


def recall(hits: DataFrame, *by: str, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """n and recall at each depth, by the given columns (none: overall)."""
    at = lambda k: F.bround(F.avg(F.coalesce((F.col("hit") < k).cast("int"), F.lit(0))), 4).alias(f"recall_{k}")
    return hits.groupBy(*by).agg(F.count("*").alias("n"), *(at(k) for k in depths))


def recall_by_type(hits: DataFrame) -> DataFrame:
    """Recall of every type and, as type `all`, of everything."""
    return recall(hits.unionByName(hits.withColumn("type", F.lit("all"))), "type")


def nearest_rank(values: Column, percent: float) -> Column:
    """Of an array: the value at percent of the way, at the nearest place (half to even); 0 for an empty one."""
    at = F.bround(F.lit(percent / 100) * (F.size(values) - 1)).cast("int")
    return F.coalesce(F.get(F.sort_array(values), F.greatest(F.least(at, F.size(values) - 1), F.lit(0))), F.lit(0.0))


def latency(rows: DataFrame, *by: str, value: str = "ms") -> DataFrame:
    """p50, p99 and mean, one digit, from one row per query."""
    every = F.collect_list(value)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.bround(nearest_rank(every, 50), 1).alias("p50"), F.bround(nearest_rank(every, 99), 1).alias("p99"), F.bround(F.avg(value), 1).alias("mean"))


def judged(results: DataFrame, judgments: DataFrame, *key: str) -> DataFrame:
    """results with label; unjudged where judgments (key columns, label) has none or an unknown one."""
    j = judgments.select(*key, F.when(F.col("label").isin(*LABELS), F.col("label")).otherwise(UNJUDGED).alias("label"))
    return results.join(j, list(key), "left").withColumn("label", F.coalesce("label", F.lit(UNJUDGED)))


def per_query(lists: DataFrame, results: DataFrame, *key: str) -> DataFrame:
    """Per list: n results, counts of each label, hit. lists: one row per query (empty ones too); results: labelled rows (key, label, is_hit)."""
    n = lambda label: F.count_if(F.col("label") == label).alias(label)
    sums = results.groupBy(*key).agg(F.count("*").alias("n"), *(n(x) for x in (*LABELS, UNJUDGED)), F.max(F.col("is_hit").cast("int")).alias("hit"))
    return lists.select(*key).distinct().join(sums, list(key), "left").na.fill(0)


def purity(queries: DataFrame, *by: str) -> DataFrame:
    """Report over `per_query` rows. noise_micro: noise over results; noise_macro: mean of each answered query's share;
    clean: queries without noise, unanswered ones included; nonempty_clean and strict_clean: only answered ones count as clean,
    over answered and over all queries."""
    answered, pure = F.col("n") > 0, F.col("noise") == 0
    share = lambda c, of: F.coalesce(F.sum(c) / F.nullif(F.sum(of), F.lit(0)), F.lit(0.0))
    return queries.groupBy(*by).agg(
        F.count("*").alias("queries"), F.sum("n").alias("results"), F.avg("hit").alias("recall"), share("noise", "n").alias("noise_micro"),
        F.coalesce(F.avg(F.when(answered, F.col("noise") / F.greatest("n", F.lit(1)))), F.lit(0.0)).alias("noise_macro"), F.avg(pure.cast("int")).alias("clean"),
        F.coalesce(F.avg(F.when(answered, pure.cast("int"))), F.lit(0.0)).alias("nonempty_clean"), F.avg((answered & pure).cast("int")).alias("strict_clean"),
        share("related", "n").alias("related"), share("relevant", "n").alias("relevant"), F.sum(UNJUDGED).alias("unjudged"),
        F.avg((~answered).cast("int")).alias("abstained"), F.avg("n").alias("avg_len"), F.coalesce(1 - F.sum(UNJUDGED) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("coverage"),
    )


def sweep(lists: DataFrame, judgments: DataFrame, specs: list[str], mode: str = "hybrid", top: int = 10) -> DataFrame:
    """Purity of every spec over the same captured lists (qid, expected, doc key `path`, rank, score, sources): one row per spec.

    noise_macro is over judged results only, as sweeps do; uncovered counts results without a label.
    """
    everyone = lists.select("qid", "expected").distinct()
    parts = []
    for spec in specs:
        kept = cut.truncate(lists, spec, mode).withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("_n") <= top)
        parts.append(kept.select(F.lit(spec).alias("spec"), "qid", "expected", "path"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    known = rows.join(judgments.select("qid", "path", "label"), ["qid", "path"], "left")
    q = known.groupBy("spec", "qid").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.count_if(F.col("label") == "noise").alias("noise"), F.max(T.path_matches(F.col("path"), F.col("expected")).cast("int")).alias("hit"))
    grid = everyone.select("qid").withColumn("spec", F.explode(F.array(*map(F.lit, specs))))
    q = grid.join(q, ["spec", "qid"], "left").na.fill(0)
    return q.groupBy("spec").agg(
        F.avg("hit").alias("recall"), (F.sum(F.when(F.col("labelled") > 0, F.col("noise") / F.greatest("labelled", F.lit(1))).otherwise(0.0)) / F.count("*")).alias("noise_macro"),
        F.avg((F.col("noise") == 0).cast("int")).alias("clean"), F.avg("n").alias("avg_len"), F.avg((F.col("n") == 0).cast("int")).alias("abstained"), F.sum(F.col("n") - F.col("labelled")).alias("uncovered"),
    )


def nomatch_report(queries: DataFrame, *by: str) -> DataFrame:
    """Over `per_query` rows of questions without an answer: answered, abstained, mean length, noise of answered, clean (abstaining is), queries with a relevant result."""
    answered = F.col("n") > 0
    return queries.groupBy(*by).agg(
        F.count("*").alias("queries"), F.count_if(answered).alias("returned"), F.avg((~answered).cast("int")).alias("abstained"), F.avg("n").alias("avg_len"),
        F.coalesce(F.avg(F.when(answered, F.col("noise") / F.greatest("n", F.lit(1)))), F.lit(0.0)).alias("noise"), F.avg((F.col("noise") == 0).cast("int")).alias("clean"), F.count_if(F.col("relevant") > 0).alias("false_positives"),
    )


def attribution(hits: DataFrame, *by: str) -> DataFrame:
    """Which arm carried the hits: counts of lexical only, vector only and both, from rows with `sources`."""
    has = lambda arm: F.array_contains(F.map_keys("sources"), F.lit(arm))
    return hits.groupBy(*by).agg(F.count_if(has("lexical") & has("vector")).alias("both"), F.count_if(has("lexical") & ~has("vector")).alias("lexical_only"), F.count_if(has("vector") & ~has("lexical")).alias("vector_only"))


def ceiling(queries: DataFrame, files: DataFrame, *by: str) -> DataFrame:
    """Share of queries (expected) whose file is among files (path), whole or after a slash. Both sides meet by equality of suffixes."""
    parts = F.split("path", "/")
    suffixes = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("expected")).distinct()
    rows = queries.join(suffixes.withColumn("_there", F.lit(1)), "expected", "left")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count("_there").alias("reachable"), F.bround(F.avg(F.coalesce("_there", F.lit(0))), 4).alias("ceiling"))


def real_paths(shown: DataFrame, files: DataFrame) -> DataFrame:
    """path -> real: the file (relpath) that a displayed path stands for, by its longest suffix; plain names before slugs."""
    parts = F.split("path", "/")
    suffix = shown.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("cut", "key"))
    names = files.select(F.col("relpath").alias("key"), F.lit(0).alias("kind"), "relpath").unionByName(files.groupBy(T.slug_path(F.col("relpath")).alias("key")).agg(F.lit(1).alias("kind"), F.max("relpath").alias("relpath")))
    found = suffix.join(names, "key").groupBy("path").agg(F.min_by("relpath", F.struct("kind", "cut")).alias("real"))
    return shown.select("path").distinct().join(found, "path", "left")


def first_distinct(ranked: DataFrame, k: int, of: str = "path") -> DataFrame:
    """The first k distinct values of a ranked list (qid, rank), each at its first place."""
    firsts = ranked.where(F.col(of).isNotNull() & (F.col(of).cast("string") != "")).groupBy("qid", of).agg(F.min("rank").alias("rank"))
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("place") <= k).select("qid", of, "place")


def pool(lists: DataFrame, targets: DataFrame) -> DataFrame:
    """qid, pool: the distinct paths of all lists (qid, path) of a query, and its target (qid, expected)."""
    found = lists.select("qid", "path").unionByName(targets.select("qid", F.col("expected").alias("path")))
    return found.groupBy("qid").agg(F.array_sort(F.collect_set("path")).alias("pool"))


def to_judge(pools: DataFrame, judgments: DataFrame) -> DataFrame:
    """Pools with a path that has no judgment yet."""
    done = judgments.groupBy("qid").agg(F.collect_set("path").alias("_done"))
    return pools.join(done, "qid", "left").where(F.size(F.array_except("pool", F.coalesce("_done", F.array().cast("array<string>")))) > 0).drop("_done")


def outstanding(planned: DataFrame, recorded: DataFrame, *key: str) -> DataFrame:
    """Planned runs that are not recorded: a resumed run's work."""
    return planned.join(recorded.select(*key).distinct(), list(key), "left_anti")


def validated(queries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Queries that a verdict (corpus, qid, valid) has found valid."""
    return queries.join(verdicts.where("valid").select("corpus", "qid"), ["corpus", "qid"], "left_semi")


def overlap(query_words: Column, body_words: Column) -> Column:
    """Share of the query's distinct content words that the body has; 0 without any."""
    q = F.array_distinct(query_words)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, body_words)) / F.greatest(F.size(q), F.lit(1)))


def overlap_bucket(value: Column) -> Column:
    return F.when(value <= 0.2, "low").when(value <= 0.5, "middle").otherwise("high")
