"""Mixing sources to target weights: cube-method samples balanced on document and word totals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import materialise, packed

#: Documents in one flight; each leaves at most two undecided ones for the next level.
BLOCK = 1024
#: A copy count above this times the document is never taken; targets stop there too.
MOST = 3
EPS = 1e-9


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, n_docs, source_size, target, from rows (source, size).

    Sources in code point order, null last, weigh 1, 2, 3, 1, ...; together they get the sum of all sizes. No target passes
    MOST times its source's size: in the order of size / weight, a source is capped while the level that all later ones would
    share puts it above its cap, which is where repeated resharing of the excess ends. One row per source from here on.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    per = per.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).withColumn("cap", F.lit(MOST) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    per = per.withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    shared = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("o"), F.col("level").alias("l")))).over(every)["l"]
    return per.select("source", "n_docs", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared * F.col("weight")).alias("target"))


def flight(sizes: list[int], probs: list[float], rng, constraints: int = 2) -> list[int]:
    """Moves probs in place until at most `constraints` lie strictly between 0 and 1; returns those places.

    All units of a source start with the same probability, so balancing documents and words means keeping sum(p) and
    sum(p * size). Of any three undecided units (x2 - x3, x3 - x1, x1 - x2) lies in the null space of both; of any two,
    (1, -1) keeps the first. Each step goes either way to the first bound, with odds that leave every probability's mean.
    """
    active: list[int] = []
    for k in range(len(probs)):
        if not EPS < probs[k] < 1 - EPS:
            probs[k] = float(round(probs[k]))
            continue
        active.append(k)
        if len(active) <= constraints:
            continue
        if constraints == 2:
            a, b, c = active
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(u):
                u = (1, -1, 0)
        elif constraints == 1:
            u = (1, -1)
        else:
            u = (1,)
        up = min(((1 - probs[i]) / v if v > 0 else -probs[i] / v) for i, v in zip(active, u, strict=True) if v)
        down = min((probs[i] / v if v > 0 else (probs[i] - 1) / v) for i, v in zip(active, u, strict=True) if v)
        step = up if rng.random() * (up + down) < down else -down
        for i, v in zip(active, u, strict=True):
            probs[i] = min(1.0, max(0.0, probs[i] + step * v))
        for i in active:
            if probs[i] <= EPS or probs[i] >= 1 - EPS:
                probs[i] = float(round(probs[i]))
        active = [i for i in active if 0 < probs[i] < 1]
    return active


def land(sizes: list[int], probs: list[float], rng) -> None:
    """Decides the last units: words are given up first, then the count of documents."""
    for constraints in (2, 1, 0):
        left = flight(sizes, probs, rng, constraints)
    assert not left


def _seed(*parts) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(repr(parts))


def _step(level: int, final: bool, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import random

        rows = rows.sort_values(["order", "doc_id", "size"], kind="stable", na_position="last").reset_index(drop=True)
        source = rows["source"].iat[0]
        rng = random.Random(_seed(seed, level, None if pd.isna(source) else str(source), int(rows["block"].iat[0])))
        sizes, probs = rows["size"].astype("int64").tolist(), rows["p"].astype(float).tolist()
        if final:
            land(sizes, probs, rng)
        else:
            flight(sizes, probs, rng)
        rows["p"] = probs
        return rows.drop(columns=["block"])

    return run


def mix(docs: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and taken for every row of docs (doc_id, text, source).

    A source's documents are all taken floor(target / source_size) times; the fraction left over is the inclusion probability
    of one more copy, drawn by the cube method: balanced flights in blocks of about `block` documents that hashes deal out,
    then flights among the few undecided of all blocks, level by level, until one small landing per source remains. Draws
    depend on the rows and seed only, so reruns agree (where over half a block of rows are equal, these are dealt out by their place in
    the files). Null texts and texts without words have size 0; a source without words
    has target 0. A null source is a source; a null doc_id is an id like any other; repeated rows are drawn one by one; other
    columns are not read; an empty table gives no rows. At most MOST copies of a row are taken.
    """
    words = F.coalesce(F.regexp_count("text", F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")
    sizes = materialise(docs.select("doc_id", "source", words.alias("size"), F.xxhash64("doc_id", "source", "text").alias("order"), F.monotonically_increasing_id().alias("place")), "sizes")
    bulk = sizes.groupBy("order").agg(F.count("*").alias("_n")).where(F.col("_n") > block // 2).withColumnRenamed("order", "_o")
    if not bulk.isEmpty():
        # equal rows in bulk would all be dealt to one block
        dealt = F.when(F.col("_n").isNotNull(), F.xxhash64("order", "place")).otherwise(F.col("order"))
        sizes = materialise(sizes.join(bulk, sizes["order"] == bulk["_o"], "left").withColumn("order", dealt).drop("_o", "_n"), "sizes")
    targets = materialise(source_targets(sizes).coalesce(1), "targets")
    t = targets.select(F.col("source").alias("_s"), "n_docs", "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    rows = sizes.join(t, sizes.source.eqNullSafe(F.col("_s"))).withColumn("ratio", ratio)
    rows = rows.select("doc_id", "source", "size", "order", "source_size", "target", F.floor("ratio").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("p"), F.pmod(F.xxhash64("order", F.lit(seed)), F.ceil(F.col("n_docs") / block)).alias("block"))
    schema = "doc_id {0}, source {1}, size long, order long, source_size long, target double, whole long, p double".format(*(dict(sizes.dtypes)[c] for c in ("doc_id", "source")))
    done: list[DataFrame] = []
    for level in range(20):
        count = rows.groupBy("source").agg(F.countDistinct("block").alias("n"))
        final = (count.agg(F.max("n")).first()[0] or 0) <= 1
        flown = materialise(rows.groupBy("source", "block").applyInPandas(_step(level, final, seed), schema), "flight")
        open_ = F.col("p").between(EPS, 1 - EPS)
        done.append(flown.where(~open_))
        if final:
            break
        left = flown.where(open_)
        n = left.groupBy("source").agg(F.ceil(F.count("*") / block).alias("_n")).withColumnRenamed("source", "_s")
        rows = left.join(n, left.source.eqNullSafe(F.col("_s"))).withColumn("block", F.pmod(F.xxhash64("order", F.lit(seed + level + 1)), F.col("_n"))).drop("_s", "_n")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = F.col("whole") + F.round("p").cast("long")
    return out.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """docs as mixed: each row as many times as `mix` takes it, none where it takes none; columns as they were.

    Copies are joined back by doc_id, source and size. Rows that share all three are numbered among themselves, so each gets
    one of the draws; all others are joined without that.
    """
    docs, unpack = packed(docs, "doc_id", "text", "source")
    names = docs.columns
    drawn = mix(docs, seed, block).groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("copies")).alias("draws"))
    drawn = materialise(drawn.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "draws"), "drawn")
    words = F.coalesce(F.regexp_count("text", F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")
    d = docs.withColumn("_size", words)
    same = d.doc_id.eqNullSafe(F.col("_d")) & d.source.eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z"))
    # the table of draws grows with the documents: always a shuffle, at every size, with the draws as the hashed side
    one = d.join(drawn.where("size(draws) = 1 and draws[0] > 0").hint("shuffle_hash"), same).withColumn("_n", F.col("draws")[0])
    out = one.select(*names, "_n")
    several = drawn.where("size(draws) > 1")
    if not several.isEmpty():
        w = Window.partitionBy("doc_id", "source", "_size").orderBy("text")
        many = d.join(several, same).withColumn("_n", F.get("draws", F.row_number().over(w) - 1)).where("_n > 0")
        out = out.unionByName(many.select(*names, "_n"))
    return unpack(out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))))

