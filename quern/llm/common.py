"""Shared helpers: tables in the shared folder, row keys, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word in the contracts of the operators: x20 and x09 to x0D.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset: a folder of the warehouse on a
    cluster, a temporary folder in local mode."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("quern.shared.dir", None)
    if not base:
        local = sc.master == "local" or sc.master.startswith("local[")
        base = "file://" + tempfile.mkdtemp(prefix="quern-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quern-shared"
        spark.conf.set("quern.shared.dir", base)
    return base.rstrip("/")


def materialise(df: DataFrame, label: str = "t") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts lineage, and survives the loss of executors.

    The table stays until the caller empties the folder, as the returned frame is lazy; `discard` drops it earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes the tables behind frames that `materialise` returned."""
    for df in frames:
        path = getattr(df, "_quern_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def packed(docs: DataFrame, *needed: str):
    """docs with the needed columns by name and all others inside one struct, so that no name of theirs can clash with an
    operator's own; and a function that gives back all columns in their order."""
    others = [c for c in docs.columns if c not in needed]
    place = {c: f"c{i}" for i, c in enumerate(others)}
    rest = [F.struct(*(F.col(f"`{c}`").alias(place[c]) for c in others)).alias("_rest")] if others else []

    def unpack(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(c) if c in needed else F.col("_rest")[place[c]].alias(c) for c in docs.columns))

    return docs.select(*needed, *rest), unpack


def id_crc_mod(column, mod: int):
    """crc32 of an id as text, modulo; null ids give -1, so they are never held out."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string")), F.lit(mod)), F.lit(-1))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as edges (a long, b long); returns (node, root), one row per node that has an edge.

    Randomised contraction: in each round every node moves to the neighbour (or itself) with the smallest round-specific hash,
    edges are rewritten to the moved ends, loops and repeats go. A constant share of the nodes disappears per round whatever
    the shape (a path by ids does not take as many rounds as it is long). All groupings are minima, which combine before the
    shuffle; each round is written to the shared folder. Null ends are ignored; an empty table gives an empty table.
    """
    e = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    trail: list[DataFrame] = []
    for r in range(max_rounds):
        if e.isEmpty():
            break
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(r)).alias("h"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(F.xxhash64("a", F.lit(r)).alias("h"), F.col("a").alias("v"))
        move = materialise(best.select(F.col("a").alias("node"), F.least(F.col("m"), own)["v"].alias("to")), "move")
        trail.append(move)
        left = e.join(move, e.a == move.node).select(F.col("to").alias("a"), "b")
        both_moved = left.join(move, left.b == move.node).select("a", F.col("to").alias("b"))
        nxt = materialise(both_moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        discard(e)
        e = nxt
    else:
        if not e.isEmpty():
            raise RuntimeError("connected_components did not converge")
    discard(e)
    if not trail:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    # From the last round back, each node's place is followed to its root; every step is an equi-join on a shrinking table.
    roots = trail[-1].select("node", F.col("to").alias("root"))
    for move in reversed(trail[:-1]):
        far = roots.select(F.col("node").alias("at"), F.col("root").alias("far"))
        roots = materialise(move.join(far, move["to"] == far["at"], "left").select("node", F.coalesce("far", "to").alias("root")), "roots")
    return roots
