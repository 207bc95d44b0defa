"""Near-duplicate vectors: int8 tile products with rigorous error bounds, then full precision for what may pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import connected_components, materialise

#: Vectors in a tile: every pair of tiles is one group. Inside, products are of BLOCK x BLOCK float32, pairs are recomputed SLICE at a time.
TILE, BLOCK, SLICE = 2048, 1024, 1 << 16
#: Added to the error bound for the rounding of float32 products and of the stored norms.
SLACK = 1e-4


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows of x as int8 codes, with the scale, the norm of what the codes stand for, and the norm of the error, per row."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def possible_pairs(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose cosine can reach threshold. With x = x' + e: |x.y - x'.y'| <= |x'||f| + |e||y'| + |e||f|."""
    (qa, sa, na, ea), (qb, sb, nb, eb) = a, b
    kind = np.float32 if qa.shape[1] <= 1040 else np.float64  # float32 holds the whole-number sums below 2**24 of up to 1,040 dimensions
    dots = (qa.astype(kind) @ qb.astype(kind).T) * sa[:, None].astype(np.float32) * sb[None, :].astype(np.float32)
    bound = np.outer(na, eb) + np.outer(ea, nb) + np.outer(ea, eb)
    return np.nonzero(dots + bound >= threshold - SLACK)


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of linked places: afterwards root is the least place reachable, for the links seen so far."""
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            return
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not (root[root] == root).all():
            root[:] = root[root]


def _candidates(table: pa.Table, codes: np.ndarray, block: int, threshold: float):
    """Places (p, q) of the rows of one pair of tiles whose cosine can reach threshold, block by block."""
    n = table.num_rows
    side = table.column("side").to_numpy()
    parts = [table.column(c).to_numpy() for c in ("scale", "norm", "err")]
    codes = codes.reshape(n, -1)
    left, right = np.nonzero(side != 2)[0], np.nonzero(side != 0)[0]  # 0: left, 1: both (a tile with itself), 2: right
    for lo in range(0, len(left), block):
        i = left[lo : lo + block]
        for hi in range(0, len(right), block):
            j = right[hi : hi + block]
            p, q = possible_pairs((codes[i], *(x[i] for x in parts)), (codes[j], *(x[j] for x in parts)), threshold)
            p, q = i[p], j[q]
            yield (p[p < q], q[p < q]) if side[0] == 1 else (p, q)


def _codes(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8)


def _possible(block: int, threshold: float):
    """The rows of one pair of tiles that have a partner they may link with; only codes are here."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rid")
        met = np.zeros(table.num_rows, bool)
        for p, q in _candidates(table, _codes(table), block, threshold):
            met[p] = met[q] = True
        return table.filter(pa.array(met))

    return run


def _links(block: int, threshold: float):
    """For the possible rows of one pair of tiles: of every row with a link here, its class's first row and the copies it links with.

    Pairs stay inside: a block's candidates are recomputed in full precision in slices, counted, and joined into classes, so
    what leaves is a row a vector at most, however many of them are alike.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rid")
        rid, copies = table.column("rid").to_numpy(), table.column("copies").to_numpy()
        full = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(rid), -1)
        root, links = np.arange(len(rid)), np.zeros(len(rid), np.int64)
        for p, q in _candidates(table, _codes(table), block, threshold):
            for at in range(0, len(p), SLICE):
                one, two = p[at : at + SLICE], q[at : at + SLICE]
                near = np.einsum("ij,ij->i", full[one], full[two]) >= threshold
                one, two = one[near], two[near]
                np.add.at(links, one, copies[two])
                np.add.at(links, two, copies[one])
                _join(root, one, two)
        met = links > 0
        return pa.table({"rid": pa.array(rid[met], pa.int64()), "root": pa.array(rid[root[met]], pa.int64()), "links": pa.array(links[met], pa.int64())})

    return run


def _scaled(batch: pa.RecordBatch):
    """For each length: places of the rows, and the rows as doubles, scaled by their largest component."""
    lists = batch.column("v")
    dims = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(dims)
    for dim in np.unique(dims):
        rows = np.nonzero(dims == dim)[0]
        x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)[None, :]]
        yield rows, x / np.abs(x).max(axis=1, keepdims=True)


def _encode(batches):
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        codes, scale, norm, err = [b""] * n, np.zeros(n), np.zeros(n), np.zeros(n)
        for rows, x in _scaled(batch):
            q, scale[rows], norm[rows], err[rows] = quantise(x)
            for k, r in enumerate(rows):
                codes[r] = q[k].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("label"), batch.column("dim"), batch.column("copies"), pa.array(codes, pa.binary()), pa.array(scale), pa.array(norm), pa.array(err)], ["rid", "label", "dim", "copies", "codes", "scale", "norm", "err"])


def _units(batches):
    for batch in batches:
        unit = [b""] * batch.num_rows
        for rows, x in _scaled(batch) if unit else ():
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for k, r in enumerate(rows):
                unit[r] = x[k].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(unit, pa.binary())], ["rid", "unit"])


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding array<float>, label int).

    Rows link when their labels are equal and not null and their cosine, in double precision, is at least `threshold`. Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing; so do rows of different length. A
    row's n_links counts the other rows linked directly, exact copies included; component_id is the smallest vec_id reachable.
    Repeated rows count as rows of their own. A row with a null vec_id counts as a link of others, and keeps a null component_id
    if no linked row has an id. Other columns are not read; an empty table gives no rows. 0 < threshold <= 1.

    Equal vectors of a label are one representative. Representatives of a label are dealt by hash to tiles of about `tile` rows;
    every pair of tiles is one group. First only int8 codes go there: their product and error bounds leave the rows that may have
    a partner. The full vectors of these rows alone follow, and what may pass is computed in full; only classes and numbers of
    links leave the group, never the pairs. Labels may be of any type.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding", "label", usable.alias("ok"))
    reps = rows.where("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    reps = materialise(reps.select(F.monotonically_increasing_id().alias("rid"), "label", "embedding", "least", "copies", F.size("embedding").alias("dim")), "reps")
    counts = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    kind = dict(reps.dtypes)["label"]
    v = v.alias("v")
    codes = reps.select("rid", "label", "dim", "copies", v).mapInArrow(_encode, f"rid long, label {kind}, dim int, copies long, codes binary, scale double, norm double, err double")
    placed = codes.join(counts, ["label", "dim"]).withColumn("t", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("t") == F.col("u"), 1).when(F.col("t") < F.col("u"), 0).otherwise(2)
    keyed = placed.select("label", "dim", F.least("t", "u").alias("lo"), F.greatest("t", "u").alias("hi"), side.cast("byte").alias("side"), "rid", "copies", "codes", "scale", "norm", "err")
    tiles = ["label", "dim", "lo", "hi"]
    possible = materialise(keyed.groupBy(*tiles).applyInArrow(_possible(min(tile, BLOCK), threshold), keyed.schema), "possible")
    units = reps.join(possible.select("rid").distinct(), "rid", "left_semi").select("rid", v).mapInArrow(_units, "rid long, unit binary")
    ties = materialise(possible.join(units, "rid").groupBy(*tiles).applyInArrow(_links(min(tile, BLOCK), threshold), "rid long, root long, links long"), "ties")
    degree = ties.groupBy("rid").agg(F.sum("links").alias("other"))
    roots = connected_components(ties.select(F.col("rid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rid"), "root")
    known = materialise(reps.join(degree, "rid", "left").join(roots, "rid", "left").select("label", "embedding", "least", (F.col("copies") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"), F.coalesce("root", "rid").alias("root")), "known")
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = known.join(ids, "root").select(F.col("label").alias("l"), F.col("embedding").alias("e"), "n_links", "component_id")
    linked = rows.where("ok").join(classes, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", "n_links", "component_id")
    alone = rows.where("not coalesce(ok, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
