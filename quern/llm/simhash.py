"""SimHash near-duplicates through an inverted index over byte positions, count filtering and exact verification; and near-duplicates
by the Jaccard similarity of their shingles: the same index gives candidates, one over prefixes of the sets those it misses."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import connected_components, discard, materialise, packed

#: A posting list longer than this is linked through shared midpoints instead of by pairs; results are the same.
LONG_POSTINGS = 64
#: Positions in one posting's key, and the choices of them: agreement in six positions gives six shared lists, in five only one.
PLACES = 5
SLOTS = list(combinations(range(8), PLACES))
#: Shingles in that many texts of a sixteenth of them are put last in a set's order, so many of them at the utmost.
COMMON_LEAST, COMMON_MOST = 4, 100_000
#: 64-bit words of the sketch of sought sets.
SKETCH = 1 << 18
#: A list of shingle sets longer than this, with classes left to compare, is compared in tiles like a group instead of pair by pair; results are the same.
LONG_LISTS = 64
#: Sets of one group that are compared at a time, shingles in one product, and sets of small groups that are dealt to one bag.
TILE, COLUMNS, BAG = 1024, 4096, 4096


def shingle_hashes(words: list[bytes], width: int, seed: int) -> list[int]:
    """XXH64 of every run of `width` words, in order; of all words where they are fewer, none without words."""
    import xxhash

    if not words:
        return []
    text = b" ".join(words)
    n = len(words)
    if n <= width:
        return [xxhash.xxh64_intdigest(text, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, n) - 1)[: n - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(text[s:e], seed) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def simhash(hashes) -> int:
    """64 bits: a bit is 1 if it is set in over half the hashes; 0 without hashes."""
    total, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprint_words(words: list[bytes], width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a word sequence: a bit is 1 if it is set in over half the shingles' XXH64; 0 without words."""
    return simhash(shingle_hashes(words, width, seed))


def _fingerprint_udf(width: int, seed: int):
    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), np.uint64)
        for i, t in enumerate(texts):
            raw = t.as_py()
            if raw:
                # bytes.lower and bytes.split act on A-Z and on x20, x09-x0D only
                out[i] = fingerprint_words(raw.encode().lower().split(), width, seed)
        return pa.array(out.view(np.int64))

    return fingerprint


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, seed: int = 42, into: str = "fp") -> DataFrame:
    """docs with the SimHash of `text` as a signed long column `into`; null, empty and blank texts give 0."""
    return docs.withColumn(into, _fingerprint_udf(width, seed)(F.col(text)))


def _bytes_at(column, places):
    """The positional bytes at `places` side by side in one long."""
    out = F.lit(0).cast("long")
    for n, i in enumerate(places):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(column, 8 * i).bitwiseAND(F.lit(255)), 8 * n))
    return out


def postings(prints: DataFrame) -> DataFrame:
    """(slot, bytes, fp, n) of the inverted index over the byte positions of distinct fingerprints (column fp); n is the list's length, lists of one are left out.

    A list belongs to PLACES of the eight positions (slot) and the bytes there: single positions would put 1/256 of all rows into
    each list. Two fingerprints that agree in m positional bytes share C(m, PLACES) lists.
    """
    from pyspark.sql import Window

    keys = [F.struct(F.lit(n).cast("byte").alias("slot"), _bytes_at(F.col("fp"), c).alias("bytes")) for n, c in enumerate(SLOTS)]
    every = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.slot", "k.bytes", "fp")
    return every.withColumn("n", F.count("*").over(Window.partitionBy("slot", "bytes"))).where("n > 1")


def candidates(shared: DataFrame, radius: int) -> DataFrame:
    """Count filter: the pairs (a, b) of these postings that meet in as many lists as pairs within `radius` bits are sure to, C(8 - radius, PLACES)."""
    a, b = (shared.select("slot", "bytes", F.col("fp").alias(c)) for c in "ab")
    met = a.join(b, ["slot", "bytes"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("lists"))
    return met.where(F.col("lists") >= comb(8 - radius, PLACES)).select("a", "b")


def near_pairs(prints: DataFrame, radius: int = 2, long_postings: int = LONG_POSTINGS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose closure links exactly those within `radius` (at most 2) bits.

    Differing bits touch at most `radius` of the eight positional bytes. Pairs that meet in a list of `postings` are tallied over
    all their lists; those with fewer meetings than the bytes that must agree give are dropped, the rest verified bit by bit.

    A list of over `long_postings` fingerprints is not paired: its members differ only in the other bytes, and two
    lie within two bits if and only if they share a code at most one flip away from both. Each member is tied to the least
    member with such a code (every tie is itself a link), so no link is lost; a pair that meets in a long list is linked there,
    and for all others the tally over the short lists is complete.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius is 0, 1 or 2")
    if radius == 0:
        return prints.sparkSession.createDataFrame([], "a long, b long")
    shared = materialise(postings(prints), "postings")
    pairs = candidates(shared.where(F.col("n") <= long_postings), radius).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    long = shared.where(F.col("n") > long_postings)
    if long.isEmpty():
        return pairs
    flips = [F.lit(0).cast("long"), *(F.shiftleft(F.lit(1).cast("long"), b) for b in range(64))]
    if radius == 1:  # ends one bit apart: the code with the lower end's bit set to 1 is one of the two
        codes = long.select("slot", "bytes", "fp", F.explode(F.array(*(F.struct(F.lit(b).alias("bit"), F.col("fp").bitwiseOR(f).alias("code")) for b, f in enumerate(flips)))).alias("c")).select("slot", "bytes", "fp", "c.bit", "c.code")
    else:
        codes = long.select("slot", "bytes", "fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(f) for f in flips))).alias("code")).withColumn("bit", F.lit(0))
    # only codes inside the list's own bytes stay: the others repeat what other lists hold
    same = F.lit(False)
    for n, places in enumerate(SLOTS):
        same = same | ((F.col("slot") == n) & (_bytes_at(F.col("code"), places) == F.col("bytes")))
    codes = codes.where(same)
    least = codes.groupBy("slot", "bytes", "bit", "code").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    ties = codes.join(least, ["slot", "bytes", "bit", "code"]).where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(ties)


def _grouped(prints: DataFrame, link) -> DataFrame:
    """From rows (doc_id, fp): (fp, component_id, copies, root) per distinct fp, with the edges link(nodes) gives between them."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "prints")
    roots = connected_components(link(nodes)).select(F.col("node").alias("fp"), "root")
    placed = materialise(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(ids, "root").select("fp", "component_id", "copies", "root")


def components(prints: DataFrame, radius: int = 2, long_postings: int = LONG_POSTINGS) -> DataFrame:
    """From rows (doc_id, fp): (fp, component_id, copies) per distinct fingerprint.

    component_id is the smallest doc_id among all rows whose fingerprints are reachable by links of `radius` bits or less; null
    if none of them has a doc_id. Copies of a fingerprint are one node, so groups of any size cost one row here.
    """
    return _grouped(prints, lambda nodes: near_pairs(nodes.select("fp"), radius, long_postings)).select("fp", "component_id", "copies")


def simhash_near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id, text).

    Rows: one out per row in, repeats included. Null, empty and blank texts have fingerprint zero and link like any other.
    A row with a null doc_id takes part, and shares its component's smallest id (null if there is none). Texts of any length
    are read whole, 65,536 shingles at a time. Other columns of docs are not read. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs.select("doc_id", "text"), width=width, seed=seed).select("doc_id", "fp"), "fp")
    comps = components(prints, radius)
    return prints.join(comps.select("fp", "component_id"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, width: int, seed: int) -> np.ndarray:
    """The distinct shingles of a text as sorted XXH64 values; words as in the fingerprints."""
    return np.unique(np.array(shingle_hashes((text or "").encode().lower().split(), width, seed), np.uint64))


def _set_key(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes()) if len(shingles) else 0


def _set_key_udf(width: int, seed: int):
    @F.arrow_udf("long")
    def set_key(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([_set_key(shingle_set(t.as_py(), width, seed)) for t in texts], np.uint64).view(np.int64))

    return set_key


def _set_prints(width: int, seed: int):
    """Rows (doc_id, text) to (doc_id, fp, sim): the key of a text's set of shingles, and the SimHash of the set."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingle_set(t.as_py(), width, seed) for t in batch.column(1).slice(at, 500)]
                cols = [np.array([f(x) for x in sets], np.uint64).view(np.int64) for f in (_set_key, simhash)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), *map(pa.array, cols)], ["doc_id", "fp", "sim"])

    return run


def prefix_length(n: int, similarity: float) -> int:
    """How many shingles of n, in an order common to all sets, are sure to hold one of any set of that similarity or more."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def _ordered(own: np.ndarray, common: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """The prefix of a set: its order is that of the hashes, with the `common` shingles, commonest last, at the end."""
    if len(own) and len(common):
        i = np.minimum(np.searchsorted(common, own, sorter=place), len(common) - 1)
        hit = common[place[i]] == own
        own = own[np.argsort(np.where(hit, 1 + place[i], 0), kind="stable")]
    return own[: prefix_length(len(own), similarity)]


def _prefixes(width: int, seed: int, similarity: float, common: np.ndarray):
    """Rows (text) to postings (shingle, fp, size, at) of their prefixes, once a task for equal sets."""

    def run(batches):
        place, seen = np.argsort(common), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                keys, sizes, lists = [], [], []
                for t in batch.column(0).slice(at, 500):
                    own = shingle_set(t.as_py(), width, seed)
                    key = _set_key(own)
                    if len(own) and key not in seen:
                        if len(seen) >= 1 << 20:
                            seen.clear()
                        seen.add(key)
                        keys.append(key), sizes.append(len(own)), lists.append(_ordered(own, common, place, similarity))
                lens = [len(x) for x in lists]
                cols = [np.concatenate([np.zeros(0, np.uint64), *lists]).view(np.int64), np.repeat(np.array(keys, np.uint64).view(np.int64), lens), np.repeat(np.array(sizes, np.int32), lens)]
                cols.append(np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in lens)]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shingle", "fp", "size", "at"])

    return run


def _whole_sets(width: int, seed: int, sketch):
    """Rows (text) to (fp, shingles) of the sets that the sketch of sought ones may hold; shingles by 32 bits of their hashes."""

    def run(batches):
        bits, done = sketch.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                keys, lists = [], []
                for t in batch.column(0).slice(at, 500):
                    own = shingle_set(t.as_py(), width, seed)
                    key = _set_key(own)
                    if len(own) and bits[key >> 6 & SKETCH - 1] >> np.uint64(key & 63) & np.uint64(1) and key not in done:
                        if len(done) >= 1 << 20:
                            done.clear()
                        done.add(key)
                        keys.append(key), lists.append(np.unique((own >> np.uint64(32)).astype(np.uint32)))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                flat = np.concatenate([np.zeros(0, np.uint32), *lists]).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["fp", "s"])

    return run


def _sought_sets(docs: DataFrame, sought: DataFrame, width: int, seed: int) -> DataFrame:
    """(fp, s) of the sought sets (fp).

    Only these are shuffled: a sketch of fixed size (SKETCH words of 64 bits) tells most of the others apart where the texts
    are. Where it fills up, it spares less work and loses nothing.
    """
    words = sought.groupBy(F.shiftrightunsigned("fp", 6).bitwiseAND(F.lit(SKETCH - 1)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(fp & 63 as int))")).alias("bits"))
    bits = np.zeros(SKETCH, np.uint64)
    for w, x in words.collect():
        bits[w] = x % (1 << 64)
    whole = docs.select("text").mapInArrow(_whole_sets(width, seed, docs.sparkSession.sparkContext.broadcast(bits)), "fp long, s array<int>").join(sought, "fp", "left_semi")
    return materialise(whole.groupBy("fp").agg(F.first("s").alias("s")), "sets")


def linked_sets(sets: list[np.ndarray], similarity: float, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (p, q), p in left, q in right, of the pairs of sets with that similarity, by products of their incidence, some shingles at a time."""
    size = np.array([len(x) for x in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    _, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = n[code] > 1
    owner, code = owner[often], np.unique(code[often], return_inverse=True)[1] if often.any() else code[often]
    shared = np.zeros((len(left), len(right)), np.float32)
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        lo, hi = np.searchsorted(code, [at, at + COLUMNS])
        sides = []
        for side, rows in enumerate((left, right)):
            m = np.zeros((len(rows), COLUMNS), np.float32)
            own = place[side, owner[lo:hi]]
            m[own[own >= 0], code[lo:hi][own >= 0] - at] = 1
            sides.append(m)
        shared += sides[0] @ sides[1].T
    return np.nonzero(shared >= similarity * (size[left][:, None] + size[right][None, :] - shared) - 1e-4)


def _group_links(similarity: float):
    """For the sets of some groups and pairs of tiles: each set that links inside, with the first of its class."""

    def run(table: pa.Table) -> pa.Table:
        from quern.llm.embed_dedup import _join

        table = table.sort_by([("grp", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("fp", "ascending")])
        fp, side = table.column("fp").to_numpy(), table.column("side").to_numpy()
        keys = np.stack([table.column(c).to_numpy() for c in ("grp", "lo", "hi")])
        cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(fp)]])
        lists = table.column("s").combine_chunks()
        root = np.arange(len(fp))
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                sets = [lists[int(i)].values.to_numpy() for i in range(a, b)]
                left, right, own = np.flatnonzero(side[a:b] != 2), np.flatnonzero(side[a:b] != 0), np.arange(b - a)
                p, q = linked_sets(sets, similarity, left, right)
                _join(own, left[p], right[q])
                root[a:b] = own + a
        met = root != np.arange(len(fp))
        return pa.table({"a": pa.array(fp[root[met]], pa.int64()), "b": pa.array(fp[met], pa.int64())})

    return run


def _tile_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) inside groups of sets, from members (grp, fp): all pairs of a group are compared, in tiles of TILE; only what joins classes leaves."""
    tiles = members.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    bags = max(1, members.count() // BAG)
    placed = members.join(tiles, "grp").withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("side", F.when(F.col("t") == F.col("u"), 1).when(F.col("t") < F.col("u"), 0).otherwise(2).cast("byte"))
    placed = placed.select("grp", F.least("t", "u").alias("lo"), F.greatest("t", "u").alias("hi"), "side", "fp")
    rows = placed.join(sets, "fp").withColumn("bag", F.when(F.col("hi") == 0, F.pmod(F.xxhash64("grp"), F.lit(bags))).otherwise(F.xxhash64("grp", "lo", "hi")))
    return rows.groupBy("bag").applyInArrow(_group_links(similarity), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of sets that have the similarity; pairs with an end outside of `sets` have not."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared) - 1e-9).select("a", "b")


def simhash_candidates(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of sets (fp) from prints (fp, sim): the first set of a fingerprint with the others of the same, and with the first ones of fingerprints near it.

    Fingerprints meet in the inverted index over byte positions, pass the count filter and differ in `radius` bits at the utmost.
    """
    firsts = materialise(prints.groupBy("sim").agg(F.min("fp").alias("first")), "firsts")
    near = near_pairs(firsts.select(F.col("sim").alias("fp")), radius)
    a, b = (firsts.select(F.col("sim").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    near = near.join(a, "a").join(b, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    same = prints.join(firsts, "sim").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    return near.unionByName(same).distinct()


def similar_pairs(docs: DataFrame, prints: DataFrame, similarity: float, width: int, seed: int, common: np.ndarray) -> DataFrame:
    """Edges (a, b) between distinct shingle sets (fp) whose closure links exactly those of a Jaccard similarity of `similarity` or more.

    First come the pairs whose SimHashes (prints: fp, sim) are within two bits, as far as their sets have the similarity. Most
    similar sets have fingerprints further apart, and no radius is sure to hold them; so the rest is found by the sets themselves.

    Two similar sets share a shingle among the first of each (`prefix_length`) in any order common to all: the texts (doc_id, text)
    are listed under these shingles. Every set joins the group of the head (least set) it shares most lists with; so near copies
    come to one group, in tiles of TILE. There all pairs are held against each other by matrix products, and only classes
    leave. What is left are lists with sets of different classes. Those of over LONG_LISTS sets are compared like a group, so
    that what is written does not grow with the square of a list. Of the others, the pairs in different groups and classes whose
    sizes and places leave room for the overlap are verified one by one. Texts without words are one set.
    """
    from pyspark.sql import Window

    posts = docs.select("text").mapInArrow(_prefixes(width, seed, similarity, common), "shingle long, fp long, size int, at int")
    by = Window.partitionBy("shingle")
    lists = posts.withColumn("head", F.min("fp").over(by)).withColumn("most", F.max("fp").over(by)).where("head <> most")
    lists = materialise(lists.drop("most").distinct(), "lists")
    votes = lists.groupBy("fp", "head").agg(F.count("*").alias("n")).groupBy("fp").agg(F.max(F.struct("n", (-F.col("head")).alias("h"))).alias("m"))
    members = materialise(votes.select("fp", (-F.col("m.h")).alias("grp")), "members")
    sets = _sought_sets(docs, members.select("fp"), width, seed)

    first = materialise(_tile_links(members, sets, similarity), "links")

    # equal sets have equal prints; copies are merged before the shuffle
    own = prints.groupBy("fp").agg(F.min("sim").alias("sim")).join(members, "fp", "left_semi")
    near = materialise(_verified(simhash_candidates(own), sets, similarity), "near")

    known = members.join(connected_components(first.unionByName(near)), F.col("fp") == F.col("node"), "left").select("fp", "grp", F.coalesce("root", "fp").alias("root"))
    tagged = lists.drop("head").join(materialise(known, "known"), "fp")
    mixed = tagged.withColumn("lo", F.min("root").over(by)).withColumn("hi", F.max("root").over(by)).where("lo <> hi")
    mixed = materialise(mixed.withColumn("n", F.count("*").over(by)).drop("lo", "hi"), "mixed")
    long = materialise(mixed.where(F.col("n") > LONG_LISTS).select(F.col("shingle").alias("grp"), "fp"), "long")
    third = materialise(_tile_links(long, sets, similarity), "links")
    # members of one class and group stand together, so that only classes are paired
    parts = mixed.where(F.col("n") <= LONG_LISTS).groupBy("shingle", "root", "grp").agg(F.collect_list(F.struct("fp", "size", "at")).alias("m"))
    one, two = (parts.select("shingle", F.col("root").alias(f"root_{k}"), F.col("grp").alias(f"grp_{k}"), F.col("m").alias(k)) for k in "ab")
    met = one.join(two, "shingle").where("root_a < root_b and grp_a <> grp_b").select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
    alike = F.least("a.size", "b.size") >= similarity * F.greatest("a.size", "b.size") - 1e-6
    need = F.ceil((F.col("a.size") + F.col("b.size")) * F.lit(similarity / (1 + similarity)) - 1e-6)
    # the first shared shingle has no shared one before it, so its places bound the overlap
    room = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    pairs = materialise(met.where(alike & (room >= need)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct(), "pairs")
    second = materialise(_verified(pairs, sets, similarity), "links")
    discard(lists, members, sets, mixed, long, pairs)
    return first.unionByName(near).unionByName(second).unionByName(third)


def _shingles(width: int, seed: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = [shingle_set(t.as_py(), width, seed).view(np.int64) for t in batch.column(0).slice(at, 500)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], ["shingles"])

    return run


def common_shingles(docs: DataFrame, width: int, seed: int) -> np.ndarray:
    """The shingles found in COMMON_LEAST or more of a sixteenth of the texts, COMMON_MOST at the utmost, rarest first.

    They only order the sets (boilerplate last), so what the sample misses costs time and loses no pair.
    """
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(16)) == 0).select("text").mapInArrow(_shingles(width, seed), "shingles array<long>")
    top = some.select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_LEAST).orderBy(F.desc("n"), "h").limit(COMMON_MOST)
    return np.array([r.h for r in top.collect()][::-1], np.int64).view(np.uint64)


def keep_one_per_group(docs: DataFrame, similarity: float = 0.8, width: int = 5, seed: int = 42) -> DataFrame:
    """docs with one row of each group of near-duplicates, and its columns as they were.

    Near-duplicates: texts whose sets of `width`-word shingles have a Jaccard similarity of `similarity` or more, and what such links
    connect. The row with the group's smallest doc_id stays. Where several rows carry that doc_id, or a group has rows without doc_id
    only, the row with the smallest set key and text stays. Texts are shuffled once, by doc_id, to meet the ids that stay.
    """
    docs, unpack = packed(docs, "doc_id", "text")
    names = docs.columns
    texts = docs.select("doc_id", "text")
    common = common_shingles(texts, width, seed)
    prints = materialise(texts.mapInArrow(_set_prints(width, seed), f"doc_id {dict(texts.dtypes)['doc_id']}, fp long, sim long"), "keys")
    comps = materialise(_grouped(prints, lambda nodes: similar_pairs(texts, prints, similarity, width, seed, common)), "comps")
    heads = materialise(prints.join(comps.select("fp", "component_id"), "fp").where("doc_id = component_id or component_id is null").groupBy("doc_id").agg(F.count("*").alias("rows")), "heads")
    # the table of ids grows with the documents: always a shuffle by id, at every size, with the ids as the hashed side
    clear = docs.join(heads.where("doc_id is not null and rows = 1").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(*names)
    doubtful = heads.where("doc_id is null or rows > 1")
    if doubtful.isEmpty():
        return unpack(clear)
    from pyspark.sql import Window

    again = docs.join(doubtful.select(F.col("doc_id").alias("_h")), F.col("doc_id").eqNullSafe(F.col("_h")), "left_semi").withColumn("_fp", _set_key_udf(width, seed)(F.col("text")))
    again = again.join(comps.select(F.col("fp").alias("_fp"), F.col("component_id").alias("_c"), F.col("root").alias("_root")), "_fp").where("doc_id = _c or _c is null")
    w = Window.partitionBy("_root").orderBy("_fp", "text")
    return unpack(clear.unionByName(again.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*names)))
