"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies.

The corpus is cut into slices. A slice names each of its pre-tokens once, whatever the number of documents that have it, and
deals them to groups by hash; what a group receives is made distinct and counted; the numbers go back to the slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise
from quern.llm.letters import LETTERS, group_of, grouped, letters, rows_of

#: Pre-tokens and distinct ones of a slice, entries that one group receives on average.
SLICE, SLICE_WORDS, GROUP = 1 << 21, 400_000, 1 << 18
ASK, ANSWER = range(2)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PieceCounter:
    """Numbers of pieces of distinct pre-tokens, by the library itself."""

    def __init__(self, model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.specials = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)

    def count(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros(len(tokens), np.int32)
        for at in range(0, len(tokens), 1024):
            out[at : at + 1024] = [len(e) for e in self.tokenizer.encode_batch_fast(tokens[at : at + 1024], add_special_tokens=False)]
        return out


def _pre_tokens(specials: list[str]):
    import re

    import regex

    find = regex.compile(PATTERN).findall
    if not specials:
        return find
    cut = re.compile("(" + "|".join(map(re.escape, specials)) + ")")

    def run(text: str) -> list[str]:
        if not any(s in text for s in specials):
            return find(text)
        # a special string in a text is one pre-token of its own, as the library has it
        return [t for i, part in enumerate(cut.split(text)) for t in ([part] if i % 2 else find(part))]

    return run


class _Vocabulary(dict):
    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        return n


def _packed(values: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(values.tobytes(), asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    """n whole numbers of 32 bits."""
    return np.frombuffer(pa.Codec("zstd").decompress(raw, 4 * n, asbytes=True), np.int32) if n else np.zeros(0, np.int32)


def _strings(tokens: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("t", pa.string())]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.record_batch([tokens], ["t"]))
    return sink.getvalue().to_pybytes()


def _read_strings(raw: bytes) -> pa.Array:
    return pa.ipc.open_stream(raw).read_all().column(0).combine_chunks()


def _hashes(tokens, n: int) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, n)


def _slices(shared):
    """Rows (doc_id, text) to slices: the documents' bags of pre-tokens as places in the slice's vocabulary, in order, with their frequencies."""

    def run(batches):
        from pyspark import TaskContext

        split = _pre_tokens(PieceCounter(shared.value).specials)
        number = TaskContext.get().partitionId() << 40
        vocabulary, ids, sizes, found, size = _Vocabulary(), [], [], [], 0

        def out(kind):
            n = len(vocabulary)
            lens = np.array([len(x) for x in found], np.int64)
            # pre-tokens stand in the order of their hashes, which is the order of the groups
            order = np.argsort(_hashes(vocabulary, n))
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            codes, times = np.unique(np.repeat(np.arange(len(found)), lens) * max(n, 1) + place[np.concatenate([np.zeros(0, np.int32), *found])], return_counts=True)
            bags = np.bincount(codes // max(n, 1), minlength=len(found))
            tokens = pa.array(list(vocabulary), pa.string()).take(pa.array(order))
            cols = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())), pa.array([bags], pa.list_(pa.int32()))]
            cols += [pa.array([x], pa.binary()) for x in (_packed((codes % max(n, 1)).astype(np.int32)), _packed(times.astype(np.int32)), _strings(tokens))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([n], pa.int64())], ["slice", "ids", "sizes", "bags", "places", "times", "tokens", "v"])

        for batch in batches:
            kind = batch.column(0).type
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py() or ""
                ids.append(doc), sizes.append(len(text.encode()))
                words = split(text)
                found.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= SLICE or len(vocabulary) >= SLICE_WORDS:
                    yield out(kind)
                    number, size = number + 1, 0
                    for x in (vocabulary, ids, sizes, found):
                        x.clear()
        if ids:
            yield out(kind)

    return run


def _ask(groups: int):
    def run(batches):
        for row in rows_of(batches):
            tokens = _read_strings(row["tokens"])
            cuts = np.searchsorted(group_of(_hashes(tokens.to_pylist(), len(tokens)), groups), np.arange(groups + 1))
            yield letters([(ASK, g, row["slice"], int(b - a), 0, (_strings(tokens.slice(a, b - a)),)) for g, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a])

    return run


def _count(shared):
    """The number of pieces of each distinct pre-token of a group, told to every slice that asks."""

    def run(at: int, by: dict) -> list[tuple]:
        coded = pc.dictionary_encode(pa.chunked_array([_read_strings(r["parts"][0]) for r in by[ASK]]).combine_chunks())
        each = PieceCounter(shared.value).count(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ends = np.cumsum([r["n"] for r in by[ASK]])[:-1]
        return [(ANSWER, r["of"], at, r["n"], 0, (_packed(x),)) for r, x in zip(by[ASK], np.split(each, ends), strict=True)]

    return run


def _sum(left: pa.Table, right: pa.Table) -> pa.Table:
    row = left.to_pylist()[0]
    answers = sorted(right.to_pylist(), key=lambda r: r["of"])
    each = np.concatenate([np.zeros(0, np.int32), *(_unpacked(r["parts"][0], r["n"]) for r in answers)]).astype(np.int64)
    lens = np.array(row["bags"], np.int64)
    n = int(lens.sum())
    pieces = each[_unpacked(row["places"], n)] * _unpacked(row["times"], n)
    ends = np.concatenate([[0], np.cumsum(pieces)])[np.concatenate([[0], np.cumsum(lens)])]
    kind = left.schema.field("ids").type.value_type
    return pa.table([pa.array(row["ids"], kind), pa.array(row["sizes"], pa.int64()), pa.array(np.diff(ends), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs (doc_id, text), as the tokenizer file at `path` counts.

    Every text becomes a bag of pre-tokens. Each distinct pre-token of a slice (about SLICE pre-tokens) goes to its group once, is
    counted there once for the whole corpus, and its number comes back to the bags: a pre-token that all documents share costs
    one entry a slice. Numbers of pieces, never ids, are summed per document. Null texts are empty; rows repeat as they came; null ids
    stay null; other columns are not read; an empty table gives no rows.
    """
    import public_tokenizers as public

    with open(path or public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"slice long, ids array<{kind}>, sizes array<long>, bags array<int>, places binary, times binary, tokens binary, v long"
    slices = materialise(docs.select("doc_id", "text").mapInArrow(_slices(shared), schema), "bags")
    groups = max(1, -(-(slices.agg(F.sum("v")).first()[0] or 0) // group))
    answers = materialise(grouped(slices.mapInArrow(_ask(groups), LETTERS), _count(shared)), "pieces")
    bags = slices.select("slice", "ids", "sizes", "bags", "places", "times")
    out = bags.groupBy("slice").cogroup(answers.groupBy("at")).applyInArrow(_sum, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
