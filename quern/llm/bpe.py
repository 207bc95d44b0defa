"""Byte-level BPE as a monoid: halves are encoded on their own and joined by re-encoding a window that grows until it settles."""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are merged by the definition at once; the halves of anything longer are encoded on their own. In longer windows a heap finds the next merge.
LEAF, SHORT = 4, 24
#: Pieces, and halves (up to HALF bytes) and token pairs, that a task remembers; then it starts anew.
PIECES, MEMORY, HALF = 250_000, 150_000, 8


#: Above any rank.
NEVER = 1 << 62


class Vocabulary:
    """Merge ranks of a .tiktoken file, with its pattern. Tokens are ids; bytes in, ids out."""

    def __init__(self, lines: bytes, pattern: str):
        self.lines, self.pattern = lines, pattern
        self._pairs: dict[tuple[int, int], list[int]] = {}
        self._halves: dict[bytes, list[int]] = {}

    def __reduce__(self):
        return (type(self), (self.lines, self.pattern))

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in self.lines.splitlines() if x)}

    @cached_property
    def tokens(self) -> dict[int, bytes]:
        return {v: k for k, v in self.ranks.items()}

    @cached_property
    def find(self):
        import regex

        return regex.compile(self.pattern).findall

    def merge(self, raw: bytes) -> list[int]:
        """The definition: join the neighbours of the lowest rank, leftmost first, until no pair has a rank."""
        if len(raw) > SHORT:
            return self._merge_long(raw)
        rank = self.ranks.get
        parts = [raw[i : i + 1] for i in range(len(raw))]
        ranks = [rank(raw[i : i + 2], NEVER) for i in range(len(raw) - 1)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same with the pairs in a heap: a part is known by where it starts, `end` has where it ends, 0 once it is merged away."""
        n, rank = len(raw), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # one of the two has changed since
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i > 0 and (r := rank(raw[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def pair(self, a: int, b: int) -> list[int]:
        """The encoding of two tokens' bytes."""
        out = self._pairs.get((a, b))
        if out is None:
            if len(self._pairs) > MEMORY:
                self._pairs.clear()
            out = self._pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b])
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens, side by side, encode to themselves: if the first does, what follows is the second's own encoding."""
        return (self._pairs.get((a, b)) or self.pair(a, b))[0] == a

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the two encodings' texts together.

        A sequence of tokens is the encoding of its text if and only if every two neighbours encode to themselves: a merge
        across a border that the sequence lacks would be the first such merge in the pair's own encoding too. So it is enough
        that the window's own encoding meets the token before it and the one after it in stable pairs; else the window doubles.
        """
        if not left or not right:
            return left + right
        window = self.pair(left[-1], right[0])
        a, b, k = len(left) - 1, 1, 1
        while not ((not a or self.stable(left[a - 1], window[0])) and (b == len(right) or self.stable(window[-1], right[b]))):
            k *= 2
            a, b = max(0, len(left) - k), min(k, len(right))
            window = self.merge(b"".join(map(self.tokens.__getitem__, left[a:] + right[:b])))
        return left[:a] + window + right[b:]

    def tree(self, raw: bytes) -> list[int]:
        """Both halves on their own, joined; halves that many pieces share are remembered."""
        if len(raw) <= HALF and (out := self._halves.get(raw)) is not None:
            return out
        if len(raw) <= LEAF:
            out = self.merge(raw)
        else:
            mid = len(raw) // 2
            out = self.join(self.tree(raw[:mid]), self.tree(raw[mid:]))
        if len(raw) <= HALF:
            if len(self._halves) > MEMORY:
                self._halves.clear()
            self._halves[raw] = out
        return out

    def encode_piece(self, raw: bytes) -> list[int]:
        """A piece that is a token as a whole gives that token, whether merging arrives at it or not; all others go through the tree."""
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.tree(raw)

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree."""
        if len(ids) <= 2:
            return b"".join([self.tokens[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])

    def encode(self, text: str) -> list[int]:
        return [t for piece in self.find(text) for t in self.encode_piece(piece.encode())]


def load(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    import public_tokenizers as public

    with open(path or public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        v = Vocabulary(f.read(), pattern or public.PATTERN)
    return v


class _Memo(dict):
    """piece -> (ids as text, how many, the bytes they decode to)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str):
        ids = self.vocabulary.encode_piece(piece.encode())
        out = (",".join(map(str, ids)), len(ids), self.vocabulary.decode(ids))
        if len(piece) <= 64:
            self[piece] = out
        return out


def _digest(shared):
    def run(batches):
        vocabulary = shared.value
        memo = _Memo(vocabulary)
        for batch in batches:
            n, ids, raw = [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                if len(memo) > PIECES:
                    memo.clear()
                one, two, count = hashlib.sha256(), hashlib.sha256(), 0
                pieces = vocabulary.find(text)
                for at in range(0, len(pieces), 1 << 18):
                    rows = list(map(memo.__getitem__, pieces[at : at + (1 << 18)]))
                    count += sum([r[1] for r in rows])
                    one.update(("," * bool(at) + ",".join([r[0] for r in rows])).encode())
                    two.update(b"".join([r[2] for r in rows]))
                n.append(count)
                ids.append(one.hexdigest())
                raw.append(two.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(raw)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs (doc_id, text): encoded whole, decoded again.

    A null text counts as empty: no tokens, digests of nothing. Rows repeat as they came, null ids stay null, other columns
    are not read, an empty table gives no rows. Each row is worked on alone; the vocabulary (fixed size) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_digest(shared), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, text: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """docs with the token ids of `text` as array<int> column `into`; null gives an empty array."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.encode(t.as_py() or "") for t in texts], pa.list_(pa.int32()))

    return docs.withColumn(into, encode(F.col(text)))


def bpe_decode(docs: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with the bytes of `ids` as binary column `into`; null gives null, an id outside the vocabulary raises KeyError."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    @F.arrow_udf("binary")
    def decode(rows: pa.Array) -> pa.Array:
        return pa.array([None if (x := r.as_py()) is None else shared.value.decode(x) for r in rows], pa.binary())

    return docs.withColumn(into, decode(F.col(ids)))
