"""Hierarchical Pitman-Yor language model: one restaurant per preceding word, all of them sharing the root as their parent.

The corpus is cut into slices, a slice's distinct words and word pairs are dealt to groups by hash, and what belongs together
meets there as packed arrays ("letters": one row per sender and group). Words are known by 64-bit XXH64, word pairs by the
48 leading bits of either word.
"""

from __future__ import annotations

import re
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, id_crc_mod, materialise
from quern.llm.letters import LETTERS, group_of, grouped, letters, rows_of

#: Discount and strength of the word contexts and of the root.
CONTEXT, ROOT = (0.7, 20.0), (0.8, 10.0)
#: Gibbs sweeps before the root's customers are counted again, sweeps left out after that, and sweeps that are averaged.
FIRST, BURN_IN, SAMPLES = 3, 1, 3
#: Rounds of a sweep. Every customer moves in one of them; the tables of a restaurant are counted again after each.
ROUNDS = 16
#: Tokens and distinct words of a slice, bytes of text taken at a time, entries that one group receives on average.
SLICE, SLICE_WORDS, CHUNK, GROUP = 1 << 21, 400_000, 1 << 20, 1 << 19
#: Letters that a slice packs and sends at a time.
LETTERS_AT_ONCE = 32
#: A context of over 1 / HOT of all tokens (and of a quarter of a group) has its dishes dealt to all groups. So HOT such contexts at the utmost.
HOT = 1 << 16
#: Ids of the context at a text's start and of the end token, in terms of texts that no word has.
START, END = b"\n", b" "
SPACE = re.compile(rb"[ \t-\r]")

WORDS, PAIRS, TABLE, ASK, SEATS, PLACES, TO_ROOT, TO_SEATS, SPLIT, TO_SLICE = range(10)


def _pack(ids: np.ndarray) -> np.ndarray:
    """48-bit ids in six bytes each."""
    return ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


# --- slices of the corpus


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _pieces(text: str):
    """The tokens of a text, about CHUNK bytes of it at a time: A-Z lower-cased, cut at x20 and x09-x0D (on bytes, lower and split do just that), then the end."""
    raw, at = text.encode().lower(), 0
    while len(raw) - at > CHUNK:
        m = SPACE.search(raw, at + CHUNK)
        end = m.start() if m else len(raw)
        yield raw[at:end].split()
        at = end
    yield [*raw[at:].split(), END]


def _slices(batches):
    import xxhash
    from pyspark import TaskContext

    number = key = TaskContext.get().partitionId() << 40
    vocabulary, keys, ids, held, before, tokens, size, starts = _Vocabulary(), [], [], [], [], [], 0, 0
    vocabulary[START], vocabulary[END]

    def out(kind):
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], np.uint64)
        cols = [pa.array([number], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([ids], pa.list_(kind)), pa.array([held], pa.list_(pa.bool_())), pa.array([[len(t) for t in tokens]], pa.list_(pa.int32()))]
        cols += [pa.array([before], pa.list_(pa.int32())), pa.array([np.concatenate(tokens).tobytes()], pa.binary()), pa.array([hashes.tobytes()], pa.binary()), pa.array([size], pa.int64()), pa.array([len(vocabulary)], pa.int64()), pa.array([starts], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["slice", "keys", "ids", "held", "lens", "before", "tokens", "words", "n", "v", "starts"])

    for batch in batches:
        kind = batch.column(0).type
        for doc, aside, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            key, last, t = key + 1, START, text.as_py() or ""
            starts += not aside
            for words in _pieces(t):
                keys.append(key), ids.append(doc), held.append(aside), before.append(vocabulary[last])
                tokens.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                size, last = size + len(words), words[-1] if words else last
                if size >= SLICE or len(vocabulary) >= SLICE_WORDS:
                    yield out(kind)
                    number, size, starts = number + 1, 0, 0
                    for x in (vocabulary, keys, ids, held, before, tokens):
                        x.clear()
                    vocabulary[START], vocabulary[END]
    if size:
        yield out(kind)


class _Slice:
    """A slice's tokens, the piece and the preceding word of each, and its distinct word pairs in the order in which they are dealt."""

    def __init__(self, row: dict, groups: int, hot: np.ndarray):
        self.hashes = np.frombuffer(row["words"], np.uint64)
        self.tokens = np.frombuffer(row["tokens"], np.int32)
        lens = np.array(row["lens"], np.int64)
        self.piece = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        self.train = ~np.array(row["held"], bool)[self.piece]
        previous = np.empty_like(self.tokens)
        previous[1:] = self.tokens[:-1]
        starts = np.cumsum(lens) - lens
        previous[starts[lens > 0]] = np.array(row["before"], np.int32)[lens > 0]
        self.groups, self.hot, self.previous = groups, hot, previous

    def pairs(self):
        """Left and right word (places) and training count of each distinct pair, their bounds by group, and the pair of each token.

        As np.unique would do it, in 32 bits where these do and with nothing kept longer than needed: two slices are in an executor at a time.
        """
        n = len(self.hashes)
        codes = self.previous.astype(np.int64) * n + self.tokens
        by = np.argsort(codes).astype(np.int32)
        codes = codes[by]
        new = np.ones(len(codes), bool)
        np.not_equal(codes[1:], codes[:-1], out=new[1:])
        codes, of = codes[new], np.empty(len(by), np.int32)
        of[by] = np.cumsum(new, dtype=np.int32) - 1
        del by, new
        left, right = (codes // n).astype(np.int32), (codes % n).astype(np.int32)
        counts = np.bincount(of[self.train], minlength=len(codes)).astype(np.uint32)
        del codes
        short = self.hashes >> np.uint64(16)
        split = np.isin(short, self.hot)[left]
        whole = np.where(split, (self.hashes[left] ^ self.hashes[right]) * np.uint64(0x9E3779B97F4A7C15), short[left] << np.uint64(16))
        group = group_of(whole, self.groups).astype(np.int32)
        del whole, split
        order = np.argsort(group, kind="stable").astype(np.int32)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return left[order], right[order], counts[order], np.searchsorted(group[order], np.arange(self.groups + 1)), place[of]


def _runs(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal values."""
    at = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])) if len(left) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(left)))


def _one_by_one(batches):
    """The rows of slices, none held while the next is worked on."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _word_letters(groups: int):
    def run(batches):
        for row in _one_by_one(batches):
            s = _Slice(row, 1, np.zeros(0, np.uint64))
            counts = np.bincount(s.tokens[s.train], minlength=len(s.hashes))
            order = np.argsort(s.hashes)
            ids, counts = s.hashes[order], counts[order]
            cuts = np.searchsorted(group_of(ids, groups), np.arange(groups + 1))
            yield letters([(WORDS, g, row["slice"], 0, 0, (ids[a:b], counts[a:b].astype(np.uint32))) for g, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a])

    return run


def _pair_letters(groups: int, hot: np.ndarray):
    def run(batches):
        for row in _one_by_one(batches):
            number, s = row["slice"], _Slice(row, groups, hot)
            left, right, counts, cuts, _ = s.pairs()
            short = s.hashes >> np.uint64(16)
            del row, s, _
            out = []
            for g, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    at, lens = _runs(left[a:b])
                    out.append((PAIRS, g, number, 0, 0, (_pack(short[left[a:b][at]]), lens.astype(np.uint32), _pack(short[right[a:b]]), counts[a:b])))
                    if len(out) >= LETTERS_AT_ONCE:
                        yield letters(out)
                        out.clear()
            yield letters(out)

    return run


# --- the root: all words, their training counts, and their customers (tables of the contexts)


def _count_words(at: int, by: dict) -> list[tuple]:
    got = [(np.frombuffer(r["parts"][0], np.uint64), np.frombuffer(r["parts"][1], np.uint32)) for r in by[WORDS]]
    ids, place = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([n for _, n in got]), len(ids)).astype(np.int64)
    cuts = np.cumsum([len(x) for x, _ in got])[:-1]
    asks = [(ASK, at, r["of"], 0, 0, (p.astype(np.int32),)) for r, p in zip(by[WORDS], np.split(place, cuts), strict=True)]
    return [(TABLE, at, -1, int(counts.sum()), int((counts > 0).sum()), (ids, counts, counts)), *asks]


def _table(by: dict) -> tuple[np.ndarray, ...]:
    row = by[TABLE][0]["parts"]
    return np.frombuffer(row[0], np.uint64), np.frombuffer(row[1], np.int64), np.frombuffer(row[2], np.int64)


def _recount(at: int, by: dict) -> list[tuple]:
    """Customers of every word: its training count, less the customers of contexts that did not open a table."""
    ids, counts, _ = _table(by)
    customers, short, asked = counts.copy(), ids >> np.uint64(16), []
    for r in by.get(TO_ROOT, ()):
        place = np.searchsorted(short, _unpack(r["parts"][0]))
        np.subtract.at(customers, place, np.frombuffer(r["parts"][1], np.int64))
        asked.append((r["of"], place))
    customers = np.where(counts > 0, np.maximum(customers, 1), 0)
    return [(TABLE, at, -1, int(customers.sum()), int((counts > 0).sum()), (ids, counts, customers)), *((TO_SEATS, g, at, 0, 0, (customers[p],)) for g, p in asked)]


def _tell_slices(at: int, by: dict) -> list[tuple]:
    _, counts, customers = _table(by)
    return [(TO_SLICE, r["of"], -1 - at, 0, 0, (counts[p := np.frombuffer(r["parts"][0], np.int32)], customers[p])) for r in by.get(ASK, ())]


def _hot_words(least: int):
    def run(batches):
        for row in rows_of(batches):
            ids, counts, _ = _table({TABLE: [row]})
            some = counts >= least
            yield pa.RecordBatch.from_arrays([pa.array(ids[some].view(np.int64)), pa.array(counts[some])], ["id", "n"])

    return run


# --- the contexts' restaurants


@cache
def _alone(discount: float, size: int = 1024) -> np.ndarray:
    """Of c customers of a dish at t tables, the chance that a given one sits alone: S(c-1, t-1) / S(c, t), generalised Stirling numbers."""
    logs, out = np.full((size + 1, size + 1), -np.inf), np.zeros((size + 1, size + 1))
    logs[0, 0] = 0.0
    for c in range(1, size + 1):
        t = np.arange(1, c + 1)
        with np.errstate(divide="ignore"):
            joins = logs[c - 1, t] + np.log(np.maximum(c - 1 - discount * t, 0))
        logs[c, t] = np.logaddexp(logs[c - 1, t - 1], joins)
        out[c, t] = np.exp(logs[c - 1, t - 1] - logs[c, t])
    return out


def alone(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """`_alone` for any count: exact up to its size, beyond by the limit for many customers at few tables, discount * (t - 1) / (c - 1)."""
    exact = _alone(discount)
    n = len(exact) - 1
    return np.where(c <= n, exact[np.minimum(c, n), np.minimum(t, n)], np.minimum(discount * (t - 1) / np.maximum(c - 1, 1), 1.0))


def tables(customers: np.ndarray, parent: np.ndarray, served: np.ndarray, discount: float, strength: float, rng) -> np.ndarray:
    """Seats each dish's customers from an empty restaurant and returns its tables: where the Gibbs sweeps start.

    customers, parent (the dish's probability in the parent) and served (tables of the whole restaurant) are per dish. A customer
    who finds n others of the dish at t tables opens a new one with odds (strength + discount * served) * parent to
    n - discount * t. Small groups are seated one by one; beyond 16, in steps of a sixteenth of the group.
    """
    t = (customers > 0).astype(np.int64)
    n = t.copy()
    live = np.nonzero(customers > 1)[0]
    while len(live):
        step = np.minimum(np.maximum(n[live] // 16, 1), customers[live] - n[live])
        fresh = (strength + discount * served[live]) * parent[live]
        t[live] += rng.binomial(step, fresh / (fresh + np.maximum(n[live] - discount * t[live], 1e-12)))
        n[live] += step
        live = live[n[live] < customers[live]]
    return t


def sweep(c: np.ndarray, t: np.ndarray, of: np.ndarray, served: np.ndarray, parent: np.ndarray, rng, level=CONTEXT, rounds: int = ROUNDS) -> None:
    """One Gibbs sweep, in place, over dishes with c customers at t tables in restaurants `of` that serve `served` tables in all.

    Customers of a dish are alike, so its state is the number of its tables. Each move takes one customer out (the table goes with
    it if it sat alone) and seats it again given all others; a sweep makes c moves of every dish, in equal shares per round. A move
    leaves the number of tables as it is, or one more or less; how many leave it before one does not is geometric, and is drawn
    at once. So the work grows with the changes, not with the customers, and the moves are those made one by one. Dishes move
    together in a round, each with its own tables up to date, then the restaurants' tables are counted again.
    """
    discount, strength = level
    some = np.flatnonzero(c > 1)

    def opens(cc, left, others, p):
        fresh = (strength + discount * (others + left)) * p
        return fresh / (fresh + np.maximum(cc - 1 - discount * left, 1e-12))

    for m in range(rounds):
        moves = c[some] * (m + 1) // rounds - c[some] * m // rounds
        live, moves = some[moves > 0], moves[moves > 0]
        at, before = of[live], t[live]
        cc, now, others, p = c[live], before.copy(), served[at] - before, parent[live]
        on = np.arange(len(live))
        while len(on):
            k, n = now[on], cc[on]
            gone = alone(n, k, discount)
            less = gone * (1 - opens(n, k - 1, others[on], p[on]))
            more = (1 - gone) * opens(n, k, others[on], p[on])
            wait = rng.geometric(np.clip(less + more, 1e-15, 1.0))
            moves[on] -= np.minimum(wait, moves[on] + 1)
            changed = moves[on] >= 0
            up = rng.random(len(on)) * (less + more) < more
            now[on[changed]] += np.where(up, 1, -1)[changed]
            on = on[moves[on] > 0]
        t[live] = now
        served += np.bincount(at, now - before, len(served))


def _customers(at: int, contexts: np.ndarray, of: np.ndarray, words: np.ndarray, dish: np.ndarray, c: np.ndarray, t: np.ndarray, hot: np.ndarray, groups: int) -> list[tuple]:
    """What the root and the split contexts need: per word and per split context, the customers that did not open a table."""
    joined = (c - t).astype(np.float64)
    per_word = np.bincount(dish, joined, len(words)).astype(np.int64)
    cuts = np.searchsorted(group_of(words << np.uint64(16), groups), np.arange(groups + 1))
    out = [(TO_ROOT, g, at, 0, 0, (_pack(words[a:b]), per_word[a:b])) for g, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    split = np.flatnonzero(np.isin(contexts, hot))
    if len(split):
        out.append((SPLIT, -1, at, 0, 0, (contexts[split], np.bincount(of, joined, len(contexts)).astype(np.int64)[split])))
    return out


def _open(hot: np.ndarray, hot_n: np.ndarray, word_groups: int):
    """Counts the pairs of a group. Pairs met once open a table each; only those met more often are seated."""

    def run(at: int, by: dict) -> list[tuple]:
        got = [r["parts"] for r in by[PAIRS]]
        runs = [np.frombuffer(p[1], np.uint32) for p in got]
        heads = np.concatenate([_unpack(p[0]) for p in got])
        left, right = np.repeat(heads, np.concatenate(runs)), np.concatenate([_unpack(p[2]) for p in got])
        n = np.concatenate([np.frombuffer(p[3], np.uint32) for p in got])
        _, first, pair = np.unique((left << np.uint64(16)) ^ (right * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
        counts = np.bincount(pair, n, len(first)).astype(np.int64)
        contexts, of_head = np.unique(heads, return_inverse=True)
        of = np.repeat(of_head, np.concatenate(runs))
        sizes = np.bincount(of, n, len(contexts)).astype(np.int64)
        if len(hot):
            k = np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)
            sizes = np.where(hot[k] == contexts, hot_n[k], sizes)
        seated = np.flatnonzero(counts > 1)
        words, dish = np.unique(right[first[seated]], return_inverse=True)
        c, of_seated = counts[seated], of[first[seated]]
        code = np.minimum(counts, 1)
        code[seated] = 2 + np.arange(len(seated))
        ends = np.cumsum([len(p[3]) // 4 for p in got])[:-1]
        heads_end = np.cumsum([len(r) for r in runs])[:-1]
        places = zip(by[PAIRS], np.split(of_head.astype(np.int32), heads_end), np.split(code[pair].astype(np.int32), ends), strict=True)
        out = [(PLACES, at, r["of"], 0, 0, (h, p)) for r, h, p in places]
        out.append((SEATS, at, -1, 0, 0, (contexts, sizes, of_seated.astype(np.int32), words, dish.astype(np.int32), c, np.ones(len(c), np.int64))))
        return out + _customers(at, contexts, of_seated, words, dish, c, np.ones(len(c), np.int64), hot, word_groups)

    return run


def _seat(total: float, distinct: float, hot: np.ndarray, hot_served: np.ndarray, word_groups: int, seed: int, last: bool):
    """The sweeps of one group, given the root's customers; at last, what the slices need of it."""

    def run(at: int, by: dict) -> list[tuple]:
        p = by[SEATS][0]["parts"]
        contexts, sizes, words = np.frombuffer(p[0], np.uint64), np.frombuffer(p[1], np.int64), np.frombuffer(p[3], np.uint64)
        of, dish = np.frombuffer(p[2], np.int32), np.frombuffer(p[4], np.int32)
        c, t = np.frombuffer(p[5], np.int64), np.frombuffer(p[6], np.int64).copy()
        rng = np.random.default_rng([seed, at])
        customers = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["parts"][0], np.int64) for r in by.get(TO_SEATS, ()))])
        parent = ((customers - ROOT[0]) / (ROOT[1] + total))[dish]

        def now() -> np.ndarray:
            served = sizes - np.bincount(of, c - t, len(sizes))
            if len(hot):
                k = np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)
                served = np.where(hot[k] == contexts, hot_served[k], served)
            return served.astype(np.float64)

        if not last:
            t = tables(c, parent, now()[of], *CONTEXT, rng)
        served = now()
        mean_t, mean_served = np.zeros(len(t)), np.zeros(len(sizes))
        for i in range(BURN_IN + SAMPLES if last else FIRST):
            sweep(c, t, of, served, parent, rng)
            if i >= BURN_IN:
                mean_t += t / SAMPLES
                mean_served += served / SAMPLES
        if not last:
            return [(SEATS, at, -1, 0, 0, (contexts, sizes, of, words, dish, c, t)), *_customers(at, contexts, of, words, dish, c, t, hot, word_groups)]
        d, out = CONTEXT[0], []
        for r in by[PLACES]:
            head, place = np.frombuffer(r["parts"][0], np.int32), np.frombuffer(r["parts"][1], np.int32)
            own = np.where(place == 1, 1 - d, 0.0)
            own[place > 1] = np.maximum(c - d * mean_t, 0)[place[place > 1] - 2]
            out.append((TO_SLICE, r["of"], at, 0, 0, (own.astype(np.float32), mean_served[head].astype(np.float32), sizes[head].astype(np.float32))))
        return out

    return run


def _split_totals(batches):
    for row in rows_of(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["parts"][0], np.int64)), pa.array(np.frombuffer(row["parts"][1], np.int64))], ["id", "n"])


# --- scores


def _score(groups: int, hot: np.ndarray, train: int, distinct: int, total: float, kind: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, answers = left.to_pylist()[0], sorted(right.to_pylist(), key=lambda r: r["of"])
        s = _Slice(row, groups, hot)
        lefts, _, _, cuts, pair = s.pairs()
        words = [r["parts"] for r in answers if r["of"] < 0][::-1]  # -1 is the first group of words
        order = np.argsort(s.hashes)
        counts, customers = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        counts[order] = np.concatenate([np.frombuffer(p[0], np.int64) for p in words])
        customers[order] = np.concatenate([np.frombuffer(p[1], np.int64) for p in words])
        seats = [r["parts"] for r in answers if r["of"] >= 0]
        own = np.concatenate([np.frombuffer(p[0], np.float32) for p in seats]).astype(float)
        lens = np.concatenate([_runs(lefts[a:b])[1] for a, b in zip(cuts, cuts[1:]) if b > a])
        served, sizes = (np.repeat(np.concatenate([np.frombuffer(p[k], np.float32) for p in seats]).astype(float), lens) for k in (1, 2))
        own, rest = own / (CONTEXT[1] + sizes), (CONTEXT[1] + CONTEXT[0] * served) / (CONTEXT[1] + sizes)
        root = np.where(counts > 0, customers - ROOT[0], ROOT[1] + ROOT[0] * distinct) / (ROOT[1] + total)
        logs = np.log10(own[pair] + rest[pair] * root[s.tokens])
        plain = np.log10((counts + 1) / (train + distinct + 1))[s.tokens]
        m = len(row["keys"])
        cols = [row["keys"], row["ids"], row["held"], row["lens"], np.bincount(s.piece, counts[s.tokens] > 0, m).astype(np.int64), np.bincount(s.piece, plain, m), np.bincount(s.piece, logs, m)]
        types = [pa.int64(), left.schema.field("ids").type.value_type, pa.bool_(), *[pa.int64()] * 2, *[pa.float64()] * 2]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "doc_id", "held_out", "n", "known", "base", "score"])

    return run


def pitman_yor_scores(docs: DataFrame, folds: int = 7, held: int = 2, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row of docs (doc_id, text).

    Learns from rows whose crc32(doc_id as text) mod `folds` is not `held` (a null doc_id is never held out; its text is learnt
    from); repeated rows count as often as they occur. A null text counts as empty: one token, the end. score: log10 of the
    text's probability, token by token; perplexity: 10 ** (-score / n_tokens). Unknown words are one event, as in the base's
    V + 1. Other columns are not read; an empty table gives no rows. Rerun on the same files, it gives the same numbers.

    Model. A training token is a customer of the restaurant of the word before it (at the start: of the start's). The tables of
    all these restaurants are customers of the root. The root's base measure has no atoms: every table there is a word of its own,
    and the mass of a new one is the probability of the unknown word. So only the contexts' tables are uncertain: they are
    seated once in order, then Gibbs sweeps take customers out and seat them again. The root's customers are held while the
    groups sweep and are counted again in between (approximate distributed Gibbs); the averaged predictive
    probabilities of the last SAMPLES sweeps give the score. In each context, known words and the unknown one share 1.

    Data. Word pairs are dealt by their context, those of a context of over 1 / `hot` of the tokens by the pair; a group gets about
    `group` entries. Pairs that occur once need no seat: they open one table. Nothing but the hot contexts' totals reaches the driver.
    """
    import xxhash

    d = docs.select("doc_id", (id_crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    slices = materialise(d.mapInArrow(_slices, f"slice long, keys array<long>, ids array<{kind}>, held array<boolean>, lens array<int>, before array<int>, tokens binary, words binary, n long, v long, starts long"), "slices")
    n, v, starts = slices.agg(F.sum("n"), F.sum("v"), F.sum("starts")).first()
    word_groups, pair_groups = (max(1, -(-(x or 0) // group)) for x in (v, n))
    words = materialise(grouped(slices.mapInArrow(_word_letters(word_groups), LETTERS), _count_words), "words")
    train, distinct = (x or 0 for x in words.where(F.col("kind") == TABLE).agg(F.sum("n"), F.sum("v")).first())

    least = max(group // 4, train // hot + 1)
    found = sorted([(xxhash.xxh64_intdigest(START) >> 16, starts)] * ((starts or 0) >= least) + [(r.id % (1 << 64) >> 16, r.n) for r in words.where(F.col("kind") == TABLE).mapInArrow(_hot_words(least), "id long, n long").collect()])
    hot_ids, hot_n = np.array([x for x, _ in found], np.uint64), np.array([x for _, x in found], np.int64)

    def split_served(sent: DataFrame) -> np.ndarray:
        """Tables of each split context: its customers, less those that did not open one."""
        got = dict(sent.where(F.col("kind") == SPLIT).mapInArrow(_split_totals, "id long, n long").groupBy("id").agg(F.sum("n")).collect()) if len(hot_ids) else {}
        return hot_n - np.array([got.get(int(x), 0) for x in hot_ids], np.int64)

    def of(sent: DataFrame, *kinds: int) -> DataFrame:
        return sent.where(F.col("kind").isin(*kinds))

    seats = places = materialise(grouped(slices.mapInArrow(_pair_letters(pair_groups, hot_ids), LETTERS), _open(hot_ids, hot_n, word_groups)), "seats")
    table, asks = words, of(words, ASK)
    for last in (False, True):
        served = split_served(seats)
        root = materialise(grouped(of(table, TABLE).unionByName(of(seats, TO_ROOT)), _recount), "root")
        total = float(of(root, TABLE).agg(F.sum("n")).first()[0] or 0)
        sent = reduce(DataFrame.unionByName, [of(seats, SEATS), of(root, TO_SEATS)] + [of(places, PLACES)] * last)
        table, before = root, (table, seats)
        seats = materialise(grouped(sent, _seat(total, float(distinct), hot_ids, served, word_groups, 1000 + last, last)), "seats")
        discard(*(x for x in before if x is not words and x is not places))
    told = materialise(grouped(of(table, TABLE).unionByName(asks), _tell_slices), "told")
    discard(words, places)
    answers = of(seats, TO_SLICE).unionByName(told)
    pieces = slices.groupBy("slice").cogroup(answers.groupBy("at")).applyInArrow(_score(pair_groups, hot_ids, int(train), int(distinct), total, kind), f"key long, doc_id {kind}, held_out boolean, n long, known long, base double, score double")
    out = pieces.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.lit(int(train)).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.drop("key").withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
