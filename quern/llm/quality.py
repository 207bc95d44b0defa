"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACES, materialise, packed

#: Bits of a packed long that hold a window's place; longer texts skip the packed step.
PLACE_BITS = 24
GOOD, BAD, ABSTAIN = 1, 0, -1
#: Smoothing towards P(good vote | class, the rule votes): good texts rarely show a defect, and a bad text need not show every one.
GOOD_SMOOTH, BAD_SMOOTH = 0.99, 0.6
#: Prior probability of good before any row is seen.
PRIOR = 0.8


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_marks (ASCII punctuation) and n_stops (all long).

    All work stays within a row, nothing is shuffled. Forty bits of each three-word window's hash and its place are packed
    into one long and sorted as primitives, so windows that may be equal stand side by side. Only those are sorted again by
    their full 64-bit hash; the places that then have an equal neighbour, in order, add min(3, step) words each. O(n log n)
    for a text of n words. A null text counts as empty.
    """
    d = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("_w", F.array_remove(F.split("_t", "[ \\t-\\r]+"), ""))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    packed = F.transform("_w", lambda x, i: F.shiftleft(F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)), PLACE_BITS).bitwiseOR(i.cast("long")))
    # the last two places have no window; they are cut off
    d = d.withColumn("_s", F.sort_array(F.slice(packed, 1, F.greatest(F.size("_w") - 2, F.lit(0)))))
    high = lambda p: F.shiftrightunsigned(p, PLACE_BITS)
    alike = lambda p, i, k: F.coalesce(high(F.get("_s", i + k)) == high(p), F.lit(False))
    places = F.transform(F.filter("_s", lambda p, i: alike(p, i, 1) | alike(p, i, -1)), lambda p: p.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))
    everywhere = F.sequence(F.lit(0), F.greatest(F.size("_w") - 3, F.lit(0)))
    d = d.withColumn("_c", F.when(F.size("_w") < 3, F.array().cast("array<int>")).when(F.size("_w") > 1 << PLACE_BITS, everywhere).otherwise(places))
    d = d.withColumn("_s", F.sort_array(F.transform("_c", lambda i: F.struct(window(i).alias("h"), i.alias("i")))))
    near = lambda p, i, k: F.coalesce(F.get("_s", i + k)["h"] == p["h"], F.lit(False))
    d = d.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda p, i: near(p, i, 1) | near(p, i, -1)), lambda p: p["i"])))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    repeats = F.aggregate("_p", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    n = lambda c: c.cast("long")
    return d.select(
        *docs.columns,
        n(F.size("_w")).alias("n_words"),
        n(F.length(F.array_join("_w", ""))).alias("word_chars"),
        n(F.regexp_count("_t", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        n(F.size("_l")).alias("n_lines"),
        n(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        n(repeats).alias("n_repeat_words"),
        n(F.regexp_count("_t", F.lit(r"[!-/:-@\[-`{-~]"))).alias("n_marks"),
        n(F.regexp_count("_t", F.lit("[.!?]"))).alias("n_stops"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def votes() -> dict[str, Column]:
    """Each rule's vote over the columns of `base_features`: 1 good, 0 bad, -1 abstains."""
    w = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    dup, rep = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_repeat_words") / w
    symbols, mean, marks, dense, stops = F.col("n_symbols") / w, F.col("word_chars") / w, F.col("n_marks") / chars, F.col("n_marks") / w, F.col("n_stops") / w
    short = F.col("n_words") < 20
    return {
        "length": _vote(F.col("n_words") >= 80, F.col("n_words") < 20),
        "symbols": _vote(symbols < 0.02, symbols > 0.1),
        "marks": _vote(marks < 0.06, marks > 0.12),
        "density": _vote(dense < 0.3, dense > 0.6),
        "word_length": _vote((mean >= 3) & (mean <= 9), (mean < 2) | (mean > 14)),
        "dup_lines": _vote((dup < 0.05) & ~short, (dup > 0.4) & (F.col("n_dup_lines") >= 3)),
        "repeats": _vote((rep < 0.1) & ~short, rep > 0.4),
        "sentences": _vote((stops > 0.01) & (stops < 0.5), (stops > 0.8) | ((stops == 0) & (F.col("n_words") >= 50))),
    }


@dataclass(frozen=True)
class RuleModel:
    """Prior probability of good, and for each rule P(good vote | good, it votes) and P(good vote | bad, it votes)."""

    prior: float
    rules: dict[str, tuple[float, float]]

    def accuracy(self, rule: str) -> float:
        """Probability that a vote of the rule is right, the classes taken at the prior."""
        g, b = self.rules[rule]
        return self.prior * g + (1 - self.prior) * (1 - b)

    def posterior(self, vote: dict[str, Column]) -> Column:
        """P(good | votes), as an expression over vote columns; an abstention says nothing."""
        score = F.lit(log(self.prior / (1 - self.prior)))
        for name, (g, b) in self.rules.items():
            score = score + F.when(vote[name] == GOOD, log(g / b)).when(vote[name] == BAD, log((1 - g) / (1 - b))).otherwise(0.0)
        return 1 / (1 + F.exp(-score))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda s, x: s + value(x))


def _em_step(rows: Column, places: Column, state: Column, total: Column, strength: Column) -> Column:
    """One E and M step. rows: array of (v array<int>, n double); state: struct(prior, g, b), arrays by rule."""

    def score(p, s):
        per_rule = F.transform(places, lambda r: F.when(p["v"][r] == GOOD, F.log(s["g"][r] / s["b"][r])).when(p["v"][r] == BAD, F.log((1 - s["g"][r]) / (1 - s["b"][r]))).otherwise(0.0))
        return F.log(s["prior"] / (1 - s["prior"])) + F.aggregate(per_rule, F.lit(0.0), lambda a, x: a + x)

    def maximise(weighed):
        good = lambda p: p["q"]
        bad = lambda p: p["n"] - p["q"]

        def share(r, weight, smooth):
            right = _total(weighed, lambda p: F.when(p["v"][r] == GOOD, weight(p)).otherwise(0.0))
            cast = _total(weighed, lambda p: F.when(p["v"][r] != ABSTAIN, weight(p)).otherwise(0.0))
            return (right + strength * smooth) / (cast + strength)

        prior = (_total(weighed, good) + strength * PRIOR) / (total + strength)
        return F.struct(prior.alias("prior"), F.transform(places, lambda r: share(r, good, GOOD_SMOOTH)).alias("g"), F.transform(places, lambda r: share(r, bad, BAD_SMOOTH)).alias("b"))

    weighed = F.transform(rows, lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), (p["n"] / (1 + F.exp(-score(p, state)))).alias("q")))
    return _let(weighed, maximise)


def fit(voted: DataFrame, names: list[str], rounds: int = 25) -> RuleModel:
    """Expectation-maximisation over the vote columns v_<name> of all rows.

    Rows meet only as counts per vote pattern (3 ** rules at most, a bound that data cannot move), combined before the shuffle.
    All rounds run over these counts inside one expression of one row, so only the parameters reach the driver. Counts are
    smoothed towards rules whose bad votes are right far more often than not, so the classes cannot swap. No rows: the
    smoothing alone.
    """
    cols = [F.col(f"v_{n}").cast("int") for n in names]
    patterns = voted.groupBy(*(f"v_{n}" for n in names)).agg(F.count("*").cast("double").alias("n"))
    one = patterns.select(F.array(*cols).alias("v"), "n").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("rows"))
    one = materialise(one.select("rows", F.aggregate("rows", F.lit(0.0), lambda s, p: s + p["n"]).alias("total")), "patterns")
    one = one.withColumn("strength", F.greatest(F.lit(2.0), 0.01 * F.col("total")))
    k = len(names)
    start = F.struct(F.lit(PRIOR).alias("prior"), F.array_repeat(F.lit(GOOD_SMOOTH), k).alias("g"), F.array_repeat(F.lit(BAD_SMOOTH), k).alias("b"))
    places = F.sequence(F.lit(0), F.lit(k - 1))
    step = lambda s, _: _em_step(F.col("rows"), places, s, F.col("total"), F.col("strength"))
    m = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("m")).first()["m"]
    return RuleModel(m["prior"], {name: (m["g"][i], m["b"][i]) for i, name in enumerate(names)})


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, quality (the posterior) and one vote column per rule, for every row of docs.

    kept: the base tests pass and the posterior is at least `threshold`. A null text counts as empty: no words, base_failed.
    Repeated rows count as often as they occur, null doc_ids are kept as they are, other columns are not read, and an empty
    table gives no rows. Texts are read once, whole, in their own task.
    """
    v = votes()
    rows = base_features(docs.select("doc_id", "text")).drop("text")
    voted = materialise(rows.select("*", *(x.cast("byte").alias(f"v_{n}") for n, x in v.items())), "votes")
    model = fit(voted, list(v))
    out = voted.withColumn("quality", model.posterior({n: F.col(f"v_{n}") for n in v})).withColumn("base_failed", _base_failed())
    return out.select("doc_id", *FEATURES, "base_failed", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality", *(f"v_{n}" for n in v))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs (doc_id, text and others) that `quality_rules` keeps, columns as they were.

    The counts are made once and written as votes beside 128 bits of hashes of doc_id and text, which decide: rows that agree in
    both share their verdict. The texts meet the hashes that stay in one shuffle, at every size, so that no text is stored.
    """
    v = votes()
    docs, unpack = packed(docs, "doc_id", "text")
    keys = [F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("_k2")]
    scored = base_features(docs.select("text", *keys)).drop("text")
    voted = materialise(scored.select("_k1", "_k2", *(x.cast("byte").alias(f"v_{n}") for n, x in v.items()), _base_failed().alias("failed")), "votes")
    model = fit(voted.select(*(f"v_{n}" for n in v)), list(v))
    kept = voted.where(~F.col("failed") & (model.posterior({n: F.col(f"v_{n}") for n in v}) >= threshold)).select("_k1", "_k2")
    return unpack(docs.withColumns({"_k1": keys[0], "_k2": keys[1]}).join(kept.hint("shuffle_hash"), ["_k1", "_k2"], "left_semi").select(*docs.columns))
