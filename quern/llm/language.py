"""Language ID by multilingual mixture inference: EM over n-gram likelihoods, languages chosen by penalised likelihood."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import id_crc_mod, packed

#: Buckets that byte trigrams are hashed to: the model has this many numbers a language, whatever the corpus.
BUCKETS = 1 << 14
#: Log-likelihood that another language must add, in units of log(trigrams); trigrams overlap, hence above BIC's half.
PENALTY = 3.0


def buckets(raw: bytes) -> np.ndarray:
    """The bucket of every byte trigram of a text with one space on either side."""
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((h * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def _normal(text: str) -> bytes:
    return text.lower().encode()


def _learn(batches):
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            by.setdefault(lang, []).append(_normal(text.as_py()))
        for lang, texts in by.items():
            held.setdefault(lang, np.zeros(BUCKETS, np.int64))
            held[lang] += np.bincount(buckets(b" ".join(texts)), minlength=BUCKETS)
    for lang, n in held.items():
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and P(bucket | language) as a (BUCKETS, languages) array, from all rows of docs (lang, text).

    Every task sums its texts into one count per language and bucket before the shuffle; BUCKETS numbers a language come to
    the driver, a bound set by the number of languages, not of documents. Rows with a null text or language teach nothing.
    """
    got = docs.select("lang", "text").where("lang is not null and text is not null").mapInArrow(_learn, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs, codes = np.unique(np.array(got.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True) if got.num_rows else (np.zeros(0, str), np.zeros(0, int))
    counts = np.zeros((BUCKETS, len(langs)))
    counts[got.column("bucket").to_numpy(), codes] = got.column("n").to_numpy()
    return [str(x) for x in langs], (counts + 0.5) / (counts + 0.5).sum(axis=0, keepdims=True)


def mixture(p: np.ndarray, c: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """EM for the shares of the columns of p that make counts c likeliest, and that log-likelihood."""
    w = np.full(p.shape[1], 1 / p.shape[1])
    total = c.sum()
    for _ in range(rounds):
        w = w * (p.T @ (c / (p @ w))) / total
    return w, float(c @ np.log(p @ w))


def infer(raw: bytes, probs: np.ndarray, logs: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, float]:
    """The shares of all languages in a text, zero for those that are not selected; the shares before the penalty; and the
    log-likelihood above that of noise, which has all buckets alike.

    The likeliest single language starts the set. The free mixture bounds what others can add; where that beats the penalty,
    languages join in the order of their free shares while the penalised likelihood rises.
    """
    every = np.bincount(buckets(raw), minlength=len(probs))
    at = np.nonzero(every)[0]
    c, p, out = every[at].astype(float), probs[at], np.zeros(probs.shape[1])
    single = c @ logs[at]
    best = int(single.argmax())
    price = penalty * np.log(c.sum() + 1)
    free, reach = mixture(p, c)
    fit = float(reach + c.sum() * np.log(len(probs)))
    if probs.shape[1] > 1:
        if reach - single[best] > price:
            chosen, value, shares = [best], float(single[best]), np.ones(1)
            for k in np.argsort(-free):
                if k == best:
                    continue
                w, ll = mixture(p[:, [*chosen, k]], c)
                if ll - price <= value:
                    break
                chosen, value, shares = [*chosen, int(k)], ll - price, w
            out[chosen] = shares
            return out, free, fit
    out[best] = 1.0
    return out, free, fit


def _predict(shared):
    @F.arrow_udf("struct<lang:string,score:double,langs:array<string>,shares:array<double>,fit:double>")
    def predict(texts: pa.Array) -> pa.Array:
        import regex

        letter = regex.compile(r"\p{L}").search
        langs, probs = shared.value
        logs, out = np.log(probs), []
        for t in texts:
            text = t.as_py()
            if not langs or not text or not letter(text):
                out.append({"lang": "und", "score": 0.0, "langs": [], "shares": [], "fit": None})
                continue
            w, free, fit = infer(_normal(text), probs, logs)
            order = [k for k in np.argsort(-w, kind="stable") if w[k] > 0]
            out.append({"lang": langs[order[0]], "score": float(min(1.0, free[order[0]])), "langs": [langs[k] for k in order], "shares": [float(w[k]) for k in order], "fit": fit})
        return pa.array(out, pa.struct([("lang", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64())), ("fit", pa.float64())]))

    return predict


def with_language(docs: DataFrame, train: DataFrame, into: str = "_lang") -> DataFrame:
    """docs with a struct column `into` (lang, score, langs, shares, fit), learnt from train (lang, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(train))
    return docs.withColumn(into, _predict(shared)(F.col("text")))


def language_id(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_langs and langs of every row of docs (doc_id, text, lang).

    Learns from rows whose crc32(doc_id as text) mod `folds` is not `held` and whose lang and text are not null; rows with a
    null doc_id are never held out. lang_pred is the language with the largest share, score its share before
    other languages are held to the penalty (so ordinary texts differ in it); `und` and 0 where the
    text is null or has no letter, or nothing could be learnt. Texts are read whole; repeated rows are rows; other columns are
    not read; an empty table gives no rows.
    """
    d = docs.select("doc_id", "text", "lang", (id_crc_mod(F.col("doc_id"), folds) == held).alias("held_out"))
    out = with_language(d.select("doc_id", "text", "held_out"), d.where("not held_out"))
    return out.select("doc_id", "held_out", F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"), F.size("_lang.langs").cast("long").alias("n_langs"), F.array_join("_lang.langs", ",").alias("langs"))


def keep_identified(docs: DataFrame, folds: int = 4, held: int = 2, noise: float = 5.0) -> DataFrame:
    """The rows of docs whose language could be told, columns as they were, whatever their names.

    Not told: texts without a letter, and texts that noise explains better than the best mixture of the learnt languages, by
    `noise` of log-likelihood or more. Where nothing can be learnt, no text is told.
    """
    d, unpack = packed(docs, "doc_id", "text", "lang")
    train = d.where(id_crc_mod(F.col("doc_id"), folds) != held)
    return unpack(with_language(d, train).where((F.col("_lang.lang") != "und") & (F.col("_lang.fit") > -noise)))
