"""Language identification by multilingual mixture inference.

Training counts hashed character trigrams of every labelled text per language (Spark sums them; what reaches the driver is one fixed-width table a language). Inference treats a document as a mixture of languages: expectation-maximisation estimates the proportions from the trigram likelihoods, and a penalised likelihood selects which languages the document holds. How likely the text is under them, a trigram, tells languages that were learnt from letters of no such language.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text when nothing could be learnt. Rows with a null language teach nothing. Ties go to the alphabetically first language. Repeated rows count and are answered each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import pick, table

BUCKETS = 1 << 16
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """langs in alphabetical order; logp[i, bucket]: natural logarithm of a trigram's probability in langs[i]."""

    langs: tuple[str, ...]
    logp: np.ndarray


@cache
def _letters() -> np.ndarray:
    """Of every code point: is it a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the letters, lower case, words between blanks; empty without letters."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a blank after each word
    c = np.concatenate([[np.uint32(32)], np.where(letter, c, np.uint32(32))[keep], [np.uint32(32)] * bool(letter[-1])]).astype(np.uint32)
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for b in batches:
        for text, lang in zip(b.column("text"), b.column("lang"), strict=True):
            if len(g := trigrams(text.as_py())):
                at, n = np.unique(g, return_counts=True)
                seen.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))[at] += n
    for lang, n in seen.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """From columns text and lang. The driver gets at most BUCKETS rows a language, however large the corpus."""
    counted = pick(labelled, text="string", lang="string").where("text is not null and lang is not null").mapInArrow(_count, "lang string, bucket int, n long")
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = tuple(sorted(set(got.column("lang").to_pylist())))
    counts = np.zeros((len(langs), BUCKETS))
    if langs:
        row = {x: i for i, x in enumerate(langs)}
        counts[[row[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    counts += smoothing
    return LanguageModel(langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def shares_of(grams: list[np.ndarray], model: LanguageModel, rounds: int = 15) -> np.ndarray:
    """EM over all languages for many documents at once: their rows of language shares. Each has at least one trigram."""
    counted = [np.unique(g, return_counts=True) for g in grams]
    first = np.concatenate([[0], np.cumsum([len(a) for a, _ in counted])[:-1]])
    doc = np.repeat(np.arange(len(grams)), [len(a) for a, _ in counted])
    at, n = np.concatenate([a for a, _ in counted]), np.concatenate([k for _, k in counted]).astype(np.float32)
    logp = model.logp.T[at]
    p = np.exp(logp - logp.max(1, keepdims=True))
    total = np.add.reduceat(n, first)[:, None]
    share = np.full((len(grams), len(model.langs)), 1 / len(model.langs), np.float32)
    for _ in range(rounds):
        mixed = share[doc] * p
        mixed *= (n / mixed.sum(1))[:, None]
        new = np.add.reduceat(mixed, first) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share


def select(g: np.ndarray, model: LanguageModel, rounds: int = 15, penalty: float = 4.0) -> tuple[list[int], float]:
    """The selected languages, largest share first, and the text's evidence: the mean natural logarithm, a trigram, of how much likelier it is under them than under an even guess.

    A language is taken up only if it raises the log-likelihood by `penalty` times half the logarithm of the trigram count (overlapping trigrams are not independent, so it is stricter than BIC). Every language whose largest possible gain is above that is tried, however small its share: no language gains more than the trigram count times the logarithm of the mean ratio of its probabilities to the mixture's (Jensen's inequality, at the mixture's best shares).
    """
    at, n = np.unique(g, return_counts=True)
    logp = model.logp[:, at].astype(np.float64)
    top = logp.max(0)
    p, total = np.exp(logp - top), n.sum()
    singles = logp @ n
    chosen = [int(singles.argmax())]
    value, mixed = float(singles[chosen[0]]), p[chosen[0]]
    least, tried = penalty * np.log(max(total, 2)) / 2, set(chosen)
    while len(tried) < len(p):
        possible = total * np.log(np.maximum(p @ (n / mixed) / total, 1e-300))
        possible[[*tried]] = -np.inf
        i = int(possible.argmax())
        if possible[i] <= least:
            break
        tried.add(i)
        rows = [*chosen, i]
        q, share = p[rows], np.full(len(rows), 1 / len(rows))
        for k in range(20 * rounds):
            new = share * (q @ (n / (share @ q))) / total
            done = k >= rounds and np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        gain = float(n @ (np.log(share @ q) + top)) - value
        if gain > least:
            mixed, value = share @ q, value + gain
            chosen = [k for _, k in sorted(zip(-share, rows, strict=True))]
            tried = set(chosen)  # those that did not help before may do so now
    return chosen, value / total + float(np.log(model.logp.shape[1]))


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], prefix: str = "") -> DataFrame:
    """docs (with a text column): the columns in keep, and lang_pred, score, langs (all selected languages) and evidence (above 0: likelier in them than by an even guess; null where lang_pred is `und`), each with prefix before its name."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = T.StructType([docs.schema[c] for c in keep])
    schema = T.StructType([*kept, T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}langs", T.ArrayType(T.StringType())), T.StructField(f"{prefix}evidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            pred, score, langs, evidence = [UNKNOWN] * b.num_rows, [0.0] * b.num_rows, [[] for _ in range(b.num_rows)], [None] * b.num_rows
            for start in range(0, b.num_rows if m.langs else 0, 128):
                grams = {start + i: g for i, t in enumerate(b.column("text").slice(start, 128)) if len(g := trigrams(t.as_py()))}
                for (i, g), shares in zip(grams.items(), shares_of([*grams.values()], m) if grams else [], strict=True):
                    chosen, evidence[i] = select(g, m)
                    pred[i], score[i], langs[i] = m.langs[chosen[0]], min(1.0, float(shares[chosen[0]])), [m.langs[k] for k in chosen]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(evidence, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="bigint", text="string", lang="string").withColumn("held_out", held_out())
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])
