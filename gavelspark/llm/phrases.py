"""Phrase collocation mining by Toivonen's method.

Texts are lower-cased (A-Z), cut into pieces at punctuation and into words at blanks. A phrase is counted where all its words lie in one piece, per language. A sample, one document in SAMPLE, proposes the phrases that are frequent in it at a lowered threshold. One pass over all documents then counts exactly these phrases and their negative border: whatever occurs and is not proposed itself, but whose first and last words but one are. Border phrases that turn out frequent may have longer ones that were not counted; then a further pass, over what is now known to be frequent, counts those and what stands on phrases that it counts for the first time, so that it closes the search. A frequent phrase's parts are frequent, so no phrase is lost, whatever the sample. (In the sample itself, passes go on length by length until closed.)

Tasks know the proposed phrases through a filter of FILTER_BITS bits at most (16 MiB, whatever the corpus; more phrases than that make it let more through). It is the same for all tasks, and what it lets through is counted in all of them: a false positive costs time and no exactness. A task counts FLUSH words at a time in numpy and sends on each phrase with its count, so that a phrase of any frequency reaches the shuffle a few times a task.

Scores are exact: products in decimals of 38 digits, whole division. The best of a language are chosen in salted parts first.

Defined results: a null text is the empty text, a null lang is `und`; rows with a null id and repeated rows count each. Texts without words add nothing; a language without candidates has no rows, and an empty table gives an empty one. Further columns are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, pick, table

LONGEST, LEAST, MOST, COVERED = 5, 100, 2_000, 100
#: One document in so many is in the sample; its threshold is LOWERED of the share of LEAST, and 2 at least.
SAMPLE, LOWERED = 16, 0.8
#: Bits of a filter for each phrase, and in all; a block is what one bitmap of Spark's holds.
BITS_EACH, FILTER_BITS, BLOCK = 32, 1 << 27, 1 << 15
FLUSH = 1_000_000
SALTS = 32

END, TAB = b"\xff", b"\t"  # never a byte of a text in UTF-8; never one of a word
_TABLE = bytes(END[0] if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "key binary, n int"


def words_and_ends(text: bytes) -> list[bytes]:
    """Lower-cased words, and END behind each piece."""
    return (text.translate(_TABLE).replace(END, b" \xff ") + b" \xff").split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


def hash_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))


def longer(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word behind them."""
    return _mixed(h) + words


def bits_of(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash among `size` bits, a power of two."""
    z, most = _mixed(h), np.uint64(size - 1)
    return (z & most).astype(np.int64), ((z >> np.uint64(32)) & most).astype(np.int64)


def let_through(bits: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.zeros(len(h), bool)
    a, b = bits_of(h, 8 * len(bits))
    return ((bits[a >> 3] >> (a & 7)) & (bits[b >> 3] >> (b & 7)) & 1).astype(bool)


def _ranks(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    out[np.argsort(x, kind="stable")] = np.arange(len(x))
    return out


def phrases_of(lang: str, words: list[bytes], ids: np.ndarray, filters: list[np.ndarray | None], eager: bool) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Length, phrases and their counts in ids (places of words; 0 is END) under the last filter, without what was counted under one before.

    All words are counted, and phrases whose first and last words but one were counted and passed the filter; if eager, or are counted now for the first time. Each length's phrases are numbered, so that hashes, filters and counts are taken once a phrase, not once a place.
    """
    word_hash = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    all_words, n = pa.array(words, pa.binary()), len(ids)
    at, number = np.flatnonzero(ids != 0), ids[ids != 0]
    kinds_hash, kinds = longer(np.full(len(words), hash_of(lang), np.uint64), word_hash), len(words)
    rank = _ranks(np.array(words, object))  # of the words in byte order
    order = rank
    before = [np.ones(kinds, bool) for _ in filters[:-1]]  # of each kind: was it counted under that filter?
    for k in range(1, LONGEST + 1):
        new = ~np.logical_or.reduce(before) if before else np.ones(kinds, bool)
        if new.any():
            counts = np.bincount(number, minlength=kinds)
            hit = np.flatnonzero(new & (counts > 0))
            if len(hit):
                hit = hit[np.argsort(order[hit])]  # phrases that begin alike lie together: the shuffle packs them better
                place = np.zeros(kinds, np.int64)
                place[number[::-1]] = at[::-1]
                parts = [all_words.take(pa.array(ids[place[hit] + i])) for i in range(k)]
                yield k, pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if k > 1 else parts[0], counts[hit]
        if k == LONGEST or not len(at):
            return
        go = let_through(filters[-1], kinds_hash)
        go = go | new if eager else go
        old = [was & let_through(f, kinds_hash) for was, f in zip(before, filters[:-1], strict=True)]
        reach = [np.zeros(n + 1, bool) for _ in (go, *old)]
        for places, flags in zip(reach, (go, *old), strict=True):
            places[at] = flags[number]
        both = np.flatnonzero(reach[0][at] & reach[0][at + 1])
        nxt = at[both]
        number, pairs = pd.factorize(number[both].astype(np.int64) * len(words) + ids[nxt + k])
        order = _ranks(order)[pairs // len(words)] * len(words) + rank[pairs % len(words)]
        kinds_hash, kinds = longer(kinds_hash[pairs // len(words)], word_hash[pairs % len(words)]), len(pairs)
        place = np.zeros(kinds, np.int64)
        place[number] = nxt  # any place of each
        before = [r[place] & r[place + 1] for r in reach[1:]]
        at = nxt


def count_phrases(docs: DataFrame, filters: list[Broadcast], least: int, eager: bool = False) -> DataFrame:
    """lang, length, phrase, n of the phrases of n >= least that are counted under the last filter and under none before; with the first filter, also the number of words, as the phrase of length 0. What is shuffled is one narrow key and a count a phrase and task."""
    first = len(filters) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, defaultdict] = {}
        held: dict[str, list[np.ndarray]] = {}
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                all_ids = np.concatenate(held.pop(lang))
                words = list(ids.pop(lang))
                own = pa.scalar(lang.encode("utf-8", "surrogatepass") + TAB, pa.binary())
                size = [(0, pa.array([b""], pa.binary()), np.array([(all_ids != 0).sum()]))] if first else []
                for _, phrase, counts in chain(size, phrases_of(lang, words, all_ids, [f.value for f in filters], eager and not first)):
                    for lo in range(0, len(phrase), 50_000):
                        key = pc.binary_join_element_wise(own, phrase.slice(lo, 50_000), pa.scalar(b"", pa.binary()))
                        yield pa.RecordBatch.from_arrays([key, pa.array(counts[lo : lo + 50_000].astype(np.int32))], ["key", "n"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                if lang not in ids:
                    ids[lang] = defaultdict(count().__next__)
                    ids[lang][END]  # its id is 0
                    held[lang] = []
                words = words_and_ends(text.as_py())
                held[lang].append(np.fromiter(map(ids[lang].__getitem__, words), np.int32, len(words)))
                n += len(words)
                if n >= FLUSH:
                    yield from flush()
                    n = 0
        yield from flush()

    found = docs.mapInArrow(run, COUNTS).groupBy("key").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("key").cast("string").endswith(TAB.decode()))
    return found.select(F.col("key").cast("string").alias("key"), "n").select(*_taken_apart("key"), "n")


def _taken_apart(key: str) -> list[Column]:
    """lang, length and phrase of a key: the language, TAB (which no phrase holds) and the phrase."""
    phrase = F.substring_index(key, TAB.decode(), -1)
    lang = F.left(F.col(key), F.char_length(key) - F.char_length(phrase) - 1)
    length = F.when(phrase == "", 0).otherwise(F.char_length(phrase) - F.char_length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1)
    return [lang.alias("lang"), length.cast("int").alias("length"), phrase.alias("phrase")]


def _hashed(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of the phrases of a batch (lang, phrase), as phrases_of has them."""
    out = np.zeros(batch.num_rows, np.uint64)
    for i, (lang, phrase) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist(), strict=True)):
        h = np.array([hash_of(lang)])
        for w in phrase.split(b" "):
            h = longer(h, np.array([xxhash.xxh3_64_intdigest(w)], np.uint64))
        out[i] = h[0]
    return out


def filter_of(frequent: DataFrame) -> np.ndarray:
    """The filter of the phrases that can have longer ones, made by tasks in blocks."""
    some = frequent.where(f"length between 1 and {LONGEST - 1}").select("lang", "phrase")
    size = min(FILTER_BITS, max(BLOCK, 1 << (BITS_EACH * some.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bits_of(_hashed(b), size)) + 1)], ["at"])

    blocks = some.mapInArrow(run, "at long").groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in blocks.collect():  # FILTER_BITS in all
        lo = (r["block"] - 1) * BLOCK // 8
        out[lo : lo + BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _left_out(frequent: DataFrame, sent: Broadcast) -> DataFrame:
    """The frequent phrases that a filter does not let through, of those that can have longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b if sent.value is None else b.filter(pa.array(~let_through(sent.value, _hashed(b))))

    return frequent.where(f"length between 1 and {LONGEST - 1}").select("lang", "phrase").mapInArrow(run, "lang string, phrase string")


def frequent_phrases(docs: DataFrame, least: int, bits: np.ndarray | None, name: str, eager: bool = False) -> tuple[DataFrame, int]:
    """lang, length, phrase, n of all phrases of n >= least (and the number of words of each lang, at length 0), and how many passes it took from what `bits` proposes (None: nothing).

    Until nothing frequent was left out of a pass' filter, another pass counts what can be frequent besides. If eager, that pass counts all phrases over new ones, too, whether or not these turn out frequent, so that it is the last.
    """
    send = docs.sparkSession.sparkContext.broadcast
    filters = [send(bits)]  # FILTER_BITS each, of five passes at most
    found = None
    while True:
        new = materialize(count_phrases(docs, filters, least, eager), name)
        found = new if found is None else found.union(new)
        if len(filters) == (2 if eager else LONGEST) or _left_out(new, filters[-1]).isEmpty():
            return found, len(filters)
        filters.append(send(filter_of(found)))


def mine(docs: DataFrame, least: int = LEAST, sample: int = SAMPLE) -> DataFrame:
    """frequent_phrases of all documents, which a sample of them proposes."""
    rows = pick(docs, doc_id="bigint", text="string", lang="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    some = materialize(rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample)) == 0), "sample")
    proposed, _ = frequent_phrases(some, max(2, int(LOWERED * least / sample)), None, "proposed")
    found, _ = frequent_phrases(rows.select("lang", "text"), least, filter_of(proposed), "phrases", eager=True)
    return found


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates of frequent_phrases, without those that a longer phrase covers."""
    n = found.where("length = 0").select("lang", F.col("n").alias("words"))
    parts = found.where(f"length between 1 and {LONGEST - 1}")
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', length - 1)"), F.expr("substring_index(phrase, ' ', 1 - length)")))
    longer = found.where("length > 2").select("lang", inner.alias("phrase"), F.col("n").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = found.where("length > 1").join(longer, ["lang", "phrase"], "left").where(f"f is null or {COVERED} * n > 100 * f")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "length", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - length)")})
    side = lambda part, name: parts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    both = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(n, "lang")
    exact = F.expr("(cast(a as decimal(19, 0)) * cast(words * cast(1000 as decimal(4, 0)) as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    worst = both.withColumn("score", exact).groupBy("lang", "phrase", "a", "words").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return worst.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("words").alias("n"), "cut.score")


def best(phrases: DataFrame, most: int = MOST) -> DataFrame:
    """The first `most` of each language, with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    part = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= most)
    whole = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return whole.where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS length, array_to_string(w[i : i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p)" for k in range(1, LONGEST + 1))
SQL = f"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t), g AS ({_GRAMS}),
f AS MATERIALIZED (SELECT lang, length, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {LEAST}), n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
o AS (SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[: length - 1], ' '), array_to_string(string_split(phrase, ' ')[2 :], ' ')]) AS phrase, a FROM f WHERE length > 2),
x AS (SELECT f.* FROM f WHERE length > 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.lang = f.lang AND o.phrase = f.phrase AND 100 * o.a >= {COVERED} * f.a)),
u AS (SELECT lang, length, phrase, a, unnest(range(1, length)) AS k FROM x),
c AS (SELECT u.lang, u.phrase, u.a, k, l.a AS l, r.a AS r, CAST(n.n AS BIGINT) AS n, CAST(CAST(1000 AS HUGEINT) * u.a * n.n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(string_split(u.phrase, ' ')[: k], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(string_split(u.phrase, ' ')[k + 1 :], ' ') JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= {MOST}"""


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(scored(mine(table(spark, sf_dir, "documents"))))
