"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's five-word shingles are hashed once; the leading bits of a hash name its bin, and each bin keeps its least hash. An empty bin j borrows from the first non-empty bin in a random order of the bins that j alone fixes (optimal densification); the borrowed hash is mixed with j, so that chance agreements stay independent. Of each bin the eight low-order bits are stored. Likeness is the share of equal bins, corrected for those that agree by chance (2^-8).

Defined results: a null text is the empty text; it has no shingles, the fingerprint '' and likeness 1 to another of its kind, 0 to all else. One to four words are one shingle. Words are lower case and end at white space. For `edit_pairs`, documents with a null doc_id come first; ties of doc_id go by text, null first; a lone document is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import n_partitions, pick, table

#: 2 ** BIN_BITS bins of STORED_BITS bits each.
BIN_BITS, STORED_BITS, WORDS = 7, 8, 5


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once: it is bound to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column) -> Column:
    """One 64-bit hash a shingle, repeats included."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def rolled(h: Column) -> Column:
        parts = lambda i: [F.get(h, i + k) for k in range(WORDS)]
        return (
            F.when(F.size(h) >= WORDS, F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*parts(i))))
            .when(F.size(h) > 0, F.array(F.xxhash64(*parts(F.lit(0)))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), rolled)


def fingerprint(text: Column) -> Column:
    """array<tinyint>, a value a bin; empty without shingles."""
    bins = 1 << BIN_BITS
    bin_of = lambda h: F.shiftrightunsigned(h, 64 - BIN_BITS)
    low = (1 << STORED_BITS) - 1

    def least(hashes: Column) -> Column:
        return F.filter(hashes, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(hashes, i - 1))))

    def filled(mins: Column) -> Column:
        def value(at: Column) -> Column:
            def one(j: Column) -> Column:
                own = F.array_position(at, j).cast("int")
                donor = F.array_min(F.transform(at, lambda b: F.xxhash64(j, b).bitwiseAND(F.lit(-bins)).bitwiseOR(b))).bitwiseAND(F.lit(bins - 1))
                borrowed = F.xxhash64(j, F.get(mins, F.array_position(at, donor).cast("int") - 1))
                return F.when(own > 0, F.get(mins, own - 1)).otherwise(borrowed).bitwiseAND(F.lit(low)) - (1 << STORED_BITS - 1)

            return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint")), lambda j: one(j).cast("tinyint"))

        return F.when(F.size(mins) > 0, let(F.transform(mins, bin_of), value)).otherwise(F.array().cast("array<tinyint>"))

    return let(let(F.sort_array(shingle_hashes(text)), least), filled)


def packed(fp: Column) -> Column:
    """The stored bits as lower-case hexadecimal digits."""
    return F.lower(F.array_join(F.transform(fp, lambda v: F.substring(F.hex(v.cast("int") + (1 << STORED_BITS - 1) + 256), 2, 2)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of shingles that two fingerprints' texts have in common."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(1 << BIN_BITS)
    chance = 2.0**-STORED_BITS
    both = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(both)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most key, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    count = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    whole = F.greatest(count(F.lit([g[0] for g in groups])) - 1, F.lit(0))
    return F.coalesce(whole * step + count(F.get(F.lit([g + [g[-1]] * (step - len(g)) if len(g) == step else g for g in groups]), whole)), F.lit(0))


def edit_pairs(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text, fp, next_text, next_fp: each document beside the next by doc_id (the last beside the first).

    Documents are dealt into ranges of doc_id; the first of a range also goes, marked, to the end of the range before it. So a window of one range finds every next document, no window spans the table, and texts are shuffled once. buckets: number of ranges; by default four a shuffle partition, 20 000 at most (a window of one range spills to disk).
    """
    d = pick(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    n = min(buckets or 4 * n_partitions(d.sparkSession), 20_000)
    first, nulls, cuts = d.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n))).first()
    bounds = sorted(set(cuts or [])) if n > 1 else []
    if bounds and bounds[0] == first:
        bounds = bounds[1:]  # the first of all belongs to the first range
    at = _bucket(F.col("doc_id"), bounds)
    heads = F.array_contains(F.lit(bounds), F.col("doc_id")) if bounds else F.lit(False)
    leads = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(first)
    copies = F.when(leads, F.array(F.struct(at.alias("b"), F.lit(False).alias("mark")), F.struct(F.lit(len(bounds)).alias("b"), F.lit(True).alias("mark"))))
    copies = copies.when(heads, F.array(F.struct(at.alias("b"), F.lit(False).alias("mark")), F.struct((at - 1).alias("b"), F.lit(True).alias("mark"))))
    copies = copies.otherwise(F.array(F.struct(at.alias("b"), F.lit(False).alias("mark"))))
    dealt = d.select("doc_id", "text", fingerprint(F.col("text")).alias("fp"), copies.alias("copies")).select("doc_id", "text", "fp", F.inline("copies"))
    w = Window.partitionBy("b").orderBy("mark", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.select("*", F.lead("text").over(w).alias("next_text"), F.lead("fp").over(w).alias("next_fp")).where("not mark").drop("b", "mark")


def edited(text: Column, following: Column) -> Column:
    """The last half of text, rounded down, replaced by as many first characters of the following text, or all of it."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = edit_pairs(table(spark, sf_dir, "documents")).select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), "fp", "next_fp", edited(F.col("text"), F.col("next_text")).alias("edited"))
    both = pairs.select("*", fingerprint(F.col("edited")).alias("edited_fp"))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("fp")).alias("fingerprint"),
        packed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
