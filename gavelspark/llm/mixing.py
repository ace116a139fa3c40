"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source's weight is its token share to the power of an exponent, normalised. Entropy falls as the exponent grows, so the exponent that meets a target entropy is found by bisection, in a bracket that is opened until it holds the target. A repetition limit bounds the exponent: below 1 small sources are repeated, so it is raised as far as needed, above 1 large ones are, so it is lowered. Each pass over the sources evaluates all the points that eight halvings could visit, so the driver sees 255 rows a pass, however many sources there are.

The budget of a source, its weight times the tokens asked for, is realised in epochs: whole ones over all its documents, then a part of one. Every epoch has an order of its own: blocks in a random order, and documents in a random order in each. The part ends inside one block, with the document that reaches the budget. So a document's number of copies follows from its place against its source's end; mix() deals the texts out in that order, epoch by epoch and block by block.

Defined results: a null text has no tokens; a null source is a source of its own. A document without tokens, or of a source without tokens, goes with every whole epoch; each source has at least one if `cover` is set. Documents with the same doc_id and text have the same place (repeated rows are taken or left together). Where sources tie for the largest share, no exponent has less entropy than theirs alike: if the target lies below that, natural shares are kept and entropy_met is false. An empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import DOCUMENT_COLUMNS, materialize, pick, table

#: Target entropy as a share of the largest possible, and the most often that a document may be taken.
ENTROPY_SHARE, REPEATS = 0.95, 4.0
#: Points of a pass, passes of a bisection, and the exponent beyond which a target counts as out of reach: shares to this power are those of the largest alone.
POINTS, PASSES, STEEPEST = 255, 4, 1024.0
#: What the entropy may miss its target by, in nats, and count as met.
NEAR = 1e-6
#: What a budget may miss a whole number of epochs by, in epochs, and count as that.
SLACK = 1e-6
#: The largest table of sources that is broadcast.
SMALL = 50_000


def tokens(text: Column) -> Column:
    """Runs of other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def _grid(lo: float, hi: float) -> list[float]:
    return [lo + (hi - lo) * (i + 1) / (POINTS + 1) for i in range(POINTS)]


def _bisect(shares: DataFrame, lo: float, hi: float, sums: list[Column], reached) -> float:
    """The least exponent a between lo and hi at which reached(row of its sums) holds, if it then stays so; hi if none does."""
    for _ in range(PASSES):
        points = _grid(lo, hi)
        tried = shares.select("rel", F.explode(F.lit(points)).alias("a")).groupBy("a").agg(*sums)
        got = {r["a"]: r for r in tried.collect()}  # POINTS rows
        at = next((i for i in range(POINTS) if reached(got[points[i]])), POINTS)
        lo, hi = (points[at - 1] if at else lo), (points[at] if at < POINTS else hi)
    return hi


def exponent(shares: DataFrame, n: int, largest_budget_ratio: float, entropy_share: float = ENTROPY_SHARE, repeats: float = REPEATS, cover: bool = False) -> tuple[float, bool]:
    """The exponent, and whether its weights have the target entropy. For a column share (positive, sum 1) of n sources; largest_budget_ratio: tokens asked for to tokens there are.

    Weights have entropy_share of the entropy ln n, but for the repetition limit: where a source would be taken more than `repeats` times the exponent is as near to the target as the limit lets it (and to 1, the natural shares, where none is within it); cover: also where the budget is raised until every source has a whole epoch.
    """
    if n < 2:
        return 1.0, True
    # relative to the largest share, so that no power runs out of range
    power = F.pow("rel", "a")
    sums = [F.sum(power).alias("norm"), F.sum(F.when(power > 0, power * F.ln("rel") * F.col("a")).otherwise(0.0)).alias("logs"), F.max(F.pow("rel", F.col("a") - 1)).alias("most"), F.min(F.pow("rel", F.col("a") - 1)).alias("least")]
    top = shares.agg(F.max("share")).first()[0]
    rel = shares.select((F.col("share") / F.lit(top)).alias("rel"))
    target = entropy_share * math.log(n)
    entropy = lambda r: math.log(r["norm"]) - r["logs"] / r["norm"]
    taken = lambda r: r["most"] / top * max(largest_budget_ratio / r["norm"], top / r["least"] if cover else 0.0)
    at = lambda a: rel.select("rel", F.lit(float(a)).alias("a")).agg(*sums).first()
    high = 1.0
    while entropy(at(high)) > target and high < STEEPEST:
        high *= 2
    if entropy(at(high)) > target + NEAR:
        return 1.0, False
    best = _bisect(rel, 0.0 if high == 1.0 else high / 2, high, sums, lambda r: entropy(r) <= target)
    if taken(at(best)) > repeats:
        if best < 1.0:
            best = _bisect(rel, best, 1.0, sums, lambda r: taken(r) <= repeats)
        elif best > 1.0:
            best = max(1.0, _bisect(rel, 1.0, best, sums, lambda r: taken(r) > repeats) - (best - 1.0) / (POINTS + 1) ** PASSES)
    return best, abs(entropy(at(best)) - target) <= 1e-3


def _hash(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit("order"), doc_id, F.xxhash64(text))


def _block(h: Column, seed: int, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), h), F.lit(blocks))


def _order(seed: int, epoch: Column, block: Column, h: Column) -> tuple[Column, Column]:
    """Rank of a block in an epoch, and place of a document (by its hash) in the block."""
    return F.xxhash64(F.lit("rank"), F.lit(seed), epoch, block), F.xxhash64(F.lit("place"), F.lit(seed), epoch, h)


def plan(docs: DataFrame, budget: float = 1.0, cover: bool = False, entropy_share: float = ENTROPY_SHARE, repeats: float = REPEATS, seed: int = 0, hold_repeats: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """(documents, ends, blocks). documents: doc_id, source, n_tokens, block, h (a hash for its place); ends: for each source its weight, tokens, budget, whole epochs, where its partial epoch ends (end_rank of the block, end_place in it), and entropy_met.

    budget: tokens asked for, as a multiple of all tokens; cover: raised until every source has a whole epoch. hold_repeats: the exponent is such that the raised budget, too, takes no source more than `repeats` times; else that holds for `budget` as it is given.
    """
    d = pick(docs, doc_id="bigint", text="string", source="string")
    counted = d.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens"), _hash(F.col("doc_id"), F.col("text")).alias("h"))
    counted = materialize(counted, "tokens")
    n_rows = counted.count()
    blocks = max(1, math.isqrt(n_rows))
    rows = counted.withColumn("block", _block(F.col("h"), seed, blocks))
    by_block = materialize(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs")), "blocks")
    by_source = by_block.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.sum("n_docs").alias("docs"))
    n, total = by_source.where("tokens > 0").agg(F.count("*"), F.sum("tokens")).first()
    total = total or 0
    shares = materialize(by_source.where("tokens > 0").select((F.col("tokens") / F.lit(float(total or 1))).alias("share")), "shares")
    alpha, met = exponent(shares, n, budget, entropy_share, repeats, cover and hold_repeats)
    top = shares.agg(F.max("share")).first()[0] or 1.0
    rel = F.col("share") / F.lit(top)
    norm, least = shares.agg(F.sum(F.pow(rel, F.lit(alpha))), F.min(F.pow(rel, F.lit(alpha - 1)))).first() if n else (1.0, 1.0)
    asked = total * max(budget, norm * top / least if cover else 0.0)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1) * top), F.lit(alpha)) / F.lit(norm)).otherwise(F.lit(0.0))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + SLACK)).otherwise(F.lit(1)).cast("bigint")
    rest = F.col("budget") - F.col("epochs") * F.col("tokens")
    wanted = by_source.select("*", weight.alias("weight")).select("*", (F.col("weight") * F.lit(float(asked))).alias("budget")).select("*", epochs.alias("epochs")).select("*", F.when(rest > F.col("tokens") * SLACK, rest).otherwise(F.lit(0.0)).alias("part"))
    wanted = materialize(wanted.withColumn("entropy_met", F.lit(met)), "wanted")
    last_epoch = wanted.select("source", "part", "epochs")
    walked = _on_source(by_block, last_epoch).withColumn("rank", _order(seed, F.col("epochs"), F.col("block"), F.lit(0))[0])
    before = Window.partitionBy("source").orderBy("rank", "block").rowsBetween(Window.unboundedPreceding, -1)
    walked = walked.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    last = walked.where((F.col("before") < F.col("part")) & (F.col("part") <= F.col("before") + F.col("n_tokens")))
    last = last.groupBy("source").agg(F.min(F.struct("rank", "block", "before", "part", "epochs")).alias("e")).select("source", "e.*")
    inside = _on_source(rows, last.withColumnRenamed("block", "end_block")).where("block = end_block").withColumn("place", _order(seed, F.col("epochs"), F.col("block"), F.col("h"))[1])
    upto = Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = inside.select("source", "rank", "place", (F.col("before") + F.sum("n_tokens").over(upto) >= F.col("part") - 1e-6).alias("full")).where("full")
    ends = reached.groupBy("source").agg(F.min("rank").alias("end_rank"), F.min("place").alias("end_place"))
    ends = wanted.join(ends, wanted["source"].eqNullSafe(ends["source"]), "left").drop(ends["source"])
    return rows, materialize(ends, "ends"), blocks


def _key() -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))


def _on_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on source, null to null; right has a row a source."""
    return left.withColumn("_k", _key()).join(right.withColumn("_k", _key()).drop("source"), "_k").drop("_k")


def copies(seed: int, block: Column, h: Column) -> Column:
    """Of a document beside its source's row of ends: whole epochs, and one more if it lies before the end of the part."""
    rank, place = _order(seed, F.col("epochs"), block, h)
    before = (rank < F.col("end_rank")) | ((rank == F.col("end_rank")) & (place <= F.col("end_place")))
    return (F.col("epochs") + F.coalesce(before, F.lit(False)).cast("bigint")).cast("bigint")


def _with_ends(docs: DataFrame, ends: DataFrame, columns: list[str]) -> DataFrame:
    """docs beside its source's ends: broadcast if their number is small, else dealt by source and salt, so that a hot source is split."""
    right = ends.select(_key().alias("_k"), *columns)
    if ends.count() <= SMALL:
        return docs.withColumn("_k", _key()).join(F.broadcast(right), "_k").drop("_k")
    salts = 16
    right = right.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return docs.withColumns({"_k": _key(), "_s": F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")}).join(right, ["_k", "_s"]).drop("_k", "_s")


def mix(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """The columns of documents, each row as often as its source's budget takes it, in the order of the permutation: epoch by epoch, in each the blocks in an order of its own, in each of these the documents. Copies of a document lie in different epochs. The rows are dealt out in ranges of that order, which hashes make even."""
    _, ends, blocks = plan(docs, seed=seed, **how)
    own = pick(docs, **DOCUMENT_COLUMNS).withColumn("_h", _hash(F.col("doc_id"), F.col("text"))).withColumn("_block", _block(F.col("_h"), seed, blocks))
    taken = _with_ends(own, ends, ["epochs", "end_rank", "end_place"]).withColumn("_n", copies(seed, F.col("_block"), F.col("_h"))).where("_n > 0")
    each = taken.select(*DOCUMENT_COLUMNS, "_block", "_h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_epoch"))
    rank, place = _order(seed, F.col("_epoch"), F.col("_block"), F.col("_h"))
    return each.select(*DOCUMENT_COLUMNS, "_epoch", rank.alias("_rank"), place.alias("_place")).orderBy("_epoch", "_rank", "_place").select(*DOCUMENT_COLUMNS)


def schedule(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """doc_id, source, n_tokens, weight of the source, n_copies, block_rank and place (a document's place, by these two, in the last epoch of its source, which may be a part), and entropy_met."""
    rows, ends, _ = plan(docs, seed=seed, **how)
    beside = _with_ends(rows, ends, ["weight", "epochs", "end_rank", "end_place", "entropy_met"])
    rank, place = _order(seed, F.col("epochs"), F.col("block"), F.col("h"))
    return beside.select("doc_id", "source", "n_tokens", "weight", copies(seed, F.col("block"), F.col("h")).alias("n_copies"), rank.alias("block_rank"), place.alias("place"), "entropy_met")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"))
