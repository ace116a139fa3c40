"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint has a bit set where more than half of its shingles' hashes have it. Two fingerprints that differ in at most RADIUS bits agree in the whole of some choice of parts of the 64 bits; each choice deals the distinct fingerprints into shards, whose shared masked pattern is the top of an index. In a shard the fingerprints lie in the order of their Gray ranks; nodes over neighbours keep the bits that all below them share, less those that a higher node keeps already. A search adds up differences from the top down and leaves whole groups as soon as the sum exceeds RADIUS, or when all of a group is known to be of the query's component. A shard hands out no pairs, only one edge a fingerprint, to the first of its local component.

A shard of more than SHARD fingerprints is dealt into slices, and each pair of slices is searched together, so that every link is found and no task holds more than two slices.

Defined results: a null text is the empty text; without words the fingerprint is zero, linked like any other. Repeated rows, and texts with equal fingerprints, are one node. Null ids lose to all others; a group of null ids only has a null component_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import DOCUMENT_COLUMNS, materialize, n_partitions, pick, table
from .components import connected_components

RADIUS, SHINGLE, SEED = 3, 3, 42
SHARD, FANOUT, FRONTIER = 20_000, 8, 1 << 21
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; words are lower-cased in A-Z only, hashes are XXH64 with seed 42."""
    from xxhash import xxh64_intdigest

    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(line)]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep, and fp: the fingerprint as a signed long."""
    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fp, pa.int64())], [*keep, "fp"])

    return docs.mapInArrow(run, f"{kept}, fp long")


def gray_rank(fp: Column) -> Column:
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def _levels(shard: np.ndarray, fp: np.ndarray) -> list[dict[str, np.ndarray]]:
    """From the leaves up to one node a shard: range of leaves (lo, hi), range of children, own bits (mask, pattern).

    A node's own bits are those that all its leaves share, without those that its parent has.
    """
    n = len(fp)
    at = np.arange(n)
    levels = [{"lo": at, "hi": at + 1, "and": fp, "or": fp, "shard": shard}]
    while (below := levels[-1])["shard"].size > np.unique(below["shard"]).size:
        k = len(below["shard"])
        new = np.concatenate([[True], below["shard"][1:] != below["shard"][:-1]])
        place = np.arange(k) - np.maximum.accumulate(np.where(new, np.arange(k), 0))
        first = np.flatnonzero(new | (place % FANOUT == 0))
        levels.append({"lo": below["lo"][first], "hi": np.append(below["lo"][first[1:]], n), "and": np.bitwise_and.reduceat(below["and"], first), "or": np.bitwise_or.reduceat(below["or"], first), "shard": below["shard"][first], "child": first, "children": np.diff(np.append(first, k))})
    for above, level in zip([*levels[1:], None], levels, strict=True):
        shared = ~(level["and"] ^ level["or"])
        level["pattern"] = level["and"]
        level["mask"] = shared if above is None else shared & np.repeat(above["and"] ^ above["or"], above["children"])
    return levels


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """label: each leaf's least known fellow; a and b become fellows."""
    while True:
        la, lb = label[a], label[b]
        if (open_ := la != lb).sum() == 0:
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(jumped := label[label], label):
            label[:] = jumped


def local_components(shard: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Of leaves by shard and Gray rank: the first leaf of each one's component among the leaves of its shard."""
    n = len(fp)
    label = np.arange(n)
    levels = _levels(shard, fp)
    root = np.repeat(np.arange(len(levels[-1]["lo"])), levels[-1]["hi"] - levels[-1]["lo"])
    low, high = [None] * len(levels), [None] * len(levels)

    def relabel() -> None:
        for i, level in enumerate(levels):
            low[i] = label if i == 0 else np.minimum.reduceat(low[i - 1], level["child"])
            high[i] = label if i == 0 else np.maximum.reduceat(high[i - 1], level["child"])

    def search(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Links of leaves lo to hi with later leaves; None if that is too much at once."""
        q, node = np.arange(lo, hi), root[lo:hi]
        sums = np.zeros(hi - lo, np.int64)
        for i in range(len(levels) - 1, -1, -1):
            level = levels[i]
            sums = sums + np.bitwise_count((fp[q] ^ level["pattern"][node]) & level["mask"][node])
            keep = (sums <= radius) & (level["hi"][node] - 1 > q) & ~((low[i][node] == label[q]) & (high[i][node] == label[q]))
            q, node, sums = q[keep], node[keep], sums[keep]
            if i:
                many = level["children"][node]
                if many.sum() > FRONTIER and hi - lo > 1:
                    return None
                ends = np.cumsum(many)
                within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
                node = np.repeat(level["child"][node], many) + within
                q, sums = np.repeat(q, many), np.repeat(sums, many)
        return q, node

    relabel()
    at, size = 0, 4096
    while at < n:
        got = search(at, min(n, at + size))
        if got is None:
            size = max(1, size // 4)
            continue
        at += size
        if len(got[0]):
            _join(label, *got)
            relabel()
        size = min(4096, size * 2)
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard columns, fp) sorted by shard and Gray rank; as many whole shards at once as make up a good block."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def done(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
        shard = np.cumsum(new) - 1
        many = (np.bincount(shard) > 1)[shard]
        shard, fp = shard[many], fp[many]
        label = local_components(shard, fp.view(np.uint64)) if len(fp) else np.empty(0, np.int64)
        linked = label != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], ["a", "b"])

    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append((np.stack([b.column(c).to_numpy() for c in ("choice", "key", "p", "q")], 1), b.column("fp").to_numpy()))
        rows += b.num_rows
        if rows >= 4 * SHARD:
            keys, fp = np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
            if len(cut):
                yield done(keys[: cut[-1] + 1], fp[: cut[-1] + 1])
                keys, fp = keys[cut[-1] + 1 :], fp[cut[-1] + 1 :]
            held, rows = [(keys, fp)], len(fp)
    if rows:
        yield done(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))


def links(nodes: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """a, b: edges that connect all of nodes' fingerprints (fp, distinct) with at most radius differing bits, through chains of these. n: about how many nodes there are.

    parts: the 64 bits in so many parts, of which radius may differ; more parts make finer shards of more copies, as many as keep an average shard small.
    """
    parts = next(m for m in range(radius + 1, 9) if m == 8 or n <= 64 << (64 * (m - radius) // m))
    edges = [64 * i // parts for i in range(parts + 1)]
    choices = list(combinations(range(parts), parts - radius))
    fp, keys = F.col("fp"), []
    for k, chosen in enumerate(choices):
        bits = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        keys.append(F.struct(F.lit(k).cast("bigint").alias("choice"), fp.bitwiseAND(F.lit(bits - (1 << 64) if bits >> 63 else bits)).alias("key")))
    rows = nodes.select("fp", F.inline(F.array(*keys)))
    hot = rows.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > SHARD)
    slices = F.coalesce(F.ceil(F.col("n") / SHARD), F.lit(1)).cast("bigint")
    own = F.pmod(F.xxhash64("fp"), slices)
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), slices - 1), lambda j: F.struct(F.least(own, j).alias("p"), F.greatest(own, j).alias("q")))
    dealt = rows.join(hot, ["choice", "key"], "left").select("choice", "key", "fp", F.inline(pairs))
    shard = ["choice", "key", "p", "q"]
    return dealt.repartition(n_partitions(nodes.sparkSession), *shard).sortWithinPartitions(*shard, gray_rank(F.col("fp"))).mapInArrow(_links, "a long, b long")


def classes(prints: DataFrame) -> DataFrame:
    """fp, component_id, rep_fp of prints (doc_id, fp): the least doc_id of each fingerprint's component, and the fingerprint of that document."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    reach = connected_components(links(nodes, nodes.count()), "a", "b").withColumnRenamed("node", "fp")
    linked = materialize(nodes.join(reach, "fp"), "linked")
    best = linked.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("fp"))).alias("best"))
    grouped = linked.join(best, "root").select("fp", F.col("best.least").alias("component_id"), F.col("best.fp").alias("rep_fp"))
    alone = nodes.join(reach, "fp", "left_anti").select("fp", F.col("least").alias("component_id"), F.col("fp").alias("rep_fp"))
    return grouped.union(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: one row a document."""
    prints = materialize(with_fingerprint(pick(docs, doc_id="bigint", text="string"), ["doc_id"]), "prints")
    return prints.join(classes(prints), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The columns of documents: of each component the row with the least doc_id; of equal ones, one."""
    own = pick(docs, **DOCUMENT_COLUMNS)
    marked = materialize(with_fingerprint(own, own.columns), "marked")
    found = classes(marked.select("doc_id", "fp"))
    stays = found.where("fp = rep_fp").select(F.col("fp").alias("stay_fp"), "component_id")
    left = marked.join(stays, (marked["fp"] == stays["stay_fp"]) & marked["doc_id"].eqNullSafe(stays["component_id"]), "left_semi")
    return left.dropDuplicates(["fp"]).select(*DOCUMENT_COLUMNS)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
