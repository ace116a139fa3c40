"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded, learned filters of WIDTH bytes run over overlapping chunks that cover the whole document, each filter is max-pooled in a chunk and the chunks' pools are combined (largest, least and mean over the chunks) into one probability by a small dense layer. A second, mean pool of each filter goes beside the maximum, so that monotonous texts show.

Training takes a bounded sample of labelled texts: at most SAMPLE of them, of each class half, and SAMPLE_BYTES in all. They are those with the least hash, whatever the partitions. Their ids are found in narrow rows (no text is shuffled), then their texts are read in one scan and are all that reaches the driver. Training pools over all chunks of a text, as scoring does, slab by slab.

Defined results: a null text is the empty text; it is one chunk of padding and has a score. Without labelled rows of both classes all scores are 0.5. A document with labels of both classes, or whose id is null, is no lesson; equal rows are one lesson. Repeated rows are scored each. An empty table gives an empty one. Further columns, of whatever name, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, pick, table

DIM, WIDTH, FILTERS, CHUNK, HIDDEN = 6, 8, 24, 512, 16
#: Chunks of one pass through the filters, which bounds memory whatever the length of a text.
SLAB = 256
THRESHOLD = 0.7
#: Bounds of what is learnt from: labelled texts, and their bytes in all.
SAMPLE, SAMPLE_BYTES = 2400, 64 << 20


@dataclass
class Network:
    embed: np.ndarray  # 257 x DIM; row 256 is padding
    conv: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray
    dense: np.ndarray  # 6 * FILTERS x HIDDEN
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]


def new_network(seed: int = 7) -> Network:
    r = np.random.default_rng(seed)
    n = lambda *shape: (r.standard_normal(shape) * np.sqrt(2 / shape[0])).astype(np.float32)
    return Network((r.standard_normal((257, DIM)) * 0.5).astype(np.float32), n(WIDTH * DIM, FILTERS), np.zeros(FILTERS, np.float32), n(6 * FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), n(HIDDEN, 1), np.zeros(1, np.float32))


def chunked(text: str) -> np.ndarray:
    """All chunks of a text: rows of CHUNK bytes, each beginning with the last WIDTH - 1 bytes of the one before; 256 pads the last."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    step = CHUNK - WIDTH + 1
    n = max(1, -(-max(len(b) - WIDTH + 1, 1) // step))
    padded = np.full(n * step + WIDTH - 1, 256, np.int16)
    padded[: len(b)] = b
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (step * 2, 2))


def _windows(net: Network, chunks: np.ndarray) -> np.ndarray:
    x = net.embed[chunks].reshape(len(chunks), CHUNK * DIM)
    return np.lib.stride_tricks.sliding_window_view(x, WIDTH * DIM, axis=1)[:, ::DIM]


def pooled(net: Network, chunks: np.ndarray) -> np.ndarray:
    """Per chunk: each filter's maximum, and its mean over the windows."""
    out = []
    for at in range(0, len(chunks), SLAB):
        a = np.maximum(_windows(net, chunks[at : at + SLAB]).reshape(-1, WIDTH * DIM) @ net.conv + net.bias, 0).reshape(-1, CHUNK - WIDTH + 1, FILTERS)
        out.append(np.concatenate([a.max(1), a.mean(1)], 1))
    return np.concatenate(out)


def probabilities(net: Network, pools: np.ndarray, first: np.ndarray) -> np.ndarray:
    """From the chunks' pools and the place of each document's first chunk."""
    n = np.diff(np.append(first, len(pools)))[:, None]
    f = np.concatenate([np.maximum.reduceat(pools, first), np.minimum.reduceat(pools, first), np.add.reduceat(pools, first) / n], 1)
    z = np.maximum(f @ net.dense + net.dense_bias, 0) @ net.out + net.out_bias
    return (1 / (1 + np.exp(-np.clip(z[:, 0].astype(np.float64), -30, 30)))).astype(np.float64)


def _layers(net: Network, pools: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Gradients of the dense layers and of the pools, and the loss."""
    m, sizes = len(first), np.diff(np.append(first, len(pools)))
    doc = np.repeat(np.arange(m), sizes)
    hi, lo = np.maximum.reduceat(pools, first), np.minimum.reduceat(pools, first)
    f = np.concatenate([hi, lo, np.add.reduceat(pools, first) / sizes[:, None].astype(np.float32)], 1)
    pre = f @ net.dense + net.dense_bias
    h = np.maximum(pre, 0)
    p = 1 / (1 + np.exp(-np.clip((h @ net.out + net.out_bias)[:, 0], -30, 30)))
    loss = float(-np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
    dz = ((p - y) / m).astype(np.float32)[:, None]
    dpre = (dz @ net.out.T) * (pre > 0)
    d_hi, d_lo, d_mean = np.split(dpre @ net.dense.T, 3, 1)
    dp = d_mean[doc] / sizes[doc][:, None]
    for d, best in ((d_hi, hi), (d_lo, lo)):
        hit = pools == best[doc]
        dp += d[doc] * hit / np.add.reduceat(hit.astype(np.float32), first)[doc]
    return [f.T @ dpre, dpre.sum(0), h.T @ dz, dz.sum(0)], dp.astype(np.float32), loss


def _filters(net: Network, chunks: np.ndarray, dp: np.ndarray) -> list[np.ndarray]:
    """Gradients of the embedding and the filters from those of the pools of a slab."""
    k, w = len(chunks), CHUNK - WIDTH + 1
    win = np.ascontiguousarray(_windows(net, chunks)).reshape(-1, WIDTH * DIM)
    a = np.maximum(win @ net.conv + net.bias, 0).reshape(k, w, FILTERS)
    top = a.argmax(1)
    d_top, d_avg = dp[:, :FILTERS], dp[:, FILTERS:]
    da = np.repeat((d_avg / w)[:, None], w, 1)
    np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + d_top[:, None], 1)
    da *= a > 0
    da = da.reshape(-1, FILTERS)
    dwin = (da @ net.conv.T).reshape(k, w, WIDTH, DIM)
    dx = np.zeros((k, CHUNK, DIM), np.float32)
    for j in range(WIDTH):
        dx[:, j : j + w] += dwin[:, :, j]
    flat = chunks.ravel()
    de = np.stack([np.bincount(flat, dx[:, :, j].ravel(), 257) for j in range(DIM)], 1).astype(np.float32)
    return [de, win.T @ da, da.sum(0)]


def _gradients(net: Network, chunks: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
    """In the order of parts(), and the loss. Pools of all chunks come first; the way back runs over the filters once more, slab by slab, so memory does not grow with the texts."""
    dense, dp, loss = _layers(net, pooled(net, chunks), first, y)
    each = [_filters(net, chunks[at : at + SLAB], dp[at : at + SLAB]) for at in range(0, len(chunks), SLAB)]
    return [*(sum(g) for g in zip(*each, strict=True)), *dense], loss


def train(texts: list[str], labels: np.ndarray, steps: int = 400, batch: int = 16, seed: int = 7) -> Network:
    """Adam on the cross-entropy over batches of whole texts, classes weighed alike."""
    net, r = new_network(seed), np.random.default_rng(seed)
    parts = net.parts()
    m1, m2 = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    groups = [np.flatnonzero(labels == c) for c in (0, 1)]
    for t in range(1, steps + 1):
        rows = np.concatenate([r.choice(g, batch // 2) for g in groups])
        some = [chunked(texts[i]) for i in rows]
        first = np.concatenate([[0], np.cumsum([len(c) for c in some])[:-1]])
        grads, _ = _gradients(net, np.concatenate(some), first, labels[rows].astype(np.float32))
        rate = 0.004 * (1 - 0.9 * (t - 1) / steps)
        for p, g, a, b in zip(parts, grads, m1, m2, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-7)
    return net


def lessons(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels to learn from, of docs (doc_id, text) and labels (doc_id, label: 0 or 1).

    Narrow rows (id, hash and bytes of a text) meet the labels; of each class, those with the least hash are taken, first by a cut of the hash that leaves a few more than are needed, so that no task sorts them all. Only then are the chosen texts read.
    """
    spark, key = docs.sparkSession, ["doc_id", "text_hash"]
    texts = pick(docs, doc_id="bigint", text="string").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sure = pick(labels, doc_id="bigint", label="int").where("label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("doc_id", "label")
    narrow = texts.select(*key, F.octet_length("text").alias("size")).groupBy(*key).agg(F.max("size").alias("size"))
    found = materialize(narrow.join(sure, "doc_id").select(*key, "size", "label", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 40)).alias("h")), "labelled")
    counts = dict(found.groupBy("label").count().collect())
    chosen: list[tuple[int, int, int]] = []
    for c in (0, 1):
        half, left = sample // 2, most_bytes // 2
        cut = (1 << 40) * min(1.0, (half + 6 * half**0.5 + 50) / max(1, counts.get(c, 0)))
        for r in found.where((F.col("label") == c) & (F.col("h") <= int(cut))).orderBy("h", *key).limit(half).collect():
            if r["size"] <= left:
                left -= r["size"]
                chosen.append((r["doc_id"], r["text_hash"], c))
    if not chosen:
        return [], np.empty(0, int)
    wanted = spark.createDataFrame(chosen, "doc_id long, text_hash long, label int")  # at most `sample` narrow rows
    rows = texts.join(F.broadcast(wanted), key).groupBy(*key, "label").agg(F.first("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["label"], r["doc_id"], r["text_hash"]))
    return [r["text"] for r in rows], np.array([r["label"] for r in rows])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Network | None:
    """None without lessons of both classes."""
    texts, marks = lessons(docs, labels, sample, most_bytes)
    return train(texts, marks) if {0, 1} <= set(marks.tolist()) else None


def score(docs: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """docs (with a text column): the columns in keep, and score."""
    docs = pick(docs, **{c: docs.schema[c].dataType.simpleString() for c in keep}, text="string")
    sent = docs.sparkSession.sparkContext.broadcast(net)
    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in batches:
            out = np.full(b.num_rows, 0.5)
            pending: list[np.ndarray] = []
            first, places, held = [], [], 0

            def flush() -> None:
                nonlocal held
                if places:
                    out[places] = probabilities(net, pooled(net, np.concatenate(pending)), np.array(first))
                pending.clear(), first.clear(), places.clear()
                held = 0

            for i, t in enumerate(b.column("text") if net else []):
                c = chunked(t.as_py() or "")
                if len(c) > SLAB:  # a long text alone, slab by slab
                    out[i] = probabilities(net, pooled(net, c), np.array([0]))[0]
                    continue
                first.append(held), places.append(i), pending.append(c)
                held += len(c)
                if held >= SLAB:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.float64())], [*keep, "score"])

    return docs.mapInArrow(run, f"{kept}, score double")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="bigint", text="string").withColumn("held_out", held_out())
    labels = pick(table(spark, sf_dir, "labels"), doc_id="bigint", quality="int").withColumnRenamed("quality", "label")
    net = fit(docs.where(~F.col("held_out")), labels.where(~held_out()))
    return score(docs, net, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
