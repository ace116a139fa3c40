"""Quantile regression by gradient-boosted trees, grown a level at a time from histograms that Spark adds up.

Rows are kept once, as values and the bins of their features, in blocks of some ten thousand: a row of its own costs more on its way to a Python worker than all that is done with it there. For each level of a tree, tasks send how many rows of a node lie in a bin, and how many of these lie below the prediction so far: whole numbers, at most (quantiles * nodes * features * bins) of them, from which the driver takes the splits; so a model is the same however the rows are dealt. A leaf's value is the quantile of what its rows still lack, from counts of rounded values, which a task adds up before it sends them. Trees are those that training.tree_quantiles reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col

QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
TREES, DEPTH, BINS, RATE, LEAST = 24, 3, 48, 0.3, 20
#: Decimals to which what is lacking is rounded before it is counted.
DECIMALS = 3
#: Rows of a block, at least but for the last ones of a task.
BLOCK = 1 << 14
#: What lacks less than this, in units of the last decimal, is counted by place over a whole task; the rest by value, a block at a time.
NEAR = 1 << 15

Node = dict[str, float]  # feature, cut (a bin; up to it goes left), left, right; or value


def edges_of(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """The upper ends of each feature's bins but the last: approximate quantiles."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(c(f).cast("double"), shares, 10_000).alias(f"q{i}") for i, f in enumerate(features))).first()
    return [np.unique(np.array(q or [], float)) for q in found]


def in_bins(rows: DataFrame, features: list[str], y: str, edges: list[np.ndarray]) -> DataFrame:
    """Blocks of rows of one part: part, n, and as bytes the y of the rows and, feature by feature, their bins: 0 where a feature is missing, else 1 and up. Rows without part or a finite y go."""
    kind = np.uint8 if max(map(len, edges), default=0) < 255 else np.uint16
    full = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(part: str) -> pa.RecordBatch:
            y, at = (np.concatenate(x, axis=-1) for x in zip(*held.pop(part), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(y)]), pa.array([y.tobytes()]), pa.array([at.tobytes()])], ["part", "n", "y", "b"])

        for batch in batches:
            x = [batch.column(f"f{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(edges))]
            at = np.stack([np.where(np.isfinite(v), np.searchsorted(e, v) + 1, 0).astype(kind) for v, e in zip(x, edges, strict=True)])
            y, parts = batch.column("y").to_numpy(), batch.column("part").dictionary_encode()
            for i, part in enumerate(parts.dictionary.to_pylist()):
                of = parts.indices.to_numpy() == i
                held.setdefault(part, []).append((y[of], at[:, of]))
                if sum(len(v) for v, _ in held[part]) >= full:
                    yield block(part)
        for part in list(held):
            yield block(part)

    given = rows.select(c(y).cast("double").alias("y"), c("part"), *(c(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)))
    return given.where((F.abs("y") < float("inf")) & c("part").isNotNull()).mapInArrow(run, "part string, n long, y binary, b binary")


def _blocks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """in_bins' blocks: part, y, and the bins by feature."""
    for batch in batches:
        for part, n, y, b in zip(*(batch.column(x) for x in ("part", "n", "y", "b")), strict=True):
            size = b.as_buffer().size // max(1, features * n.as_py())
            yield part.as_py(), np.frombuffer(y.as_buffer()), np.frombuffer(b.as_buffer(), f"u{size}").reshape(features, -1)


def _node_of(tree: list[Node], b: np.ndarray) -> np.ndarray:
    """The node of a (maybe unfinished) tree that each row has come to: a row at a node goes on by the difference to its child. Children stand behind their parent, the right one next to the left."""
    at = np.zeros(b.shape[1], np.int16)
    for i, node in enumerate(tree):
        if "feature" in node:
            at += (at == i) * ((b[int(node["feature"])] > node["cut"]) + np.int16(node["left"] - i))
    return at


def _predicted(trees: list[list[Node]], b: np.ndarray) -> np.ndarray:
    out = np.zeros(b.shape[1])
    for tree in trees:
        out += np.array([n.get("value", 0.0) for n in tree])[_node_of(tree, b)]
    return out


def _histograms(rows: DataFrame, done: dict[str, list[list[Node]]], growing: dict[str, list[Node]], sizes: list[int]) -> dict[tuple[str, int, int], np.ndarray]:
    """For each quantile, node and feature: rows and rows below the prediction, by bin."""
    sent = rows.sparkSession.sparkContext.broadcast((done, growing))  # the model so far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, growing = sent.value
        total: dict[tuple[str, int], np.ndarray] = {}
        for _, y, b in _blocks(batches, len(sizes)):
            for q, tree in growing.items():
                half = (y < _predicted(done[q], b)) * len(tree) + _node_of(tree, b).astype(np.int64)
                for f, size in enumerate(sizes):
                    hist = total.setdefault((q, f), np.zeros(2 * len(tree) * size, np.int64))
                    hist += np.bincount(half * size + b[f], minlength=len(hist))
        for (q, f), hist in total.items():
            above, below = hist.reshape(2, -1)
            some = np.flatnonzero(above + below)
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(some)), pa.array(np.full(len(some), f, np.int32)), pa.array(some.astype(np.int32)), pa.array((above + below)[some]), pa.array(below[some])], ["q", "f", "at", "n", "below"])

    out: dict[tuple[str, int, int], np.ndarray] = {}
    counted = rows.mapInArrow(run, "q string, f int, at int, n long, below long").groupBy("q", "f", "at").agg(F.sum("n").alias("n"), F.sum("below").alias("below"))
    for r in counted.collect():  # quantiles * nodes * features * bins
        node, bin_ = divmod(r["at"], sizes[r["f"]])
        out.setdefault((r["q"], node, r["f"]), np.zeros((2, sizes[r["f"]]), np.int64))[:, bin_] = r["n"], r["below"]
    return out


def best_split(hists: list[np.ndarray | None], alpha: float, least: int) -> tuple[int, int] | None:
    """Feature and bin of the split that lowers the squared error of the gradients most; the first of equal ones; None if none does."""
    best, found = 1e-9, None
    for f, hist in enumerate(hists):
        if hist is None:
            continue
        n, g = np.cumsum(hist[0]), np.cumsum(alpha * hist[0] - hist[1])
        ok = (n >= least) & (n[-1] - n >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, g**2 / n + (g[-1] - g) ** 2 / (n[-1] - n) - g[-1] ** 2 / n[-1], 0)
        at = int(gain.argmax())
        if gain[at] > best:
            best, found = float(gain[at]), (f, at)
    return found


def _lacking(rows: DataFrame, done: dict[str, list[list[Node]]], growing: dict[str, list[Node]], features: int) -> dict[tuple[str, int], float]:
    """For each quantile and leaf the quantile of y less the prediction."""
    sent = rows.sparkSession.sparkContext.broadcast((done, growing))  # the model so far
    near, unit = NEAR, 10.0**DECIMALS

    def told(q: str, node: np.ndarray, lack: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([q] * len(n), pa.string()), pa.array(node.astype(np.int32)), pa.array(lack / unit), pa.array(n.astype(np.int64))], ["q", "node", "lack", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, growing = sent.value
        total = {q: np.zeros((len(tree), 2 * near), np.int64) for q, tree in growing.items()}
        for _, y, b in _blocks(batches, features):
            for q, tree in growing.items():
                node, lack = _node_of(tree, b), np.rint((y - _predicted(done[q], b)) * unit)
                if (far := np.abs(lack) >= near).any():
                    pairs, n = np.unique(np.stack([node[far], lack[far]]), axis=1, return_counts=True)
                    yield told(q, *pairs, n)
                    node, lack = node[~far], lack[~far]
                if len(lack):
                    low = int(lack.min())
                    width = int(lack.max()) - low + 1
                    counts = np.bincount(node.astype(np.int64) * width + (lack - low).astype(np.int64), minlength=len(tree) * width)
                    total[q][:, near + low : near + low + width] += counts.reshape(len(tree), width)
        for q, counts in total.items():
            node, at = np.nonzero(counts)
            yield told(q, node, at.astype(float) - near, counts[node, at])

    counted = rows.mapInArrow(run, "q string, node int, lack double, n long").groupBy("q", "node", "lack").agg(F.sum("n").alias("n"))
    shares = list(QUANTILES.values())
    found = counted.groupBy("q", "node").agg(F.percentile("lack", shares, c("n")).alias("v")).collect()  # quantiles * leaves
    return {(r["q"], r["node"]): r["v"][list(QUANTILES).index(r["q"])] for r in found}


def fit(rows: DataFrame, features: int, edges: list[np.ndarray], trees: int = TREES, depth: int = DEPTH, rate: float = RATE, least: int = LEAST) -> dict[str, list[list[Node]]]:
    """The trees of each quantile, from in_bins' rows of the training part. The first is the quantile of all."""
    sizes = [len(e) + 2 for e in edges]
    done: dict[str, list[list[Node]]] = {q: [] for q in QUANTILES}
    for t in range(trees + 1):
        growing: dict[str, list[Node]] = {q: [{}] for q in QUANTILES}
        frontier = {q: [0] for q in QUANTILES}
        for _ in range(depth if t else 0):
            hists = _histograms(rows, done, growing, sizes)
            for q, alpha in QUANTILES.items():
                tree, following = growing[q], []
                for node in frontier[q]:
                    split = best_split([hists.get((q, node, f)) for f in range(features)], alpha, least)
                    if split:
                        tree[node] |= {"feature": split[0], "cut": split[1], "left": len(tree), "right": len(tree) + 1}
                        following += [len(tree), len(tree) + 1]
                        tree += [{}, {}]
                frontier[q] = following
            if not any(frontier.values()):
                break
        for (q, node), value in _lacking(rows, done, growing, features).items():
            growing[q][node]["value"] = value * (rate if t else 1.0)
        for q, tree in growing.items():
            done[q].append(tree)
    return done


def _nested(tree: list[Node], edges: list[np.ndarray], node: int = 0) -> dict:
    n = tree[node]
    if "feature" not in n:
        return {"leaf_value": float(n.get("value", 0.0))}
    e = edges[int(n["feature"])]
    # bin 0, of missing values, is left of every cut
    threshold = float(e[int(n["cut"]) - 1]) if 1 <= n["cut"] <= len(e) else float("inf") if n["cut"] > len(e) else float("-inf")
    return {"split_feature": int(n["feature"]), "threshold": threshold, "decision_type": "<=", "default_left": True, "left_child": _nested(tree, edges, int(n["left"])), "right_child": _nested(tree, edges, int(n["right"]))}


def _errors(rows: DataFrame, trees: dict[str, list[list[Node]]], features: int) -> DataFrame:
    """part and, for each quantile, rounded y less prediction."""
    sent = rows.sparkSession.sparkContext.broadcast(trees)  # the model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, y, b in _blocks(batches, features):
            p = {q: _predicted(t, b) for q, t in sent.value.items()}
            low, high = np.minimum(p["p10"], p["p50"]), np.maximum(p["p90"], p["p50"])
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(y)), *(pa.array(np.round(y - v, 6)) for v in (low, p["p50"], high))], ["part", *QUANTILES])

    return rows.mapInArrow(run, f"part string, {', '.join(f'{q} double' for q in QUANTILES)}")


def _correction(errors: DataFrame, hold: Callable[[DataFrame, str], DataFrame], level: float) -> tuple[float, float]:
    """What the lower and the upper quantile must move so that ceil((n + 1) * level) of n rows do not lie outside of each; never negative. None of either without rows."""
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.round(e, DECIMALS).alias("e")) for i, e in enumerate((-c("p10"), c("p90"))))))
    counts = hold(errors.select(sides.alias("x")).select("x.*").groupBy("side", "e").agg(F.count("*").alias("n")), "errors")
    out = []
    for side in range(2):
        counted = counts.where(c("side") == side)
        total = counted.agg(F.sum("n")).first()[0] or 0
        rank = min(1.0, float(np.ceil((total + 1) * level)) / total) if total else 0.0
        found = counted.agg(F.percentile("e", F.lit(rank), c("n")).alias("v")).first()[0]
        out.append(max(0.0, float(found or 0.0)))
    return out[0], out[1]


def train(rows: DataFrame, features: list[str], y: str, hold: Callable[[DataFrame, str], DataFrame], level: float = 0.9, **settings: int) -> tuple[dict, DataFrame]:
    """From rows with features, y and part (train, calibration, test): the artifact that training.tree_quantiles reads, and a report of one row: rows of each part, corrections, pinball losses of each quantile on the test part, and the share of its rows within the corrected interval.

    Rows without a finite y take no part; a feature that is null or not finite is missing. The calibration part corrects the lower and upper quantile, each to `level`.
    """
    edges = edges_of(rows.where("part = 'train'"), features)
    kept = hold(in_bins(rows, features, y, edges), "binned")
    trees = fit(kept.where("part = 'train'"), len(features), edges, **settings)
    lower, upper = _correction(_errors(kept.where("part = 'calibration'"), trees, len(features)), hold, level)
    errors = _errors(kept, trees, len(features))
    artifact = {"feature_names": features, "lower": lower, "upper": upper, "models": {q: {"trees": [_nested(t, edges) for t in ts]} for q, ts in trees.items()}}
    test = c("part") == "test"
    loss = lambda q, alpha: F.avg(F.when(test, F.greatest(alpha * c(q), (alpha - 1) * c(q))))
    inside = (c("p10") >= -lower) & (c("p90") <= upper)
    report = errors.agg(
        *(F.count_if(c("part") == p).alias(f"n_{p}") for p in ("train", "calibration", "test")),
        F.lit(lower).alias("lower"),
        F.lit(upper).alias("upper"),
        *(loss(q, alpha).alias(f"loss_{q}") for q, alpha in QUANTILES.items()),
        F.avg(F.when(test, inside.cast("double"))).alias("coverage"),
    )
    return artifact, report
