"""Exact top-k inner-product search by dual cover trees.

The upper level of the data's tree is shared by all tasks: CELLS centres, far from each other, of a bounded sample of the vectors. Every vector belongs to the cell of its nearest centre; a cell's covering radius is the greatest distance of its vectors from it. There are as many cells as leave A_CELL vectors to each, CELLS at most. A query first searches the cells whose centres it likes best, as many as hold more than k vectors, which gives it a kth score; after that it goes only to cells whose bound <q, p> + |q| r_P still reaches that score. So what is shuffled is each vector twice, whatever the number of queries, and a query as often as cells can matter to it. A cell of many vectors is dealt into blocks.

In a block a cover tree is grown over the vectors, and one over each batch of queries; both are walked together. A node has a level: its points lie within BASE**level of its centre (covering), and the centres of its children, one or more levels down, are further than BASE**(their level) from each other (separation). No inner product of the points of nodes Q and P exceeds <q, p> + |q| r_P + |p| r_Q + r_Q r_P; a pair of nodes is left when this is below the worst kth score that the query node's members have so far; at a leaf, each of its queries is left by its own bound. Where a level would have more than FANOUT centres, the vectors are too far from each other for a tree to prune, and the node keeps its points as a leaf.

Vectors become whole numbers, floor(scale * x), and scores are exact: products are taken in doubles where every partial sum is below 2^53, else in 64-bit integers; vectors whose products could pass these are an error.

Defined results: vectors that are null, or hold a null or a component that is not finite, take no part, nor do rows with a null id. Vectors of different lengths do not meet. Equal queries (id and vector) are one; queries of one id and different vectors have a result each. A query's own rows are all with its id; every other row is a candidate, repeated ones as often as they are there. Ties go to the smaller id. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, pick, table

DATA_BLOCK, LEAF, FANOUT, BASE = 8_000, 128, 48, 1.5
#: Centres of the shared upper level, and how many vectors they are chosen from: all that the driver sees.
CELLS, SAMPLE, A_CELL = 256, 2_048, 40


def far_centres(x: np.ndarray, rows: np.ndarray, first: int, apart: float, most: int) -> tuple[list[int], np.ndarray, np.ndarray] | None:
    """Centres among rows, further than `apart` from each other and such that every row is within that of one (the farthest comes next), each row's nearest, and its distance. None if more than `most` are needed."""
    centres, owner = [first], np.zeros(len(rows), int)
    near = np.sqrt(((x[rows] - x[first]) ** 2).sum(1))
    while near.max() > apart:
        if len(centres) == most:
            return None
        centres.append(int(rows[near.argmax()]))
        d = np.sqrt(((x[rows] - x[centres[-1]]) ** 2).sum(1))
        closer = d < near
        owner[closer], near[closer] = len(centres) - 1, d[closer]
    return centres, owner, near


class Tree:
    """Cover tree over the rows of x: node i has the centre's row, a level, the covering radius of its points, and either children or, in a leaf, points."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.norms = x, np.sqrt((x * x).sum(1))
        self.centre, self.level, self.radius, self.children, self.points = [], [], [], [], []
        rows = np.arange(len(x))
        stack = [(self._node(0, np.sqrt(((x - x[0]) ** 2).sum(1))), rows)]
        while stack:
            node, rows = stack.pop()
            level, parts = self.level[node] - 1, None
            while len(rows) > LEAF and self.radius[node] > 0:
                parts = far_centres(x, rows, self.centre[node], BASE**level, FANOUT)
                if parts is None or len(parts[0]) > 1:
                    break
                level -= 1  # a level at which the node is its only child
            if parts is None:
                self.points[node] = rows
                continue
            centres, owner, near = parts
            for k, c in enumerate(centres):
                child = self._node(c, near[owner == k], level)
                self.children[node].append(child)
                stack.append((child, rows[owner == k]))

    def _node(self, centre: int, away: np.ndarray, level: int | None = None) -> int:
        r = float(away.max())
        self.centre.append(centre)
        self.level.append(level if level is not None else int(np.ceil(np.log(r) / np.log(BASE))) if r > 0 else 0)
        self.radius.append(r * (1 + 1e-9))
        self.children.append([])
        self.points.append(None)
        return len(self.centre) - 1


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    return (a @ b.T).astype(np.int64) if exact else a.astype(np.int64) @ b.astype(np.int64).T


class Block:
    """Vectors of one length (each with its number of copies) and their tree, for any number of searches."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, copies: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")  # so that ties go by place
        self.ids, self.x, self.copies = ids[order], x[order], copies[order]
        self.tree, self.largest = Tree(self.x), float(np.abs(x).max(initial=0))

    def search(self, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row of the query, id, copies and score: for each row of q the best vectors, k at most, of other ids than its own and of scores of `least` or more."""
        ids, x, xt, qt = self.ids, self.x, self.tree, Tree(q)
        most = float(np.abs(q).max(initial=0)) * self.largest * max(1, x.shape[1])
        if most >= 2**63:
            raise ValueError("inner products may pass 64 bits")
        exact = most < 2**53
        best = np.repeat(least[:, None], k, 1)
        where = np.full((len(q), k), -1)
        worst = np.full(len(qt.centre), -np.inf)  # least kth score below a query node
        members: list[np.ndarray] = [np.empty(0, int)] * len(qt.centre)
        for i in range(len(qt.centre) - 1, -1, -1):
            members[i] = qt.points[i] if qt.points[i] is not None else np.concatenate([members[c] for c in qt.children[i]])

        def bound(i: int, js: np.ndarray) -> np.ndarray:
            c, r = qt.centre[i], qt.radius[i]
            centres, rp = np.array([xt.centre[j] for j in js]), np.array([xt.radius[j] for j in js])
            return (xt.x[centres] @ q[c]) + qt.norms[c] * rp + xt.norms[centres] * r + r * rp + 1e-6 * (1 + qt.norms[c] * xt.norms[centres])

        def base(i: int, j: int) -> None:
            """Each query of the node that the data node's own bound lets in meets its points; only scores that reach a query's kth one so far are sorted in."""
            rows, cols, centre = qt.points[i], xt.points[j], xt.x[xt.centre[j]]
            product = q[rows] @ centre
            rows = rows[product + qt.norms[rows] * xt.radius[j] + 1e-6 * (1 + np.abs(product)) >= best[rows, -1]]
            if not len(rows):
                return
            s = _products(q[rows], x[cols], exact)
            r, c = np.nonzero((s >= best[rows, -1][:, None]) & (q_ids[rows][:, None] != ids[cols][None]))
            if not len(r):
                return
            hit = np.unique(r)
            of = np.concatenate([r, np.repeat(hit, k)])
            scores = np.concatenate([s[r, c], best[rows[hit]].ravel()])
            places = np.concatenate([cols[c], where[rows[hit]].ravel()])
            order = np.lexsort((np.where(places < 0, len(ids), places), ~scores, of))
            of, scores, places = of[order], scores[order], places[order]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            keep = place < k
            best[rows[of[keep]], place[keep]], where[rows[of[keep]], place[keep]] = scores[keep], places[keep]

        stack = [(0, 0, np.inf)]
        while stack:
            i, j, most = stack.pop()
            worst[i] = max(worst[i], float(best[members[i], -1].min()))
            if most < worst[i]:
                continue
            qi, xj = qt.points[i] is not None, xt.points[j] is not None
            if qi and xj:
                base(i, j)
            elif xj or (not qi and qt.radius[i] >= xt.radius[j]):
                pairs = [(c, j, float(bound(c, np.array([j]))[0])) for c in qt.children[i]]
                stack.extend(sorted(pairs, key=lambda p: p[2]))
            else:
                js = np.array(xt.children[j])
                b = bound(i, js)
                stack.extend((i, int(js[t]), float(b[t])) for t in np.argsort(b, kind="stable"))
        at, rank = np.nonzero(where >= 0)
        place = where[at, rank]
        return at, ids[place], self.copies[place], best[at, rank]


def whole_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v (the components as doubles that are whole numbers) and copies (how often the row is there); rows that take no part are left out."""
    rows = pick(vectors, vec_id="bigint", embedding="array<double>").where("vec_id is not null and embedding is not null")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    whole = rows.where(F.forall("embedding", finite)).select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale).cast("double")).alias("v"))
    return whole.groupBy("vec_id", "v").agg(F.count("*").alias("copies"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, size) if size else np.zeros((len(column), 1))


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    sizes = np.array([len(v) for v in b.column("v")], int)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size), at, b.take(pa.array(at))


def upper_level(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Centres of the cells, by length of vector, from a sample of at most SAMPLE vectors. Any choice gives the same result; this one is that of the hash."""
    some = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, 2 * n // SAMPLE))) == 0).select("v").limit(SAMPLE).toArrow()
    out = {}
    for batch in some.combine_chunks().to_batches():
        for size, _, part in _by_length(batch):
            x = np.unique(_matrix(part.column("v"), size), axis=0)
            centres, near = [0], ((x - x[0]) ** 2).sum(1)
            while len(centres) < min(CELLS, len(x), 1 + n // A_CELL):
                centres.append(int(near.argmax()))
                near = np.minimum(near, ((x - x[centres[-1]]) ** 2).sum(1))
            out[size] = x[centres]
    return out


def in_cells(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """rows with their length, cell (of the nearest centre; 0 and the origin where a length has none) and distance from its centre."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # CELLS vectors a length of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, away = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            length = np.array([len(v) for v in b.column("v")], np.int32)
            for size, at, part in _by_length(b):
                x, p = _matrix(part.column("v"), size), sent.value.get(size, np.zeros((1, max(size, 1))))
                c = ((p * p).sum(1) - 2 * (x @ p.T)).argmin(1)
                cell[at], away[at] = c, np.sqrt(((x - p[c]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(length), pa.array(cell), pa.array(away)], [*b.schema.names, "length", "cell", "away"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, copies long, query boolean, length int, cell int, away double")


def _cells_to_search(asked: DataFrame, centres: dict[int, np.ndarray], cells: dict[tuple[int, int], tuple[float, int]], k: int, first: bool) -> DataFrame:
    """asked (query_no, vec_id, v, length, least) beside each cell to search: first those of the greatest products with their centres, as many as hold more than k vectors (one is the query's own); then of all others those whose bound reaches `least`. cells: covering radius and number of vectors by length and cell."""
    sent = asked.sparkSession.sparkContext.broadcast((centres, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, cells = sent.value
        for b in batches:
            for size, _, part in _by_length(b):
                p = centres.get(size, np.zeros((1, max(size, 1))))
                known = [cells.get((size, c), (-1.0, 0)) for c in range(len(p))] if size in centres else [(np.inf, 0)]
                r, n = np.array([x for x, _ in known]), np.array([x for _, x in known])
                x, least = _matrix(part.column("v"), size), part.column("least").to_numpy(zero_copy_only=False)
                product = np.where(r[None] < 0, -np.inf, x @ p.T)
                order = np.argsort(-product, 1, kind="stable")
                held = np.cumsum(n[order], 1)
                nearest = np.zeros(product.shape, bool)
                np.put_along_axis(nearest, order, held - n[order] <= k, 1)  # what the cells before hold is not enough
                nearest &= (r >= 0)[None]
                bound = product + np.sqrt((x * x).sum(1))[:, None] * np.maximum(r, 0)[None]
                bound += 1e-6 * (1 + np.abs(product))
                bound = np.where(np.isnan(bound), np.inf, bound)  # the zero query in a cell without a radius
                at, cell = np.nonzero(nearest if first else (bound >= least[:, None]) & (r >= 0)[None] & ~nearest)
                for lo in range(0, len(at), 10_000):
                    some = part.take(pa.array(at[lo : lo + 10_000]))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell[lo : lo + 10_000].astype(np.int32))], [*some.schema.names, "cell"])

    return asked.mapInArrow(run, "query_no long, vec_id long, v array<double>, length int, least long, cell int")


def _search_cells(data: DataFrame, asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_no, query_id, vec_id, copies, score. data and asked meet by block, vectors first; the vectors of a block become a tree, past which the queries stream batch by batch."""
    sub = data.select("vec_id", "v", "copies", F.lit(None).cast("long").alias("query_no"), F.lit(None).cast("long").alias("least"), "length", "cell", "sub")
    every = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))  # the numbers of a cell's blocks
    sent = asked.join(blocks, ["length", "cell"]).select("vec_id", "v", F.lit(0).cast("long").alias("copies"), "query_no", "least", "length", "cell", every.alias("sub"))
    key = ["length", "cell", "sub"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in key], 1)
            asks = b.column("query_no").is_valid().to_numpy(zero_copy_only=False)
            marks = np.column_stack([keys, asks])
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                part, here = b.slice(lo, hi - lo), tuple(keys[lo])
                if here != now:
                    now, held, block = here, [], None
                x = _matrix(part.column("v"), int(here[0]))
                ids = part.column("vec_id").to_numpy()
                if not asks[lo]:
                    held.append((ids, x, part.column("copies").to_numpy()))
                    continue
                block = block or Block(*(np.concatenate(y) for y in zip(*held, strict=True)))
                at, found, copies, scores = block.search(ids, x, part.column("least").to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(part.column("query_no").to_numpy()[at]), pa.array(ids[at]), pa.array(found), pa.array(copies), pa.array(scores)], ["query_no", "query_id", "vec_id", "copies", "score"])

    ordered = sub.unionByName(sent).repartition(*key).sortWithinPartitions(*key, F.col("query_no").asc_nulls_first())
    return ordered.mapInArrow(run, "query_no long, query_id long, vec_id long, copies long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of the rows for which is_query (of vec_id) holds against all rows."""
    rows = whole_vectors(vectors, scale).withColumn("query", F.coalesce(is_query, F.lit(False)))
    rows = materialize(rows, "vectors")
    centres = upper_level(rows, rows.count())
    placed = materialize(in_cells(rows, centres), "cells")
    stats = materialize(placed.groupBy("length", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).withColumn("n_blocks", F.ceil(F.col("n") / DATA_BLOCK).cast("int")), "stats")
    near = stats.where(F.col("length").isin([*centres])).select("length", "cell", "radius", "n").collect()  # CELLS rows a length of the sample
    cells = {(r["length"], r["cell"]): (r["radius"] * (1 + 1e-9), r["n"]) for r in near}
    blocks = stats.select("length", "cell", "n_blocks")
    data = placed.join(blocks, ["length", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vec_id", "v"), F.col("n_blocks")).cast("int"))
    lowest = F.lit(-(1 << 63)).cast("long")
    asked = placed.where("query").select(F.xxhash64("vec_id", "v").alias("query_no"), "vec_id", "v", "length", lowest.alias("least"))
    first = materialize(_search_cells(data, _cells_to_search(asked, centres, cells, k, True), blocks, k), "first")
    w = Window.partitionBy("query_no", "query_id").orderBy(F.desc("score"), "vec_id")
    upto = F.sum("copies").over(w.rowsBetween(Window.unboundedPreceding, 0))
    kth = first.select("query_no", "query_id", "score", upto.alias("upto")).where(F.col("upto") >= k).groupBy("query_no", "query_id").agg(F.max("score").alias("kth"))
    more = asked.join(kth.withColumnRenamed("query_id", "vec_id"), ["query_no", "vec_id"], "left").select("query_no", "vec_id", "v", "length", F.coalesce("kth", "least").alias("least"))
    rest = _search_cells(data, _cells_to_search(more, centres, cells, k, False), blocks, k)
    each = first.unionByName(rest).withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long"))))).drop("_one")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in SQL, for vectors of finite components.
SQL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS qv, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score FROM q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
