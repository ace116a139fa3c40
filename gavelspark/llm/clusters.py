"""Centroid clustering in whole numbers, with a vantage-point tree over the centroids.

Each round the driver builds a tree over the centroids (K of them, a parameter, so its size is bounded) and broadcasts it. A node has a vantage centroid and two children, each with the least and greatest distance of its centroids from the vantage; a leaf has LEAF centroids at most. A vector searches best first: of the nodes open to it, it takes the one of the lowest bound, measures the vantage or the leaf's centroids exactly, and opens the children with the bounds that the triangle inequality gives them. It stops when the lowest bound is above its best distance; a bound that equals it is still searched, as an equally near centroid of a smaller number may be there. A batch's vectors take their steps together, each its own path, so that a step is a few calls of numpy.

What a round shuffles is a sum a component and cluster and a count a cluster from each task, whatever the number of vectors; the new centroids come from at most K * (SIZE + 1) sums. The whole-number vectors are written to the shared folder once and read each round.

Defined results: vectors of another length, null ones, and those with a null or non-finite component take no part; a row with a null id does (it comes last when first centroids are chosen). Repeated rows count each; of rows with one id the lesser vector comes first. With fewer than K vectors there are as many centroids as vectors; equal centroids keep their numbers, and the smaller one gets the vectors. An empty table gives an empty one. Further columns are left out. Components beyond LARGEST in size are an error, as squared distances would pass 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, pick, table

K, ROUNDS, SCALE, SIZE = 40, 5, 256, 64
LEAF = 3
LARGEST = 1 << 27
#: Rows of a batch that search together.
STEP = 4_096


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x and of c, whole numbers all."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * largest**2 * max(1, x.shape[1]) < 1 << 53:  # every partial sum is exact in doubles
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


class Tree:
    """Vantage-point tree over the rows of `centroids`. vantage: a centroid's number, or -1 in a leaf; children: (node, least, greatest distance from the vantage); points: a leaf's numbers, ascending."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.vantage: list[int] = []
        self.children: list[list[tuple[int, float, float]]] = []
        self.points: list[np.ndarray] = []
        if len(centroids):
            self._grow(np.arange(len(centroids)), squares(centroids, centroids))

    def _grow(self, numbers: np.ndarray, apart: np.ndarray) -> int:
        node = len(self.vantage)
        self.vantage.append(-1)
        self.children.append([])
        self.points.append(numbers)
        if len(numbers) > LEAF:
            among = np.sqrt(apart[np.ix_(numbers, numbers)])
            v = int(numbers[among.std(1).argmax()])  # the one that tells the others apart best
            rest = numbers[numbers != v]
            rest = rest[np.argsort(apart[v, rest], kind="stable")]
            self.vantage[node], self.points[node] = v, numbers[:0]
            for part in (rest[: len(rest) // 2], rest[len(rest) // 2 :]):
                away = np.sqrt(apart[v, part])
                self.children[node].append((self._grow(np.sort(part), apart), float(away.min()), float(away.max())))
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each row of x, the number of the nearest centroid (of equally near ones the smallest) and its squared distance; how many distances were measured in all."""
        best, who, measured = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.centroids)), 0
        bound = np.full((len(x), len(self.vantage)), np.inf)  # infinite: not open
        bound[:, 0] = 0
        rows = np.arange(len(x))
        while len(rows):
            node = bound[rows].argmin(1)
            low = bound[rows, node]
            go = low <= np.sqrt(best[rows])
            rows, node, low = rows[go], node[go], low[go]
            bound[rows, node] = np.inf
            for i in np.unique(node):
                at, least = rows[node == i], low[node == i]
                numbers = self.points[i] if self.vantage[i] < 0 else np.array([self.vantage[i]])
                d = squares(x[at], self.centroids[numbers])
                measured += d.size
                first = d.argmin(1)
                here, number = d[np.arange(len(at)), first], numbers[first]
                better = (here < best[at]) | ((here == best[at]) & (number < who[at]))
                best[at[better]], who[at[better]] = here[better], number[better]
                away = np.sqrt(here)
                for child, lo, hi in self.children[i]:
                    slack = 1e-9 * (away + hi + 1)  # rounding of the roots
                    bound[at, child] = np.maximum(least, np.maximum(away - hi, lo - away) - slack)
        return who, best, measured


def whole_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as whole numbers, of the vectors that take part."""
    rows = pick(vectors, vec_id="bigint", embedding="array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    kept = rows.where((F.size("embedding") == size) & F.forall("embedding", finite))
    whole = lambda c: F.when(F.abs(F.floor(c * scale)) <= LARGEST, F.floor(c * scale)).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} in whole numbers")).cast("bigint"))
    return kept.select("vec_id", F.transform("embedding", whole).alias("v"))


def first_centroids(rows: DataFrame, k: int = K, salt: int = 2) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in their order."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    best = rows.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    return np.array([r["v"] for r in best], np.int64)


def _vectors(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """The vectors of a batch as rows of a matrix, STEP at a time, and where they begin."""
    x = b.column("v").flatten().to_numpy(zero_copy_only=False)
    x = x.reshape(b.num_rows, -1) if b.num_rows else x.reshape(0, 1)
    for lo in range(0, len(x), STEP):
        yield lo, x[lo : lo + STEP]


def sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[np.ndarray, int]]:
    """Of each cluster that has vectors, the sum of them and their count."""
    tree, size = rows.sparkSession.sparkContext.broadcast(Tree(centroids)), centroids.shape[1]  # k centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), size + 1), np.int64)
        for b in batches:
            for _, x in _vectors(b):
                who, _, _ = tree.value.nearest(x)
                np.add.at(total, who, np.column_stack([x, np.ones(len(x), np.int64)]))
        some = np.flatnonzero(total[:, size])
        cluster, place = np.repeat(some, size + 1), np.tile(np.arange(size + 1), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[some].ravel())], ["cluster", "place", "total"])

    out: dict[int, tuple[np.ndarray, int]] = {}
    each = rows.select("v").mapInArrow(run, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total"))
    found = {(r["cluster"], r["place"]): r["total"] for r in each.collect()}  # k * (size + 1) rows
    for c in {c for c, _ in found}:
        out[c] = (np.array([found[c, i] for i in range(size)], np.int64), found[c, size])
    return out


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared)."""
    tree = rows.sparkSession.sparkContext.broadcast(Tree(centroids))  # k centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, x in _vectors(b):
                who, far, _ = tree.value.nearest(x)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").slice(lo, len(x)), pa.array(who.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the centroids after the last round."""
    rows = materialize(whole_vectors(vectors, size, scale), "whole")
    centroids = first_centroids(rows, k)
    for _ in range(rounds if len(centroids) else 0):
        new = centroids.copy()
        for c, (total, n) in sums(rows, centroids).items():
            new[c] = total // n
        centroids = new
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).where("false"), centroids
    return materialize(assign(rows, centroids), "assigned"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned, with the inertia of its cluster and of all, and the digest of its centroid."""
    exact = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    of = {r["cluster"]: int(r["s"]) for r in exact}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, s, sum(of.values()), digest[c]) for c, s in of.items()]
    each = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _sql() -> str:
    """The same in SQL, a block of common tables a round."""
    c = [f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS j, v FROM r QUALIFY j < {K})"]
    for i in range(ROUNDS + 1):
        c.append(f"a{i} AS MATERIALIZED (SELECT no, min(64 * CAST(list_inner_product(r.v, r.v) - 2 * list_inner_product(r.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) + j) AS m FROM r CROSS JOIN c{i} c GROUP BY no)")
        if i < ROUNDS:
            c.append(f"s{i} AS (SELECT m % 64 AS j, p, floor(sum(v[p]) / count(*)) AS x FROM r JOIN a{i} USING (no) CROSS JOIN range(1, {SIZE + 1}) t(p) GROUP BY ALL)")
            c.append(f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT j, list(x ORDER BY p) AS v FROM s{i} GROUP BY j) n USING (j))")
    whole = f"SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    last = f"SELECT vec_id, CAST(m % 64 AS INTEGER) AS cluster, m // 64 AS distance, CAST(sum(m // 64) OVER (PARTITION BY m % 64) AS BIGINT) AS cluster_inertia, CAST(sum(m // 64) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM r JOIN a{ROUNDS} USING (no) JOIN c{ROUNDS} c ON c.j = m % 64"
    return f"WITH r AS MATERIALIZED ({whole}), " + ", ".join(c) + " " + last


#: For vectors of components that doubles hold exactly.
SQL = _sql()


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings")))
