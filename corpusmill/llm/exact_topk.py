"""Exact top-k inner products: ball-tree branch and bound on every shard.

Vectors are dealt into groups of bounded size, and a group into shards with a
ball tree each (centre and radius of every node).  A query visits the trees of
a group by their upper bounds of the inner product, <query, centre> + |query| *
radius, and stops at the first bound below its current kth score, which all
shards of the group share.  Queries meet every group by one exchange: a task
holds the trees of its group and reads the queries as a stream, so that neither
the driver nor a task ever holds all of them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, LEAF_ROWS = 16384, 512
#: Bytes of vectors (8 a component) that a group has on average.  Larger groups mean fewer copies of the queries.
GROUP_BYTES = 64 << 20
_SLACK = 1e-9
_EXACT = float(1 << 53)


def thinned(ids: np.ndarray, points: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Without repeated rows, and of rows with equal vectors the keep smallest ids alone: the others tie with them and lose."""
    _, same = np.unique(np.ascontiguousarray(points).view(np.dtype((np.void, points.itemsize * points.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    ids, points, same = ids[order], points[order], same[order]
    fresh = np.append(True, same[1:] != same[:-1])
    order = np.flatnonzero(fresh | np.append(True, ids[1:] != ids[:-1]))
    ids, points, fresh = ids[order], points[order], fresh[order]
    place = np.arange(len(ids)) - np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
    return ids[place < keep], points[place < keep]


class BallTree:
    """Nodes in arrays; leaf rows are contiguous in self.points (integers)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order, todo = np.arange(len(ids)), [(0, len(ids), -1, 0)]
        real = points.astype(np.float64)
        low, high, left, right = [], [], [], []
        while todo:
            lo, hi, parent, side = todo.pop()
            at = len(low)
            low.append(lo), high.append(hi), left.append(-1), right.append(-1)
            if parent >= 0:
                (left if side == 0 else right)[parent] = at
            if hi - lo > LEAF_ROWS:
                here = real[order[lo:hi]]
                pole = here[np.argmax(((here - here.mean(0)) ** 2).sum(1))]
                other = here[np.argmax(((here - pole) ** 2).sum(1))]
                along = here @ (other - pole)
                order[lo:hi] = order[lo:hi][np.argsort(along, kind="stable")]
                mid = (lo + hi) // 2
                todo += [(lo, mid, at, 0), (mid, hi, at, 1)]
        self.ids, self.points = ids[order], real[order]
        self.low, self.high, self.left, self.right = low, high, left, right
        self.centre = np.array([self.points[a:b].mean(0) for a, b in zip(low, high)])
        self.radius = np.array([np.sqrt(((self.points[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(low, high, self.centre)])
        self.reach = np.sqrt((self.centre**2).sum(1)) + self.radius
        self.largest = float(np.abs(self.points).max())
        # as integers only where products of doubles could be rounded
        self.whole = points[order].astype(object) if points.shape[1] * self.largest**2 >= _EXACT else None

    def bounds(self, query: np.ndarray) -> np.ndarray:
        length = np.sqrt(query @ query)
        return self.centre @ query + length * self.radius + _SLACK * length * self.reach

    def scores(self, rows: slice, query: np.ndarray, whole: np.ndarray) -> np.ndarray:
        if self.points.shape[1] * self.largest * float(np.abs(query).max()) < _EXACT:
            return self.points[rows] @ query
        points = self.points[rows].astype(np.int64).astype(object) if self.whole is None else self.whole[rows]
        return points @ whole.astype(object)

    def search(self, query_id: int, whole: np.ndarray, k: int, best: list, bound: np.ndarray | None = None) -> None:
        """best: heap of (score, -id) with at most k entries, the kth score first; updated in place."""
        query = whole.astype(np.float64)
        bound = self.bounds(query) if bound is None else bound
        queue = [(-bound[0], 0)]
        while queue:
            top, node = heapq.heappop(queue)
            if len(best) == k and -top < best[0][0]:
                return
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(queue, (-bound[child], child))
                continue
            rows = slice(self.low[node], self.high[node])
            scores, ids = self.scores(rows, query, whole), self.ids[rows]
            at = np.flatnonzero((scores >= best[0][0]).astype(bool)) if len(best) == k else np.arange(len(ids))
            at = at[ids[at] != query_id]
            if len(at) > 4 * k and scores.dtype != object:  # the largest, of different rows: enough for k even if all of best are among them
                at = at[np.lexsort((ids[at], -scores[at]))]
                at = at[np.append(True, (np.diff(scores[at]) != 0) | (np.diff(ids[at]) != 0))][: k + len(best)]
            for score, number in sorted(zip(scores[at].tolist(), (-ids[at]).tolist()), reverse=True):
                entry = (score, number)
                if entry in best:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def _by_width(batch: pa.RecordBatch):
    """(ids, matrix) of the vectors of each length in a batch of (vec_id, v)."""
    if not batch.num_rows:
        return
    ids, vectors = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v")
    width = np.diff(vectors.offsets.to_numpy())
    flat, start = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(width) - width
    for size in np.unique(width).tolist():
        at = np.flatnonzero(width == size)
        yield size, ids[at], flat[start[at][:, None] + np.arange(size)]


def _search(k: int):
    """(kind, vec_id, v) of a group, its vectors (kind 0) before the queries (kind 1): the best k of the group for each query."""

    def run(batches):
        held: dict[int, list] = {}
        trees: dict[int, list[BallTree]] = {}

        def plant(size: int) -> None:
            ids, points = (np.concatenate(x) for x in zip(*held.pop(size)))
            trees.setdefault(size, []).append(BallTree(*thinned(ids, points, k + 1)))

        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            for size, ids, points in _by_width(batch.filter(pa.array(kind == 0))):
                held.setdefault(size, []).append((ids, points))
                if sum(len(x) for x, _ in held[size]) >= SHARD_ROWS:
                    plant(size)
            found = []
            for size, ids, points in _by_width(batch.filter(pa.array(kind == 1))):
                if size in held:
                    plant(size)
                for number, query in zip(ids.tolist(), points):
                    best: list = []
                    bounds = [t.bounds(query.astype(np.float64)) for t in trees.get(size, ())]
                    for i in sorted(range(len(bounds)), key=lambda i: -bounds[i][0]):
                        trees[size][i].search(number, query, k, best, bounds[i])
                    found += [(number, -other, max(min(int(score), 2**63 - 1), -(2**63))) for score, other in best]
            if found:
                yield pa.record_batch([pa.array([x[j] for x in found], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    return run


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component x as double; without null vectors and
    vectors with null, NaN or infinite components, and without empty ones."""
    x = F.col(vector_column).cast("array<double>")
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return vectors.filter(F.col(id_column).isNotNull() & sound).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda y: F.floor(y * F.lit(float(scale))).cast("long")).alias("v"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query, ties to the smaller vec_id.

    Both sides have vec_id and v (array of long, neither null nor empty).  Only
    vectors of the query's length are compared; a query's own vec_id is no
    candidate of it; rows repeated with the same vec_id and score count once,
    however many; a query_id with several vectors gets the best of all of them;
    a query with fewer than k candidates gets them all, one without any no row.
    Scores are exact; those beyond the range of a long are cut to its ends.

    One exchange sends every vector to one group and every query to all groups.
    """
    spark = candidates.sparkSession
    rows, parts = candidates.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()
    groups = max(-(-parts * 8 // GROUP_BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-rows // LEAF_ROWS)), 1)
    # a partition's number is in the hash, so that copies of one row from many partitions go to many groups
    place = F.pmod(F.xxhash64("vec_id", "v", F.spark_partition_id()), F.lit(groups)).cast("int")
    dealt = candidates.select(place.alias("part"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = queries.select("vec_id", "v").dropDuplicates().select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(1).alias("kind"), "vec_id", "v")
    tasks = dealt.union(asked).repartitionById(groups, F.col("part")).sortWithinPartitions("kind").select("kind", "vec_id", "v")
    found = tasks.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.dense_rank().over(best)).filter(F.col("rank") <= k)
    return ranked.groupBy("query_id", "rank", "vec_id", "score").agg(F.lit(0).alias("_")).drop("_")
