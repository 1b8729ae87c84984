import math
import time

import numpy as np

from corpusmill.llm import exact_topk
from corpusmill.llm.exact_topk import integer_vectors, top_k
from pyspark.sql import functions as F


def brute(rows, k):
    v = {}
    for key, x in rows:
        if key is not None and x and all(c is not None and math.isfinite(c) for c in x):
            v.setdefault(key, set()).add(tuple(math.floor(256 * c) for c in x))
    out = []
    for q in v:
        if q % 50 == 0:
            for x in v[q]:
                scores = sorted({(-sum(a * b for a, b in zip(x, y)), key) for key, ys in v.items() if key != q for y in ys if len(y) == len(x)})[:k]
                out += [(q, i + 1, key, -s) for i, (s, key) in enumerate(scores)]
    return sorted(out)


def test_equal_to_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(rng.integers(3), 0.2, 8)]) for i in range(700)]
    rows += [(i, rows[3][1]) for i in range(700, 750)]  # ties
    rows += [(3, rows[3][1]), (800, None), (850, [1.0, None]), (900, [float("nan")] * 8), (950, [float("inf")] + [0.0] * 7), (None, rows[0][1]), (1000, [0.1, 0.2]), (1001, [0.3, 0.2]), (1050, []), (1100, [5.0] * 3)]
    df = spark.createDataFrame([(k, x, 0) for k, x in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    vectors = integer_vectors(df, "vec_id", "embedding", 256)
    for shard, group in ((exact_topk.SHARD_ROWS, exact_topk.GROUP_BYTES), (100, 3000)):
        monkeypatch.setattr(exact_topk, "SHARD_ROWS", shard)
        monkeypatch.setattr(exact_topk, "GROUP_BYTES", group)
        got = sorted(tuple(r) for r in top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5).collect())
        assert got == brute(rows, 5)


def test_empty(spark):
    v = integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding", 256)
    assert top_k(v, v, 5).collect() == []


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c * 10, 1, (400, 6)) for c in range(5)])
    tree = exact_topk.BallTree(np.arange(len(points)), points)
    best = []
    tree.search(-1, points[7], 3, best)
    scores = points @ points[7]
    assert sorted(-b[1] for b in best) == sorted(np.lexsort((np.arange(len(scores)), -scores))[:3])


def test_neighbours_in_the_leaf_of_the_query(spark):
    rng = np.random.default_rng(2)
    rows = []
    for centre in rng.normal(0, 1, (2, 16)):
        for x in centre + rng.normal(0, 0.3, (50, 16)):  # 100 unit vectors: one leaf, the own row scores in its top 5
            rows.append((len(rows), [float(np.float32(c)) for c in x / np.linalg.norm(x)]))
    for copies in (1, 30):  # many rows of one neighbour count once as well
        table = rows + [rows[1]] * (copies - 1) + [rows[0]] * (copies - 1)
        df = spark.createDataFrame(table, "vec_id long, embedding array<float>").coalesce(1)
        vectors = integer_vectors(df, "vec_id", "embedding", 256)
        got = sorted(tuple(r) for r in top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5).collect())
        assert len(got) == 10 and got == brute(table, 5)


def test_best_of_an_earlier_tree_does_not_crowd_out_new_rows():
    points = np.ones((40, 1)) * np.arange(40, 0, -1)[:, None]
    best = []
    for ids in (np.arange(5), np.arange(40)):  # the second tree has the rows of the first again
        exact_topk.BallTree(ids, points[ids]).search(0, np.ones(1), 5, best)
    assert sorted(-b[1] for b in best) == [1, 2, 3, 4, 5]


def test_many_repeats_of_one_query(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0, 1, 8)]) for i in range(40, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    hot = spark.range(45_000).select(F.lit(50).cast("long").alias("vec_id"), F.lit(1.0).alias("x")).selectExpr("vec_id", "cast(transform(sequence(1, 8), i -> x / i) as array<float>) as embedding")
    vectors = integer_vectors(df.filter("vec_id != 50").union(hot), "vec_id", "embedding", 256)
    start = time.monotonic()
    got = sorted(tuple(r) for r in top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5).collect())
    assert time.monotonic() - start < 20
    assert got == brute([r for r in rows if r[0] != 50] + [(50, [float(np.float32(1 / i)) for i in range(1, 9)])], 5)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, [2**30 + 3 * i, 2**30 - i, 7 * i]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    got = sorted(tuple(r) for r in top_k(df, df.filter("vec_id % 50 = 0"), 3).collect())
    want = []
    for q, x in rows:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), key) for key, y in rows if key != q)[:3]
            want += [(q, i + 1, key, -s) for i, (s, key) in enumerate(best)]
    assert got == want
    huge = spark.createDataFrame([(0, [2**62]), (1, [2**62]), (2, [-(2**62)])], "vec_id long, v array<long>")  # cut to a long's range
    assert sorted(tuple(r) for r in top_k(huge, huge.filter("vec_id = 0"), 3).collect()) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_equal_vectors_are_thinned():
    ids, points = exact_topk.thinned(np.array([5, 3, 9, 3, 7, 1]), np.array([[1, 2], [1, 2], [1, 2], [1, 2], [0, 1], [0, 1]]), 2)
    assert sorted(zip(ids.tolist(), points.tolist())) == [(1, [0, 1]), (3, [1, 2]), (5, [1, 2]), (7, [0, 1])]
