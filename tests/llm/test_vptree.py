import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm.vptree import Best, build_index, build_tree, nearest, op7_vantage_point_search, search_index, search_tree, usable_vectors


def brute(rows, is_query, k=10):
    usable = {(i, tuple(float(x) + 0.0 for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = set()
    for q, a in usable:
        if is_query(q):
            near = sorted((math.sqrt(sum_in_order(a, b)), i) for i, b in usable if i != q and len(a) == len(b))
            out |= {(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])}
    return out


def sum_in_order(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return total


def test_edge_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=4).astype(np.float32).tolist()) for k in range(120)]
    rows += [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(200, 260)]  # one common vector
    rows += [(300, None), (301, []), (302, [0.0] * 4), (303, [1.0, None, 2.0, 3.0]), (304, [float("nan")] * 4), (305, [float("inf"), 1.0, 1.0, 1.0]),
             (None, [1.0, 1.0, 1.0, 1.0]), (310, [1.0, 2.0]), (320, [2.0, 1.0]), (5, rows[5][1]), (330, [-0.0, 1.0, 0.0, 1.0]), (340, [0.0, 1.0, -0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<float>, ids string, rank int")
    got = {tuple(r) for r in nearest(df, F.col("vec_id") % 10 == 0).collect()}
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert nearest(df, F.col("vec_id") < 0).count() == 0


def test_many_shards_and_query_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=3).tolist()) for k in range(400)]
    vectors = usable_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    index = build_index(vectors, 11, shard_points=50)
    assert index.count() > 4
    got = {tuple(r) for r in search_index(index, vectors.filter("vec_id % 20 = 0"), 10, block=8).collect()}
    assert got == brute(rows, lambda i: i % 20 == 0)


def recall(points, relax, k=10):
    order, nodes = build_tree(points, 1)
    ids = np.arange(len(points))[:, None]
    queries = np.arange(0, len(points), 50)
    best = Best(queries, k)
    search_tree(points[queries], best, points, ids, np.zeros((len(points), 1)), order, nodes, relax)
    far = np.sqrt(((points[queries][:, None] - points[None]) ** 2).sum(-1))
    far[np.arange(len(queries)), queries] = np.inf
    truth = np.argsort(far, 1, kind="stable")[:, :k]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(best.ids, truth)])


def test_factor_one_is_exact_and_larger_factors_trade_recall():
    points = np.random.default_rng(3).normal(size=(4000, 8))
    assert recall(points, 1.0) == 1.0
    assert recall(points, 1.5) >= 0.9
    assert recall(points, 50.0) < 1.0


@pytest.mark.parametrize("relax", [1.0])
def test_op7_recall(spark, small, relax):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert {tuple(r) for r in op7_vantage_point_search(spark, small).collect()} == brute(rows, lambda i: i % 100 == 0)
