"""Nearest neighbours by vantage-point trees per shard (operator 7).

Equal vectors are one index point that keeps its smallest ids (more of them than
any answer can use), so a vector shared by a third of all rows costs one point.
Points are dealt by hash into shards of bounded size; each shard's tree is built
in one task and the index is written as a table, one row per shard.

Queries are searched in blocks of bounded size: a block is broadcast, each task
walks the trees of its shards and keeps the best of them, and a last step merges
the tasks' bests.  A subtree is skipped when the triangle inequality, its margin
multiplied by ``relax``, says that it cannot hold a nearer point.  ``relax`` 1 is
exact search; larger factors skip more and may miss neighbours.

Nearness is the Euclidean distance in double precision on the original
components, summed in component order; ties go to the smaller vec_id.

Vectors null, zero or holding null or non-finite components, and rows without
id, take no part.  Vectors of another length than the query's are no candidates.
Repeated rows (same id, same vector) count once.  Empty tables give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stored
from .registry import register

SHARD_POINTS = 4096
LEAF_POINTS = 64
QUERY_BLOCK = 4096

INDEX = "shard long, dim int, points binary, ids array<array<long>>, order binary, nodes binary"


def usable_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part, each once."""
    v = F.col("embedding").cast("array<double>")
    fits = (F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
            & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists("v", lambda x: x != 0))
    # -0.0 and 0.0 are the same component, also for grouping.
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(fits)
            .select("vec_id", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).alias("v")).distinct())


def distinct_points(vectors: DataFrame, keep: int) -> DataFrame:
    """v, ids: the ``keep`` smallest ids of every distinct vector."""
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id")) <= keep  # limited before the shuffle too
    return (vectors.select("*", first.alias("first")).filter("first").groupBy("v")
            .agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))


def build_tree(points: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points and nodes (vantage, radius, inside range, outside range) of one shard's tree.

    A node owns order[lo:hi]; its vantage point is order[lo], the nearer half of the
    rest order[lo + 1:mid], the farther half order[mid:hi].  Rows of ``nodes``: lo, mid, hi, radius.
    """
    rng = np.random.default_rng(seed)
    order, nodes, todo = np.arange(len(points)), [], [(0, len(points))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= LEAF_POINTS:
            continue
        pick = lo + int(rng.integers(hi - lo))
        order[lo], order[pick] = order[pick], order[lo]
        rest = order[lo + 1:hi]
        far = np.sqrt(((points[rest] - points[order[lo]]) ** 2).sum(1))
        half = len(rest) // 2
        part = np.argpartition(far, half)
        order[lo + 1:hi] = rest[part]
        mid = lo + 1 + half
        nodes.append((lo, mid, hi, far[part[half]]))
        todo += [(lo + 1, mid), (mid, hi)]
    return order, np.array(nodes, dtype=np.float64).reshape(-1, 4)


def build_index(vectors: DataFrame, keep: int, shard_points: int = SHARD_POINTS) -> DataFrame:
    points = stored(distinct_points(vectors, keep), "points")
    shards = max(1, -(-points.count() // shard_points))
    dealt = points.select(F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"), F.size("v").alias("dim"), "v", "ids")

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        points = values.astype(np.float64).reshape(-1, dim)
        order, nodes = build_tree(points, key[0].as_py())
        return pa.table({"shard": [key[0]], "dim": pa.array([dim], pa.int32()), "points": [points.tobytes()],
                         "ids": [table.column("ids").to_pylist()], "order": [order.astype(np.int64).tobytes()],
                         "nodes": [nodes.tobytes()]}, schema=pa.schema([
                             ("shard", pa.int64()), ("dim", pa.int32()), ("points", pa.binary()),
                             ("ids", pa.list_(pa.list_(pa.int64()))), ("order", pa.binary()), ("nodes", pa.binary())]))

    return stored(dealt.groupBy("shard", "dim").applyInArrow(build, INDEX), "vp-index")


class Best:
    """The k smallest (distance, id) found so far of every query, the query's own id left out."""

    def __init__(self, own: np.ndarray, k: int):
        self.own, self.k = own, k
        self.far = np.full((len(own), k), np.inf)
        self.ids = np.full((len(own), k), np.iinfo(np.int64).max)

    def offer(self, q: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        """Distances and ids (0 padded with inf) of shape (queries q, candidates)."""
        far = np.where(ids == self.own[q][:, None], np.inf, far)
        ids = np.where(np.isinf(far), np.iinfo(np.int64).max, ids)
        far, ids = np.concatenate([self.far[q], far], 1), np.concatenate([self.ids[q], ids], 1)
        kept = np.lexsort((ids, far), axis=1)[:, :self.k]
        self.far[q], self.ids[q] = np.take_along_axis(far, kept, 1), np.take_along_axis(ids, kept, 1)


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, squares added in component order."""
    total = np.zeros((len(queries), len(points)))
    for c in range(queries.shape[1]):
        total += (queries[:, c, None] - points[None, :, c]) ** 2
    return np.sqrt(total)


def search_tree(queries: np.ndarray, best: Best, points: np.ndarray, ids: np.ndarray, padded: np.ndarray,
                order: np.ndarray, nodes: np.ndarray, relax: float) -> None:
    """Offer the tree's points to ``best``; all queries walk together, each by its own pruning."""
    by_start = {(int(lo), int(hi)): (int(mid), radius) for lo, mid, hi, radius in nodes}

    def offer(q, where):
        far = distances(queries[q], points[where])
        best.offer(q, np.repeat(far, ids.shape[1], 1) + np.tile(padded[where].ravel(), (len(q), 1)), np.tile(ids[where].ravel(), (len(q), 1)))
        return far

    def walk(lo, hi, q):
        if not len(q) or lo >= hi:
            return
        node = by_start.get((lo, hi))
        if node is None:
            offer(q, order[lo:hi])
            return
        mid, radius = node
        margin = offer(q, order[lo:lo + 1])[:, 0] - radius  # below 0: inside
        inside = margin < 0
        walk(lo + 1, mid, q[inside])
        walk(mid, hi, q[~inside])
        # The other side lies at least |margin| away; ties of the distance, and rounding, must still be seen.
        open_ = relax * np.abs(margin) <= best.far[q, -1] * (1 + 1e-9)
        walk(mid, hi, q[inside & open_])
        walk(lo + 1, mid, q[~inside & open_])

    walk(0, len(order), np.arange(len(queries)))


def search_index(index: DataFrame, queries: DataFrame, k: int, relax: float = 1.0, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest index points of every row of ``queries`` (vec_id, v)."""
    spark = index.sparkSession
    numbered = stored(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(
        max(1, -(-2 * queries.count() // block))))), "queries")
    found = None
    for (number,) in sorted(numbered.select("block").distinct().collect()):
        rows = numbered.filter(F.col("block") == number).select("vec_id", "v").collect()
        part = _search_block(index, spark.sparkContext.broadcast([(r["vec_id"], r["v"]) for r in rows]), k, relax)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_block(index: DataFrame, queries, k: int, relax: float) -> DataFrame:
    def search(batches):
        by_dim: dict[int, list] = {}
        for query, vector in queries.value:
            by_dim.setdefault(len(vector), []).append((query, vector))
        groups = {d: (np.array([v for _, v in rows]), Best(np.array([q for q, _ in rows], dtype=np.int64), k)) for d, rows in by_dim.items()}
        for batch in batches:
            for shard in batch.to_pylist():
                if shard["dim"] not in groups:
                    continue
                vectors, best = groups[shard["dim"]]
                points = np.frombuffer(shard["points"]).reshape(-1, shard["dim"])
                width = max(map(len, shard["ids"]))
                ids = np.array([x + [0] * (width - len(x)) for x in shard["ids"]], dtype=np.int64)
                padded = np.where(np.arange(width)[None, :] < np.array([len(x) for x in shard["ids"]])[:, None], 0.0, np.inf)
                search_tree(vectors, best, points, ids, padded, np.frombuffer(shard["order"], dtype=np.int64),
                            np.frombuffer(shard["nodes"]).reshape(-1, 4), relax)
        for _, best in groups.values():
            query, place = np.nonzero(np.isfinite(best.far))
            yield pa.RecordBatch.from_arrays([pa.array(best.own[query]), pa.array(best.ids[query, place]), pa.array(best.far[query, place])],
                                             ["query_id", "vec_id", "score"])

    return index.mapInArrow(search, "query_id long, vec_id long, score double")


def nearest(rows: DataFrame, is_query, k: int = 10, relax: float = 1.0) -> DataFrame:
    """k nearest other rows (vec_id, embedding) of the rows for which ``is_query`` holds."""
    vectors = stored(usable_vectors(rows), "vectors")
    return search_index(build_index(vectors, k + 1), vectors.filter(is_query), k, relax)


ORACLE = """
WITH u AS (SELECT DISTINCT vec_id, v FROM (
             SELECT vec_id, embedding, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
           WHERE len(v) > 0 AND len([x for x in v if x IS NULL OR isnan(x) OR isinf(x)]) = 0
             AND len([x for x in v if x <> 0]) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce([(q.v[i] - c.v[i]) * (q.v[i] - c.v[i]) for i in generate_series(1, len(q.v))], lambda a, b: a + b)) AS score
      FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@register("op7_vantage_point_search", ORACLE)
def op7_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
