"""Global rank buckets without an unpartitioned window.

``pd.qcut(x.rank(method='first'), q)`` assigns rank r (1-based, ties broken
by a total order) to bucket ``j`` for the smallest j with
``r <= 1 + floor(j (n-1) / q)``.  So only the q-1 cut elements of the total
order ``(value, key)`` matter.  Each is found with the distributed exact
selection: first the value at that rank, then the key at the remaining rank
among the rows tied on that value.  A row's bucket is ``1 +`` the number of
cut elements it is lexicographically greater than.  All value columns are
handled together: one selection for the values, one aggregate for the
counts below them and one selection for the tie keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import select_kth, select_kth_any


def rank_cuts_many(df: DataFrame, values: list[str], key: str, n: int, q: int = 4) -> dict[str, list[tuple]]:
    """{value column: [(cut value, cut key)] * (q-1)} for a frame with one row per key."""
    ranks = [1 + (j * (n - 1)) // q for j in range(1, q)]  # 1-based cut ranks
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("gid"), F.col(v).cast("double").alias("v"))
                                for i, v in enumerate(values)])).alias("x")
    vals = select_kth(df.select(cells).select("x.gid", "x.v"),
                      [(i, r - 1) for i in range(len(values)) for r in ranks])
    targets = [(i, j, vals[(i, r - 1)]) for i in range(len(values)) for j, r in enumerate(ranks)]
    below = df.agg(*[F.count_if(F.col(values[i]) < F.lit(cv)).alias(f"b{i}_{j}") for i, j, cv in targets]).first()
    tie_cells = F.explode(F.array(*[
        F.when(F.col(values[i]) == F.lit(cv), F.struct(F.lit(t).alias("gid"), F.col(key).alias("v")))
        for t, (i, j, cv) in enumerate(targets)])).alias("x")
    ties = df.select(tie_cells).filter(F.col("x").isNotNull()).select("x.gid", "x.v")
    want = [(t, ranks[j] - 1 - below[f"b{i}_{j}"]) for t, (i, j, cv) in enumerate(targets)]
    keys = select_kth_any(ties, want)
    out: dict[str, list[tuple]] = {v: [] for v in values}
    for t, (i, j, cv) in enumerate(targets):
        out[values[i]].append((cv, keys[want[t]]))
    return out


def rank_cuts(df: DataFrame, value: str, key: str, n: int, q: int = 4) -> list[tuple]:
    return rank_cuts_many(df, [value], key, n, q)[value]


def bucket_of(value: str, key: str, cuts: list[tuple]) -> Column:
    """1 + number of cut elements that ``(value, key)`` is strictly after."""
    expr = F.lit(1)
    for cv, ck in cuts:
        v = F.col(value).cast("double")
        after = (v > F.lit(cv)) | ((v == F.lit(cv)) & (F.col(key) > F.lit(ck)))
        expr = expr + F.when(after, 1).otherwise(0)
    return expr.cast("long")


def qcut_rank(df: DataFrame, value: str, key: str, out: str, n: int, q: int = 4) -> DataFrame:
    """Add ``out`` = qcut bucket (1..q) of ``rank(method='first')`` of ``value``."""
    return df.withColumn(out, bucket_of(value, key, rank_cuts(df, value, key, n, q)))
