""""Why did the metric change" drill-down.

One scan for all dimensions: the rows of both periods are unpivoted to
``(dimension, segment)`` and summed per segment with conditional sums.  The
largest mover of each dimension is a ``min_by`` aggregate (no window), the
drivers are ranked by their share of the total change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _between(c, s, e):
    return (F.col(c) >= F.lit(s).cast("timestamp_ntz")) & (F.col(c) <= F.lit(e).cast("timestamp_ntz"))


def diagnose(df: DataFrame, date: str, metric: str, dims: list[str], start: str, end: str,
             compare_start: str, compare_end: str, top: int = 3) -> DataFrame:
    """Top drivers ``(rank, dimension, segment, current, previous, delta, contribution_pct, ...)``.

    Empty when the comparison period totals 0 (the reference answers with a
    message only).
    """
    cur, prev = _between(date, start, end), _between(date, compare_start, compare_end)
    base = df.select(date, metric, *dims).filter(cur | prev)
    m = F.col(metric).cast("double")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("dim_pos"), F.lit(d).alias("dimension"),
                                         F.col(d).cast("string").alias("segment")) for i, d in enumerate(dims)]))
    per_all = (base.select(cells.alias("c"), cur.alias("_cur"), prev.alias("_prev"), m.alias("_m"))
                   .groupBy("c.dim_pos", "c.dimension", "c.segment")
                   .agg(F.sum(F.when(F.col("_cur"), F.col("_m")).otherwise(0.0)).alias("current"),
                        F.sum(F.when(F.col("_prev"), F.col("_m")).otherwise(0.0)).alias("previous"),
                        F.count(F.when(F.col("_cur"), F.col("_m"))).alias("n_cur"),
                        F.count(F.when(F.col("_prev"), F.col("_m"))).alias("n_prev")))
    # Every row has exactly one segment of the first dimension, so the period
    # totals are sums over that dimension's segments.  Conditional sums (no
    # filter to push down) and the same aggregate columns in both branches keep
    # the two subtrees identical, so Spark reuses one exchange: a single scan.
    first = F.col("dim_pos") == 0
    totals = per_all.agg(
        F.when(F.sum(F.when(first, F.col("n_cur"))) > 0, F.sum(F.when(first, F.col("current")))).otherwise(0.0)
         .alias("total_current"),
        F.when(F.sum(F.when(first, F.col("n_prev"))) > 0, F.sum(F.when(first, F.col("previous")))).otherwise(0.0)
         .alias("total_previous"))
    per = per_all.filter((F.col("previous") > 0) | (F.col("current") > 0))
    rec = F.struct("segment", "current", "previous", "n_cur", "n_prev")
    order_key = F.struct((-F.abs(F.col("current") - F.col("previous"))).alias("a"), F.col("segment").alias("s"))
    best = (per.groupBy("dim_pos", "dimension").agg(F.min_by(rec, order_key).alias("b"))
               .select("dim_pos", "dimension", "b.segment", "b.current", "b.previous"))
    delta_t = F.col("total_current") - F.col("total_previous")
    d = F.col("current") - F.col("previous")
    drivers = (best.crossJoin(F.broadcast(totals))
                   .filter(F.col("total_previous") != 0)
                   .withColumn("delta", d)
                   .withColumn("contribution_pct",
                               F.when(F.abs(delta_t) > 0, F.abs(d / delta_t) * 100).otherwise(0.0)))
    return (drivers.orderBy(F.col("contribution_pct").desc(), "dim_pos").limit(top)
                   .select("dimension", "segment", F.round("current", 2).alias("current"),
                           F.round("previous", 2).alias("previous"), F.round("delta", 2).alias("delta"),
                           F.round("contribution_pct", 2).alias("contribution_pct"),
                           F.when(F.col("delta") < 0, "dropped").otherwise("grew").alias("impact"),
                           F.round("total_current", 2).alias("total_current"),
                           F.round("total_previous", 2).alias("total_previous"),
                           F.round(delta_t / F.col("total_previous") * 100, 2).alias("pct_change"),
                           F.when(delta_t < 0, "dropped").otherwise("increased").alias("direction")))


def diagnose_answer(df: DataFrame, date: str, metric: str, dims: list[str], start: str, end: str,
                    compare_start: str, compare_end: str) -> DataFrame:
    """The diagnosis tool's rows: the drivers, or one row with the message and the current total
    where the comparison period totals 0."""
    drivers = diagnose(df, date, metric, dims, start, end, compare_start, compare_end)
    rows = drivers.withColumn("analysis", F.lit(None).cast("string"))
    m = F.col(metric).cast("double")
    totals = df.agg(F.coalesce(F.sum(F.when(_between(date, start, end), m)), F.lit(0.0)).alias("cur"),
                    F.coalesce(F.sum(F.when(_between(date, compare_start, compare_end), m)), F.lit(0.0)).alias("prev"))
    # Fixed value: the tool's message.
    text = f"Previous period ({compare_start} to {compare_end}) has 0 value. Cannot calculate change."
    none = totals.filter("prev = 0").select(F.round("cur", 2).alias("total_current"), F.lit(text).alias("analysis"))
    return rows.unionByName(none, allowMissingColumns=True)
