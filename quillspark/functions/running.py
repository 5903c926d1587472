"""Running totals and neighbours without a global window."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def _spread(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` range partitioned by keys and order, written, with the number of the range."""
    spark, path = rows.sparkSession, f"{scratch_path(rows.sparkSession, 'running')}/{uuid.uuid4().hex}"
    spread = rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id())
    spread.write.parquet(path)
    return spark.read.schema(spread.schema).parquet(path)


def running_totals(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """``rows`` with ``before`` (sum of ``value`` over the rows of equal keys that come earlier) and ``total`` per key.

    Each range starts from the sums of the ranges before, so a key that holds most rows is spread over many tasks.
    """
    spread = _spread(rows.withColumn("__value", value), keys, order)
    sums = spread.groupBy(*keys, "__range").agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sums.select(*keys, "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"),
                         F.sum("__sum").over(Window.partitionBy(*keys)).alias("total"))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return placed.join(starts, [*keys, "__range"]).select(
        *rows.columns, (F.col("__start") + F.col("__inside")).alias("before"), "total")


def with_previous(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``previous``: the next smaller ``value`` of the same key (values are distinct per key).

    Neighbours are found inside each range; the first row of a range takes the last value of the key's range before.
    """
    spread = _spread(rows, keys, [value])
    inside = Window.partitionBy(*keys, "__range").orderBy(value)
    ends = spread.groupBy(*keys, "__range").agg(F.max(value).alias("__last"))
    carried = ends.select(*keys, "__range", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__range")).alias("__carried"))
    return spread.withColumn("__own", F.lag(value).over(inside)).join(carried, [*keys, "__range"]).select(
        *rows.columns, F.coalesce("__own", "__carried").alias("previous"))
