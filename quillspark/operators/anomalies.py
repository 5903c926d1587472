"""Z-score anomalies.

Column means and sample standard deviations come from one aggregate (a
1-row frame broadcast back); rows are unpivoted to ``(column, value)`` and
filtered.  The insight keeps the first 6 hits in column order, then row
order (``orderBy(...).limit(6)`` = TakeOrderedAndProject, bounded per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anomaly_hits(df: DataFrame, columns: list[str], row_id: str, threshold: float = 2.0) -> DataFrame:
    """All ``(col_pos, column, row_id, value, z_score)`` with ``|z| > threshold``."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(c).alias(f"_m{i}"), F.stddev_samp(c).alias(f"_s{i}")]
    stats = df.agg(*aggs)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("column"),
                                         F.col(c).cast("double").alias("value"),
                                         F.col(f"_m{i}").alias("m"), F.col(f"_s{i}").alias("s"))
                                for i, c in enumerate(columns)])).alias("cell")
    z = (F.col("cell.value") - F.col("cell.m")) / F.col("cell.s")
    return (df.select(F.col(row_id).alias("row_id"), *columns).crossJoin(F.broadcast(stats))
              .select("row_id", cells)
              .filter(F.col("cell.s").isNotNull() & (F.col("cell.s") != 0) & F.col("cell.value").isNotNull())
              .select(F.col("cell.col_pos").cast("long").alias("col_pos"), F.col("cell.column").alias("column"),
                      "row_id", F.col("cell.value").alias("value"), z.alias("z_score"))
              .filter(F.abs("z_score") > threshold))


def anomalies(df: DataFrame, columns: list[str], row_id: str, threshold: float = 2.0, first: int = 6) -> DataFrame:
    hits = anomaly_hits(df, columns, row_id, threshold)
    return (hits.orderBy("col_pos", "row_id").limit(first)
                .select("col_pos", "column", "row_id", F.round("value", 4).alias("value"),
                        F.round("z_score", 4).alias("z_score")))


def anomaly_severity(hits: DataFrame) -> DataFrame:
    """List-view and table-view severity labels of the anomaly widgets."""
    az = F.abs(F.col("z_score"))
    return hits.select("column", "row_id", F.round("value", 4).alias("value"),
                       F.round("z_score", 4).alias("z_score"),
                       F.when(az >= 3, "Critical").when(az >= 2, "Warning").otherwise("Minor").alias("severity"),
                       F.when(az > 3, "Critical").when(az > 2, "High").otherwise("Low").alias("table_severity"))
