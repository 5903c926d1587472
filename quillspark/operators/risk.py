"""Order-health risk.

Status shares over non-null rows; every (keyword, status) pair where the
status contains the keyword (case-insensitive) adds its share * 100.  The
status counts are one ``groupBy`` (partial aggregation); the keyword match is
a broadcast nested-loop join against a literal keyword frame (proven size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference: statuses counted as risk.
BAD_STATUSES = ["Disputed", "Cancelled", "On Hold", "Returned", "Refunded"]


def risk_analysis(df: DataFrame, status: str, keywords: list[str] | None = None) -> DataFrame:
    """One row ``(risk_score, risk_level, reason)``; no row when the score is 0."""
    keywords = keywords or BAD_STATUSES
    spark = df.sparkSession
    # The total is a sum over the same status counts (one row, broadcast): no task
    # needs all statuses, also where the column is free text.
    per = (df.select(F.col(status).cast("string").alias("status")).filter(F.col("status").isNotNull())
             .groupBy("status").agg(F.count(F.lit(1)).alias("cnt")))
    counts = per.crossJoin(F.broadcast(per.agg(F.sum("cnt").alias("total"))))
    kw = spark.createDataFrame(list(enumerate(keywords)), "kpos int, keyword string")
    m = (counts.join(F.broadcast(kw), F.lower("status").contains(F.lower("keyword")))
               .select("kpos", "status", "cnt", (F.col("cnt") / F.col("total")).alias("share")))
    reason = F.format_string("%s: %.1f%%", F.col("status"), F.col("share") * 100)
    agg = m.agg(F.sum(F.col("share") * 100).alias("score"),
                F.array_sort(F.collect_list(F.struct(F.col("kpos"), (-F.col("cnt")).alias("nc"),
                                                     F.col("status"), reason.alias("r")))).alias("rs"))
    score = F.col("score")
    return (agg.filter(score.isNotNull() & (score > 0))
               .select(F.round(score, 4).alias("risk_score"),
                       F.when(score > 10, "High").when(score > 5, "Medium").otherwise("Low").alias("risk_level"),
                       F.array_join(F.transform("rs", lambda s: s["r"]), ", ").alias("reason")))
