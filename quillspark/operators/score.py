"""Health score and message.

score = .35 completeness + .2 uniqueness + .2 consistency + .15 validity
        - .1 outlier penalty, clamped to [0, 1], rounded to 2.
Denominators use the cleaned frame's rows and cells.  Perfect data scores
0.90, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .validate import COERCION, DUPLICATES, MISSING, MIXED, OUTLIERS

# Fixed values that must equal the reference: health messages by score band.
MESSAGES = [
    (0.9, "Excellent data quality. Your data is ready for analysis."),
    (0.75, "Good data quality with minor issues that were safely resolved. Your data is ready for analysis."),
    (0.6, "Minor data quality issues were found and safely resolved. Your data is ready for analysis."),
    (0.4, "Moderate data quality issues detected. Some issues were resolved, but manual review is recommended."),
    (-1.0, "Significant data quality issues detected. Manual review and correction strongly recommended "
           "before analysis."),
]


def score_components(issues: DataFrame, rows: F.Column, cols: F.Column) -> DataFrame:
    """One row with the five components and the score, from the issue frame.

    ``rows`` / ``cols`` are columns of a 1-row frame joined in by the caller.
    """
    first_dup = F.min_by(F.when(F.col("issue") == DUPLICATES, F.col("rows_affected")),
                         F.when(F.col("issue") == DUPLICATES, F.col("pos")))
    agg = issues.agg(
        F.coalesce(F.sum(F.when(F.col("issue") == MISSING, F.col("rows_affected"))), F.lit(0)).alias("missing"),
        F.coalesce(first_dup, F.lit(0)).alias("dups"),
        F.coalesce(F.sum(F.when(F.col("issue").isin(MIXED, COERCION), F.col("rows_affected"))), F.lit(0))
         .alias("consist"),
        F.coalesce(F.sum(F.when(~F.col("issue").isin(MISSING, DUPLICATES, MIXED, COERCION, OUTLIERS),
                                F.col("rows_affected"))), F.lit(0)).alias("invalid"),
        F.coalesce(F.sum(F.when(F.col("issue") == OUTLIERS, F.col("rows_affected"))), F.lit(0)).alias("outl"))
    return agg


def health_score(issues: DataFrame, shape: DataFrame, weights: dict) -> DataFrame:
    """``shape`` is a 1-row frame with ``n_rows`` and ``n_cols`` of the cleaned table."""
    a = score_components(issues, None, None).crossJoin(F.broadcast(shape))
    r, c = F.col("n_rows").cast("double"), F.col("n_cols").cast("double")
    cells = r * c
    completeness = F.when(cells == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("missing") / cells))
    uniqueness = F.when(r == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("dups") / r))
    consistency = F.when(r == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("consist") / cells))
    validity = F.when(r == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("invalid") / r))
    penalty = F.when(r == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("outl") / r))
    raw = (completeness * weights["completeness"] + uniqueness * weights["uniqueness"]
           + consistency * weights["consistency"] + validity * weights["validity"]
           - penalty * weights["outlier_penalty"])
    return a.select(F.round(completeness, 4).alias("completeness"), F.round(uniqueness, 4).alias("uniqueness"),
                    F.round(consistency, 4).alias("consistency"), F.round(validity, 4).alias("validity"),
                    F.round(penalty, 4).alias("outlier_penalty"),
                    F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 2).alias("health_score"))


def health_message(score: F.Column) -> F.Column:
    expr = None
    for bound, msg in reversed(MESSAGES):
        expr = F.lit(msg) if expr is None else F.when(score >= bound, F.lit(msg)).otherwise(expr)
    return expr


def with_message(scored: DataFrame, status: str = "READY", threshold: float = 0.6) -> DataFrame:
    s = F.col("health_score")
    return scored.select("health_score", health_message(s).alias("message"),
                         ((s >= threshold) & F.lit(status == "READY")).alias("analytics_ready"))
