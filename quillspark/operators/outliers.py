"""Outlier counts per numeric column.

IQR fences use exact linear-interpolated quartiles from the distributed
selection; z-scores use the population standard deviation.  Both counts for
every column come from one aggregate after the statistics are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.selection import quantiles


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("gid"), F.col(c).cast("double").alias("v"))
                                for i, c in enumerate(columns)])).alias("cell")
    return df.select(cells).select("cell.gid", "cell.v").filter(F.col("v").isNotNull() & ~F.isnan("v"))


def moment_aggs(columns: list[str], prefix: str = "") -> list:
    """count / mean / population std per column, to fold into a caller's aggregate."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"{prefix}n{i}"), F.avg(v).alias(f"{prefix}m{i}"),
                 F.stddev_pop(v).alias(f"{prefix}s{i}")]
    return aggs


def outlier_stats(df: DataFrame, columns: list[str], iqr_k: float = 1.5, z_t: float = 3.0,
                  min_n: int = 4, moments: dict | None = None, exact: bool = True) -> list[dict]:
    """Per column: n, q1, q3, lower, upper, mean, std_pop, iqr_count, z_count.

    ``moments`` (keys ``n{i}``, ``m{i}``, ``s{i}``) skips the first aggregate
    when the caller already computed them in its own pass.
    """
    if not columns:
        return []
    first = moments if moments is not None else df.agg(*moment_aggs(columns)).collect()[0].asDict()
    counts = {i: first[f"n{i}"] for i in range(len(columns)) if first[f"n{i}"] >= min_n}
    qs = quantiles(_values(df, columns), "gid", "v", counts, [0.25, 0.5, 0.75], exact=exact) if counts else {}
    out, aggs2 = [], []
    for i, c in enumerate(columns):
        n = first[f"n{i}"]
        rec = {"column": c, "n": n, "mean": first[f"m{i}"], "std_pop": first[f"s{i}"], "q1": None, "q3": None,
               "lower": None, "upper": None, "iqr_count": 0, "z_count": 0}
        if n >= min_n:
            q1, q3 = qs[(i, 0.25)], qs[(i, 0.75)]
            rec.update(q1=q1, q3=q3, median=qs[(i, 0.5)], lower=q1 - iqr_k * (q3 - q1), upper=q3 + iqr_k * (q3 - q1))
            v = F.col(c).cast("double")
            aggs2.append(F.count_if((v < F.lit(rec["lower"])) | (v > F.lit(rec["upper"]))).alias(f"i{i}"))
            sd = rec["std_pop"]
            if sd:
                aggs2.append(F.count_if(F.abs((v - F.lit(rec["mean"])) / F.lit(sd)) > z_t).alias(f"z{i}"))
        out.append(rec)
    if aggs2:
        second = df.agg(*aggs2).collect()[0].asDict()
        for i, rec in enumerate(out):
            rec["iqr_count"] = second.get(f"i{i}", 0) or 0
            rec["z_count"] = second.get(f"z{i}", 0) or 0
    return out
