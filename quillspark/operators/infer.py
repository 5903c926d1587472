"""Schema inference: numeric / date / categorical / string.

One aggregate over all columns gives, per column, the non-null count and
how many values parse as a number or a date.  Distinct counts are computed
only for the columns that the categorical test still has to decide, with one
``(column, value)`` distinct aggregate instead of N ``countDistinct``
expressions (which would plan an Expand with one copy of the row per column).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_date
from ..functions.numbers import parse_number

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType, T.BooleanType)
DATE_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def heuristic_type(name: str, patterns: dict) -> str | None:
    low = name.lower()
    for p in patterns.get("date", []):
        if re.search(p, low):
            return "date"
    for key in ("ids", "text"):
        for p in patterns.get(key, []):
            if re.search(p, low):
                return "string"
    return None


def _num(c: str, dtype):
    if isinstance(dtype, NUMERIC_TYPES):
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    if isinstance(dtype, DATE_TYPES):
        return F.lit(None).cast("double")
    return parse_number(c)


def column_counts(df: DataFrame, needs: dict | None = None) -> dict:
    """{column: {n, nonnull, num_ok, date_ok}} from a single aggregate.

    ``needs`` maps a column to the parse tests its rule actually uses
    (``{"num", "date"}``); by default both are counted for every column.
    """
    proj, aggs = [], [F.count(F.lit(1)).alias("__n")]
    for i, f in enumerate(df.schema.fields):
        c = f.name
        want = needs.get(c, {"num", "date"}) if needs is not None else {"num", "date"}
        proj.append(F.col(c).isNotNull().alias(f"nn{i}"))
        aggs.append(F.count_if(F.col(f"nn{i}")).alias(f"nn{i}"))
        if "num" in want:
            proj.append(_num(c, f.dataType).isNotNull().alias(f"num{i}"))
            aggs.append(F.count_if(F.col(f"num{i}")).alias(f"num{i}"))
        if "date" in want:
            proj.append(parse_date(c, f.dataType).isNotNull().alias(f"dt{i}"))
            aggs.append(F.count_if(F.col(f"dt{i}")).alias(f"dt{i}"))
    r = df.select(*proj).agg(*aggs).collect()[0].asDict()
    return {f.name: {"n": r["__n"], "nonnull": r[f"nn{i}"], "num_ok": r.get(f"num{i}", 0),
                     "date_ok": r.get(f"dt{i}", 0)} for i, f in enumerate(df.schema.fields)}


def distinct_counts(df: DataFrame, columns: list[str]) -> dict:
    """Exact non-null distinct count per column via one (column, value) aggregate."""
    if not columns:
        return {}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("string").alias("v"))
                                for i, c in enumerate(columns)])).alias("cell")
    rows = (df.select(cells).select("cell.k", "cell.v").filter(F.col("v").isNotNull())
              .distinct().groupBy("k").count().collect())
    got = {r["k"]: r["count"] for r in rows}
    return {c: got.get(i, 0) for i, c in enumerate(columns)}


def infer_types(df: DataFrame, config: dict, counts: dict | None = None) -> list[dict]:
    """``[{column, type}]`` in column order."""
    th = config["coercion_thresholds"]
    heur = config.get("schema_heuristics", {"enabled": False})
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    hints = {c: (heuristic_type(c, heur.get("patterns", {})) if heur.get("enabled") else None) for c in df.columns}
    needs = {}
    for c in df.columns:
        if hints[c] == "date":
            needs[c] = {"date"}
        elif hints[c] == "string" or isinstance(dtypes[c], DATE_TYPES):
            needs[c] = set()
        else:
            needs[c] = {"num", "date"} if isinstance(dtypes[c], T.StringType) else {"num"}
    counts = counts or column_counts(df, needs)
    decided, pending = {}, []
    for c in df.columns:
        s = counts[c]
        h = hints[c]
        nn = s["nonnull"]
        if nn == 0:
            decided[c] = "string"
        elif h == "date":
            decided[c] = "date" if s["date_ok"] / nn >= 0.4 else "string"
        elif h == "string":
            decided[c] = "string"
        elif isinstance(dtypes[c], DATE_TYPES):
            decided[c] = "date"
        elif s["num_ok"] / nn >= th["numeric"]:
            decided[c] = "numeric"
        elif isinstance(dtypes[c], T.StringType) and s["date_ok"] / nn >= th["date"]:
            decided[c] = "date"
        else:
            pending.append(c)
    dist = distinct_counts(df, pending)
    for c in pending:
        ratio = dist[c] / counts[c]["n"] if counts[c]["n"] else 1.0
        decided[c] = "categorical" if ratio <= th["categorical_unique_ratio"] else "string"
    return [{"column": c, "type": decided[c]} for c in df.columns]


def schema_frame(spark, schema: list[dict]) -> DataFrame:
    return spark.createDataFrame([(i, s["column"], s["type"]) for i, s in enumerate(schema)],
                                 "pos long, column string, type string")


def apply_types(df: DataFrame, schema: list[dict]) -> DataFrame:
    """Typed view: numeric -> double (try_cast), date -> timestamp, others as is."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for s in schema:
        c, t = s["column"], s["type"]
        if t == "numeric":
            cols.append(_num(c, dtypes[c]).alias(c))
        elif t == "date":
            cols.append(parse_date(c, dtypes[c]).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)
