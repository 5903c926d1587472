"""Result shaping for charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Preferred key and value column names, in order.
ID_KEYS = ["id", "name", "label", "category"]
VALUE_KEYS = ["value", "count", "total"]
# Fixed values that must equal the reference: rows shown by the table, anomaly and recommendation widgets.
DISPLAY_CAPS = {"table": 10, "anomalies": 8, "recommendations": 6}
# Fixed values that must equal the reference: names of the x and y keys of a result, in order.
X_CANDIDATES = ["id", "month", "date", "year", "label", "category", "name", "x", "status", "region"]
Y_CANDIDATES = ["value", "count", "total", "amount", "revenue", "y", "sales"]


def infer_xy_keys(columns: list[str]) -> tuple[str, str]:
    """Axis columns of a result frame (names only, no data pass)."""
    if not columns:
        return "id", "value"
    x = next((k for k in X_CANDIDATES if k in columns), columns[0])
    y = next((k for k in Y_CANDIDATES if k in columns), columns[1] if len(columns) > 1 else "value")
    return x, y


def chart_rows(df: DataFrame) -> DataFrame:
    """``(name, value)`` rows of a pie / radial chart: first present id-like and value-like column."""
    cols = df.columns
    ids = [c for c in ID_KEYS if c in cols]
    vals = [c for c in VALUE_KEYS if c in cols]
    idc = F.coalesce(*[F.col(c).cast("string") for c in ids], F.lit("Unknown"))
    valc = F.coalesce(*[F.col(c).cast("double") for c in vals], F.lit(0.0))
    return df.select(idc.alias("name"), valc.alias("value"))


def display_rows(df: DataFrame, widget: str, order: list | None = None) -> DataFrame:
    """The first rows a widget shows: an ordered ``limit``, which
    plans as a bounded TakeOrderedAndProject (or CollectLimit without order)."""
    out = df.orderBy(*order) if order else df
    return out.limit(DISPLAY_CAPS[widget])
