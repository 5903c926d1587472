"""Cleaning: explained, repeatable fixes in issue order.

All column fixes are one projection; fill values are scalars found by
distributed jobs (exact median by selection, mode by a grouped top-1), never
by pulling a column to the driver.  Duplicates are dropped after imputation
(lenient mode), as in the reference, so the removed count can exceed the
count measured before imputation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.selection import quantiles
from .infer import _num
from .validate import COERCION, DUPLICATES, MISSING, MIXED, OUTLIERS

# Fixed values that must equal the reference: (fix_applied, why, impact) per fix.
# "{fill}" and "{rows}" are filled in at run time.
FIX_TEXTS = {
    "median": ("Filled missing values using median ({fill})", "Median preserves distribution and avoids outlier bias",
               "Minor numerical approximation"),
    "mean": ("Filled missing values using mean ({fill})", "Mean provides average value for missing data",
             "Minor numerical approximation"),
    "zero": ("Filled missing values with 0", "Zero is a safe default for numeric data", "Missing values set to zero"),
    "mode": ('Filled missing values using mode ("{fill}")', "Mode is the most frequent value in the category",
             "Mode value used for {rows} rows"),
    "unknown_no_mode": ('Filled missing values with "Unknown"', "No mode available, using placeholder",
                        "Missing values marked as Unknown"),
    "unknown": ('Filled missing values with "Unknown"', "Explicit placeholder for missing categorical data",
                "Missing values marked as Unknown"),
    "keep_nat": ("Missing dates kept as NaT (Not a Time)", "Date imputation could introduce misleading temporal data",
                 "No data loss, missing dates remain null"),
    "empty_string": ("Filled missing values with empty string", "Empty string is appropriate for text data",
                     "Missing text values set to empty"),
    "dates": ("Converted all values to YYYY-MM-DD format",
              "Consistent date formats are required for time-based analysis", "No data loss"),
    "flag_only": ("Duplicates flagged for manual review", "Strict mode requires manual review of duplicates",
                  "No rows removed"),
    "remove_keep_first": ("Removed duplicate rows, keeping first occurrence",
                          "Duplicates would inflate metrics and analysis results", "{rows} rows removed"),
    "outliers": ("Outliers flagged but not removed", "Outliers may represent valid extreme values", "No data removed"),
    "coercion_lenient": ("Column kept as string type due to high coercion loss", "Preserves all data without loss",
                         "Column treated as text instead of numeric/date"),
    "coercion_strict": (None, "Manual review required in strict mode", "No automatic fix applied"),
}


def _texts(key: str, fill=None, rows=None) -> dict:
    f, w, i = FIX_TEXTS[key]
    fmt = (lambda t: None if t is None else t.format(fill=fill, rows=rows))
    return {"fix_applied": fmt(f), "why": fmt(w), "impact": fmt(i)}


def median_of(df: DataFrame, column: str) -> float | None:
    v = df.select(F.lit(0).alias("gid"), F.col(column).cast("double").alias("v")).filter(
        F.col("v").isNotNull() & ~F.isnan("v"))
    n = v.count()
    if n == 0:
        return None
    return quantiles(v, "gid", "v", {0: n}, [0.5])[(0, 0.5)]


def modes_of(df: DataFrame, columns: list[str]) -> dict:
    """Mode of every column in one job: (column, value) counts, then per column
    the value with the highest count, smallest on ties (``min_by`` on
    ``(-count, value)``: an aggregate, no window)."""
    if not columns:
        return {}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("string").alias("v"))
                                for i, c in enumerate(columns)])).alias("x")
    rows = (df.select(cells).select("x.k", "x.v").filter(F.col("v").isNotNull())
              .groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
              .groupBy("k").agg(F.min_by("v", F.struct((-F.col("c")).alias("nc"), F.col("v").alias("vv"))).alias("m"))
              .collect())
    got = {r["k"]: r["m"] for r in rows}
    return {c: got.get(i) for i, c in enumerate(columns)}


def mode_of(df: DataFrame, column: str):
    """Most frequent non-null value, smallest among ties (pandas ``mode()[0]``)."""
    r = (df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("c"))
           .orderBy(F.col("c").desc(), F.col(column)).limit(1).collect())
    return r[0][column] if r else None


def clean(df: DataFrame, issues: list[dict], schema: list[dict], mode: str, config: dict,
          stats: dict | None = None):
    """Returns (cleaned frame, issues with fix_applied / why / impact filled, action log).

    ``stats`` may carry medians already found by issue detection.
    """
    stats = stats or {}
    types = {s["column"]: s["type"] for s in schema}
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    strategy = config["imputation"]
    by_col: dict[str, set] = {}
    for d in issues:
        by_col.setdefault(d["column"], set()).add(d["issue"])
    exprs, out_issues, actions = {}, [], []
    # Typed base projection: numeric columns are always coerced (one Spark type per column).
    for c in df.columns:
        t = types.get(c, "string")
        if t == "numeric":
            exprs[c] = _num(c, dtypes[c])
        elif t == "date" and not (COERCION in by_col.get(c, set()) and MIXED not in by_col.get(c, set())
                                  and mode == "lenient"):
            exprs[c] = parse_date(c, dtypes[c])
        else:
            exprs[c] = F.col(c)
    typed = df.select(*[exprs[c].alias(c) for c in df.columns])
    need_mode = [d["column"] for d in issues if d["issue"] == MISSING and types.get(d["column"]) == "categorical"]
    modes = modes_of(df, need_mode) if strategy["categorical"] == "mode" else {}
    drop_dups = False
    for d in issues:
        d = dict(d)
        c, kind = d["column"], d["issue"]
        if kind == MISSING:
            t = types.get(c, "string")
            act = {"column": c, "action": "impute_missing", "rows_affected": d["rows_affected"]}
            if t == "numeric":
                how = strategy["numeric"]
                if how in ("median", "mean"):
                    if how == "median":
                        fill = stats.get(c, {}).get("median") if "median" in stats.get(c, {}) else median_of(typed, c)
                    else:
                        fill = typed.agg(F.avg(c)).collect()[0][0]
                    exprs[c] = F.coalesce(exprs[c], F.lit(fill).cast("double"))
                    d.update(_texts(how, fill=f"{fill:.2f}" if fill is not None else "nan"))
                    act.update(method=how, fill_value=None if fill is None else str(float(fill)))
                else:
                    exprs[c] = F.coalesce(exprs[c], F.lit(0.0))
                    d.update(_texts("zero"))
                    act.update(method="zero", fill_value="0")
            elif t == "categorical":
                fill = modes.get(c) if strategy["categorical"] == "mode" else None
                if fill is not None:
                    exprs[c] = F.coalesce(exprs[c], F.lit(fill).cast(dtypes[c]))
                    d.update(_texts("mode", fill=fill, rows=d["rows_affected"]))
                    act.update(method="mode", fill_value=str(fill))
                else:
                    exprs[c] = F.coalesce(exprs[c].cast("string"), F.lit("Unknown"))
                    d.update(_texts("unknown_no_mode" if strategy["categorical"] == "mode" else "unknown"))
                    act.update(method="unknown", fill_value="Unknown")
            elif t == "date":
                d.update(_texts("keep_nat"))
                act.update(method="keep_nat", fill_value=None)
            else:
                exprs[c] = F.coalesce(exprs[c].cast("string"), F.lit(""))
                d.update(_texts("empty_string"))
                act.update(method="empty_string", fill_value="")
            actions.append(act)
        elif kind == MIXED:
            # exprs[c] already parses the column (date columns are always typed).
            d.update(_texts("dates"))
            actions.append({"column": c, "action": "standardize_dates", "rows_affected": d["rows_affected"],
                            "method": "to_datetime", "fill_value": None})
        elif kind == DUPLICATES:
            act = {"column": None, "action": "handle_duplicates", "rows_affected": d["rows_affected"]}
            if mode == "strict":
                d.update(_texts("flag_only"))
                act.update(method="flag_only", fill_value=None)
            else:
                drop_dups = True
                d.update(_texts("remove_keep_first", rows=d["rows_affected"]))
                act.update(method="remove_keep_first", fill_value=None)
            actions.append(act)
        elif kind == OUTLIERS:
            d.update(_texts("outliers"))
        elif kind == COERCION:
            d.update(_texts("coercion_lenient" if mode == "lenient" else "coercion_strict"))
        out_issues.append(d)
    cleaned = df.select(*[exprs[c].alias(c) for c in df.columns])
    if drop_dups:
        cleaned = cleaned.dropDuplicates()
    return cleaned, out_issues, actions
