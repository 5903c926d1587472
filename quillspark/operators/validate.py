"""Issue detection.

Per column, in column order: missing values; then mixed date formats (date
columns) or extreme outliers (numeric columns); then high coercion loss.
The dataset-level duplicate check comes last.  Every per-column count comes
from one aggregate over all columns; outliers add the quantile passes and
one more aggregate; duplicates are counted by row hash first, whole rows only
where a hash repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import format_index
from .infer import _num
from .isoforest import isolation_counts
from .outliers import moment_aggs, outlier_stats

# Fixed values that must equal the reference: issue names.
MISSING = "Missing values"
MIXED = "Mixed date formats"
OUTLIERS = "Extreme outliers detected"
COERCION = "Type mismatch - high coercion loss"
DUPLICATES = "Duplicate records"


def column_quality(df: DataFrame, schema: list[dict], with_moments: bool = False) -> dict:
    """{column: {n, nulls, nonnull, parsed, fmt: {layout: count}}} in one aggregate, and one more for the date layouts.

    With ``with_moments`` the numeric columns' count / mean / population std
    (for the outlier checks) come from the same aggregate, under ``__moments``.
    """
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    # Parse each cell once in a projection; the aggregate only counts.
    proj = [F.col(s["column"]).isNull().alias(f"isnull{i}") for i, s in enumerate(schema)]
    for i, s in enumerate(schema):
        c, t = s["column"], s["type"]
        if t == "numeric":
            proj.append(_num(c, dtypes[c]).alias(f"num{i}"))
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, s in enumerate(schema):
        t = s["type"]
        aggs += [F.count_if(F.col(f"isnull{i}")).alias(f"null{i}")]
        if t == "numeric":
            aggs += [F.count(F.col(f"num{i}")).alias(f"ok{i}")]
    numeric = [i for i, s in enumerate(schema) if s["type"] == "numeric"]
    if with_moments:
        aggs += moment_aggs([f"num{i}" for i in numeric], prefix="mom_")
    r = df.select(*proj).agg(*aggs).collect()[0].asDict()
    layouts = layout_counts(df, [s["column"] for s in schema if s["type"] == "date"])
    out = {}
    for i, s in enumerate(schema):
        rec = {"n": r["__n"], "nulls": r[f"null{i}"], "nonnull": r["__n"] - r[f"null{i}"],
               "parsed": r.get(f"ok{i}")}
        if s["type"] == "date":
            rec["fmt"] = layouts[s["column"]]
            rec["parsed"] = sum(rec["fmt"].values())
        out[s["column"]] = rec
    if with_moments:
        out["__moments"] = {k[len("mom_"):]: v for k, v in r.items() if k.startswith("mom_")}
    return out


def layout_counts(df: DataFrame, columns: list[str]) -> dict[str, dict[int, int]]:
    """{column: {layout: rows}} of date columns: one grouped aggregate, at most one row per column and layout."""
    out: dict[str, dict[int, int]] = {c: {} for c in columns}
    if columns:
        dtypes = {f.name: f.dataType for f in df.schema.fields}
        cells = F.array(*[F.struct(F.lit(i).alias("k"), format_index(c, dtypes[c]).alias("layout")) for i, c in enumerate(columns)])
        counts = df.select(F.explode(cells).alias("cell")).select("cell.*").filter(F.col("layout").isNotNull()).groupBy("k", "layout").count()
        for r in counts.collect():
            out[columns[r["k"]]][r["layout"]] = r["count"]
    return out


def duplicate_count(df: DataFrame) -> int:
    """Rows minus first occurrences; NULLs compare equal.

    Rows are counted by a 128-bit hash first, so only rows whose hash repeats are shuffled whole.
    """
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns])  # a hash passes over nulls
    hashes = [F.xxhash64(F.lit(k), nulls, *df.columns).alias(f"__h{k}") for k in (0, 1)]
    repeated = df.select(*hashes).groupBy("__h0", "__h1").agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1").select("__h0", "__h1")
    whole = df.select("*", *hashes).join(repeated, ["__h0", "__h1"], "left_semi").drop("__h0", "__h1")
    r = (whole.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("c"))
              .agg(F.sum(F.col("c") - 1).alias("d")).collect()[0]["d"])
    return int(r or 0)


def _issue(col, name, rows, **extra):
    d = {"column": col, "issue": name, "rows_affected": int(rows), "fix_applied": None, "why": None,
         "impact": None}
    d.update(extra)
    return d


def detect_issues(df: DataFrame, schema: list[dict], config: dict, use_forest: bool | None = None,
                  stats: dict | None = None) -> list[dict]:
    """The reference's issue list (plain dicts, a handful of rows).

    ``stats`` (optional dict) receives per-numeric-column statistics found on
    the way (``median``), which the cleaning phase reuses.
    """
    oc = config["outlier"]
    if use_forest is None:
        use_forest = oc.get("isolation_forest", True)
    q = column_quality(df, schema, with_moments=True)
    numeric = [s["column"] for s in schema if s["type"] == "numeric"]
    typed = df.select(*[_num(c, dict((f.name, f.dataType) for f in df.schema.fields)[c]).alias(c) for c in numeric])
    exact = config["analysis"].get("exact_quantiles", True)
    ost = {o["column"]: o for o in outlier_stats(typed, numeric, oc["iqr_multiplier"], oc["zscore_threshold"],
                                                 moments=q["__moments"], exact=exact)}
    if stats is not None:
        for c, o in ost.items():
            if o.get("median") is not None:
                stats.setdefault(c, {})["median"] = o["median"]
    iso = isolation_counts(typed, [c for c in numeric if ost[c]["n"] >= oc["isolationforest_min_rows"]],
                           oc["contamination"], oc["isolationforest_min_rows"]) if use_forest else {}
    limit = config["manual_review"]["coercion_loss_threshold"]
    issues = []
    for s in schema:
        c, t, r = s["column"], s["type"], q[s["column"]]
        if r["nulls"] > 0:
            issues.append(_issue(c, MISSING, r["nulls"]))
        if t == "date" and r["nonnull"] > 0:
            dominant = max(r["fmt"].values(), default=0)
            if dominant / r["nonnull"] < 0.95:
                issues.append(_issue(c, MIXED, r["nonnull"] - dominant))
        elif t == "numeric":
            o = ost[c]
            if o["n"] >= 4:
                cnt = max(o["iqr_count"], o["z_count"], iso.get(c, 0))
                if cnt > 0:
                    issues.append(_issue(c, OUTLIERS, cnt, iqr_count=o["iqr_count"], z_count=o["z_count"],
                                         forest_count=iso.get(c)))
        if t in ("numeric", "date") and r["nonnull"] > 0:
            lost = r["nonnull"] - r["parsed"]
            if lost / r["nonnull"] > limit:
                issues.append(_issue(c, COERCION, lost))
    dup = duplicate_count(df)
    if dup > 0:
        issues.append(_issue(None, DUPLICATES, dup))
    return issues


def issues_frame(spark, issues: list[dict]) -> DataFrame:
    rows = [(i, d["column"], d["issue"], d["rows_affected"], d["fix_applied"], d["why"], d["impact"])
            for i, d in enumerate(issues)]
    return spark.createDataFrame(rows, "pos long, column string, issue string, rows_affected long, "
                                       "fix_applied string, why string, impact string")
