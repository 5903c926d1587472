"""Validation-pipeline queries on the derived upload table.

The oracle SQL re-derives the same raw table, standardises it with the same
placeholder list and whitespace set, and recomputes each statistic from
scratch.  Column types in the downstream SQL are the ones ``infer_schema``
establishes (itself checked against SQL).  The isolation forest is random, so
the exact checks run with it switched off; ``isolation_forest`` and
``pipeline_summary`` cover it with the reference configuration.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..config import NULL_PLACEHOLDERS, load_config
from ..functions.numbers import duckdb_number, parse_number
from ..functions.dates import duckdb_format_index, duckdb_parse, format_index, parse_date
from ..operators import clean as CL
from ..operators import infer as INF
from ..operators import isoforest as ISO
from ..operators import outliers as OUT
from ..operators import profile as PR
from ..operators import score as SC
from ..operators import standardize as ST
from ..operators import validate as VA
from ..sources.upload import RAW_UPLOAD_SQL, UPLOAD_COLUMNS, raw_upload
from .registry import register

# Types established by infer_schema on the upload table (checked by that query).
TYPES = {"order_id": "string", "order_date": "date", "ship_day": "date", "customer": "categorical",
         "status": "categorical", "priority": "categorical", "total": "numeric", "note": "string"}
NUMERIC = [c for c in UPLOAD_COLUMNS if TYPES[c] == "numeric"]
DATES = [c for c in UPLOAD_COLUMNS if TYPES[c] == "date"]
CATEG = [c for c in UPLOAD_COLUMNS if TYPES[c] == "categorical"]
TEXT = [c for c in UPLOAD_COLUMNS if TYPES[c] == "string"]

_PH = ", ".join("'" + p + "'" for p in NULL_PLACEHOLDERS)
_WS = ST.whitespace_sql()


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_rep = ", ".join(f"CASE WHEN trim({c}, {_WS}) IN ({_PH}) THEN NULL ELSE trim({c}, {_WS}) END AS {c}"
                 for c in UPLOAD_COLUMNS)
_allnull = " AND ".join(f"{c} IS NULL" for c in UPLOAD_COLUMNS)
BASE = f"""WITH raw AS ({RAW_UPLOAD_SQL}),
rep AS (SELECT {_rep} FROM raw),
std AS (SELECT * FROM rep WHERE NOT ({_allnull}))"""


_HELD: list = []


def _held(df):
    """Persist a frame that several phases of one query scan."""
    _HELD.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def _release():
    """Drop what earlier queries held; a result of theirs that is still read recomputes it."""
    while _HELD:
        _HELD.pop().unpersist()


def _prep(spark, sf, forest: bool = False):
    """Config and the standardised upload, held while the query's phases scan it
    (the reference pipeline also keeps it in memory between phases)."""
    _release()
    cfg = load_config({"outlier": {"isolation_forest": forest}})
    return cfg, _held(ST.standardize(raw_upload(spark, sf)))


def _schema():
    return [{"column": c, "type": TYPES[c]} for c in UPLOAD_COLUMNS]


# ---------------------------------------------------------------- standardise

@register("standardize", BASE + "\nSELECT * FROM std")
def q_standardize(spark, sf):
    return ST.standardize(raw_upload(spark, sf))


_nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in UPLOAD_COLUMNS)


@register("standardize_log", BASE + f"""
SELECT count(*) AS rows_before, count(*) - count(*) FILTER (WHERE {_allnull}) AS rows_after,
       count(*) FILTER (WHERE {_allnull}) AS empty_rows_removed, CAST({_nulls} AS BIGINT) AS nulls_replaced,
       {len(UPLOAD_COLUMNS)}::BIGINT AS n_columns
FROM rep""")
def q_standardize_log(spark, sf):
    return ST.standardize_log(raw_upload(spark, sf))


@register("coerce_numeric", BASE + "\nSELECT order_id, total, " + duckdb_number("total") + " AS total_num FROM std")
def q_coerce_numeric(spark, sf):
    std = ST.standardize(raw_upload(spark, sf))  # one pass: nothing to hold
    return std.select("order_id", "total", parse_number("total").alias("total_num"))


@register("coerce_date", BASE + f"""
SELECT order_id, order_date, strftime({duckdb_parse('order_date')}, '%Y-%m-%d %H:%M:%S') AS parsed,
       CAST({duckdb_format_index('order_date')} AS BIGINT) AS layout
FROM std""")
def q_coerce_date(spark, sf):
    std = ST.standardize(raw_upload(spark, sf))  # one pass: nothing to hold
    return std.select("order_id", "order_date",
                      F.date_format(parse_date("order_date"), "yyyy-MM-dd HH:mm:ss").alias("parsed"),
                      format_index("order_date").cast("long").alias("layout"))


# ---------------------------------------------------------------- inference

def _infer_sql() -> str:
    cfg = load_config()
    pats = cfg["schema_heuristics"]["patterns"]
    th = cfg["coercion_thresholds"]
    stats = ", ".join(
        f"count({c}) AS nn_{c}, count({duckdb_number(c)}) AS num_{c}, count({duckdb_parse(c)}) AS dt_{c}, "
        f"count(DISTINCT {c}) AS d_{c}" for c in UPLOAD_COLUMNS)
    arms = []
    for i, c in enumerate(UPLOAD_COLUMNS):
        h = INF.heuristic_type(c, pats)
        if h == "date":
            t = f"CASE WHEN nn_{c} = 0 THEN 'string' WHEN dt_{c} / nn_{c} >= 0.4 THEN 'date' ELSE 'string' END"
        elif h == "string":
            t = "'string'"
        else:
            t = (f"CASE WHEN nn_{c} = 0 THEN 'string' WHEN num_{c} / nn_{c} >= {th['numeric']} THEN 'numeric' "
                 f"WHEN dt_{c} / nn_{c} >= {th['date']} THEN 'date' "
                 f"WHEN d_{c} / n <= {th['categorical_unique_ratio']} THEN 'categorical' ELSE 'string' END")
        arms.append(f"SELECT {i}::BIGINT AS pos, '{c}' AS \"column\", {t} AS type FROM s")
    return BASE + f",\ns AS (SELECT count(*) AS n, {stats} FROM std)\n" + "\nUNION ALL ".join(arms)


@register("infer_schema", _infer_sql())
def q_infer_schema(spark, sf):
    cfg, std = _prep(spark, sf)
    return INF.schema_frame(spark, INF.infer_types(std, cfg))


# ---------------------------------------------------------------- validation

def _unpivot_sql(items: list[str]) -> str:
    return " UNION ALL ".join(items)


@register("missing_values", BASE + "\nSELECT * FROM (" + _unpivot_sql(
    [f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS rows_affected FROM std"
     for c in UPLOAD_COLUMNS]) + ") WHERE rows_affected > 0")
def q_missing_values(spark, sf):
    cfg, std = _prep(spark, sf)
    q = VA.column_quality(std, _schema())
    rows = [(c, q[c]["nulls"]) for c in UPLOAD_COLUMNS if q[c]["nulls"] > 0]
    return spark.createDataFrame(rows, "column string, rows_affected long")


def _mixed_sql():
    parts = []
    for c in DATES:
        fi = duckdb_format_index(c)
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS nonnull,
            (SELECT max(cnt) FROM (SELECT count(*) AS cnt FROM std WHERE {fi} IS NOT NULL GROUP BY {fi})) AS dominant
            FROM std""")
    return BASE + f"""
SELECT "column", nonnull, dominant, round(dominant / nonnull, 4) AS dominant_share, nonnull - dominant AS rows_affected
FROM ({' UNION ALL '.join(parts)}) WHERE dominant / nonnull < 0.95"""


@register("mixed_dates", _mixed_sql())
def q_mixed_dates(spark, sf):
    _, std = _prep(spark, sf)
    q = VA.column_quality(std, _schema())
    rows = []
    for c in DATES:
        nn, dom = q[c]["nonnull"], max(q[c]["fmt"].values(), default=0)
        if nn and dom / nn < 0.95:
            rows.append((c, nn, dom, round(dom / nn, 4), nn - dom))
    return spark.createDataFrame(rows, "column string, nonnull long, dominant long, dominant_share double, "
                                       "rows_affected long")


def _num_stats_sql():
    parts = []
    for c in NUMERIC:
        v = duckdb_number(c)
        parts.append(f"""SELECT '{c}' AS "column", count({v}) AS n, quantile_cont({v}, 0.25) AS q1,
            quantile_cont({v}, 0.75) AS q3, avg({v}) AS m, stddev_pop({v}) AS sd FROM std""")
    return BASE + f",\nst AS ({' UNION ALL '.join(parts)})"


@register("iqr_outliers", _num_stats_sql() + "\n" + " UNION ALL ".join(
    f"""SELECT "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(q1 - 1.5 * (q3 - q1), 4) AS lower,
        round(q3 + 1.5 * (q3 - q1), 4) AS upper,
        (SELECT count(*) FROM std WHERE {duckdb_number(c)} < q1 - 1.5 * (q3 - q1)
                                     OR {duckdb_number(c)} > q3 + 1.5 * (q3 - q1)) AS iqr_count
        FROM st WHERE "column" = '{c}' AND n >= 4""" for c in NUMERIC))
def q_iqr_outliers(spark, sf):
    _, std = _prep(spark, sf)
    typed = std.select(*[parse_number(c).alias(c) for c in NUMERIC])
    rows = [(o["column"], round(o["q1"], 4), round(o["q3"], 4), round(o["lower"], 4), round(o["upper"], 4),
             o["iqr_count"]) for o in OUT.outlier_stats(typed, NUMERIC) if o["n"] >= 4]
    return spark.createDataFrame(rows, "column string, q1 double, q3 double, lower double, upper double, "
                                       "iqr_count long")


@register("zscore_outliers", _num_stats_sql() + "\n" + " UNION ALL ".join(
    f"""SELECT "column", round(m, 4) AS mean, round(sd, 4) AS std_pop,
        CASE WHEN sd > 0 THEN (SELECT count(*) FROM std WHERE abs(({duckdb_number(c)} - m) / sd) > 3)
             ELSE 0 END AS z_count
        FROM st WHERE "column" = '{c}' AND n >= 4""" for c in NUMERIC))
def q_zscore_outliers(spark, sf):
    _, std = _prep(spark, sf)
    typed = std.select(*[parse_number(c).alias(c) for c in NUMERIC])
    rows = [(o["column"], round(o["mean"], 4), round(o["std_pop"], 4), o["z_count"])
            for o in OUT.outlier_stats(typed, NUMERIC) if o["n"] >= 4]
    return spark.createDataFrame(rows, "column string, mean double, std_pop double, z_count long")


def _forest_values(c):
    return f"{BASE} SELECT v FROM (SELECT {duckdb_number(c)} AS v FROM std) WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)"


@register("isolation_forest", " UNION ALL ".join(f"""SELECT '{c}' AS "column", n, flagged FROM ({ISO.flagged_sql(_forest_values(c))})""" for c in NUMERIC))
def q_isolation_forest(spark, sf):
    """Per column: values and rows that the forest flags; the SQL grows the same trees."""
    cfg, std = _prep(spark, sf, forest=True)
    typed = std.select(*[parse_number(c).alias(c) for c in NUMERIC])
    oc = cfg["outlier"]
    flagged = ISO.isolation_counts(typed, NUMERIC, oc["contamination"], oc["isolationforest_min_rows"])
    n = typed.agg(*[F.count(c).alias(c) for c in NUMERIC]).first()
    return spark.createDataFrame([(c, n[c], flagged[c]) for c in NUMERIC], "column string, n long, flagged long")


def _coercion_sql():
    parts = []
    for c in NUMERIC + DATES:
        parsed = duckdb_number(c) if c in NUMERIC else duckdb_parse(c)
        parts.append(f"SELECT '{c}' AS \"column\", count({c}) AS nonnull, count({c}) - count({parsed}) AS lost FROM std")
    return BASE + f"""
SELECT "column", nonnull, lost, round(lost / nonnull, 4) AS loss_ratio, lost / nonnull > 0.2 AS flagged
FROM ({' UNION ALL '.join(parts)}) WHERE nonnull > 0"""


@register("coercion_loss", _coercion_sql())
def q_coercion_loss(spark, sf):
    _, std = _prep(spark, sf)
    q = VA.column_quality(std, _schema())
    rows = []
    for c in NUMERIC + DATES:
        nn, lost = q[c]["nonnull"], q[c]["nonnull"] - q[c]["parsed"]
        if nn:
            rows.append((c, nn, lost, round(lost / nn, 4), lost / nn > 0.2))
    return spark.createDataFrame(rows, "column string, nonnull long, lost long, loss_ratio double, flagged boolean")


@register("duplicate_rows", BASE + """
SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM std)) AS duplicates FROM std""")
def q_duplicate_rows(spark, sf):
    _, std = _prep(spark, sf)
    g = std.groupBy(*std.columns).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("duplicates"))


def _issues_sql() -> str:
    """Issue rows in the reference's order (no isolation forest)."""
    arms = []
    pos = 0
    for i, c in enumerate(UPLOAD_COLUMNS):
        arms.append(f"SELECT {i * 10} AS o, '{c}' AS \"column\", 'Missing values' AS issue, "
                    f"count(*) FILTER (WHERE {c} IS NULL) AS rows_affected FROM std")
        if c in DATES:
            fi = duckdb_format_index(c)
            arms.append(f"""SELECT {i * 10 + 1}, '{c}', 'Mixed date formats',
                CASE WHEN (SELECT max(cnt) FROM (SELECT count(*) AS cnt FROM std WHERE {fi} IS NOT NULL GROUP BY {fi}))
                          / count({c}) < 0.95
                     THEN count({c}) - (SELECT max(cnt) FROM (SELECT count(*) AS cnt FROM std WHERE {fi} IS NOT NULL
                                                               GROUP BY {fi})) ELSE 0 END FROM std""")
        if c in NUMERIC:
            arms.append(f"""SELECT {i * 10 + 1}, '{c}', 'Extreme outliers detected',
                CASE WHEN n >= 4 THEN greatest(
                    (SELECT count(*) FROM std WHERE {duckdb_number(c)} < q1 - 1.5 * (q3 - q1)
                                                 OR {duckdb_number(c)} > q3 + 1.5 * (q3 - q1)),
                    CASE WHEN sd > 0 THEN (SELECT count(*) FROM std WHERE abs(({duckdb_number(c)} - m) / sd) > 3)
                         ELSE 0 END) ELSE 0 END FROM st WHERE "column" = '{c}'""")
        if c in NUMERIC or c in DATES:
            parsed = duckdb_number(c) if c in NUMERIC else duckdb_parse(c)
            arms.append(f"""SELECT {i * 10 + 2}, '{c}', 'Type mismatch - high coercion loss',
                CASE WHEN count({c}) > 0 AND (count({c}) - count({parsed})) / count({c}) > 0.2
                     THEN count({c}) - count({parsed}) ELSE 0 END FROM std""")
        pos += 1
    arms.append("SELECT 1000, NULL, 'Duplicate records', "
                "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM std)) FROM std")
    return _num_stats_sql() + ",\nall_issues AS (" + "\nUNION ALL ".join(arms) + """),
issues AS (SELECT row_number() OVER (ORDER BY o) - 1 AS pos, "column", issue, rows_affected
           FROM all_issues WHERE rows_affected > 0)"""


ISSUES_SQL = _issues_sql()


def _issues(spark, sf, forest=False, stats=None):
    cfg, std = _prep(spark, sf, forest)
    return cfg, std, VA.detect_issues(std, _schema(), cfg, use_forest=forest, stats=stats)


@register("validate_issues", ISSUES_SQL + "\nSELECT pos, \"column\", issue, rows_affected FROM issues")
def q_validate_issues(spark, sf):
    _, _, issues = _issues(spark, sf)
    return VA.issues_frame(spark, issues).select("pos", "column", "issue", "rows_affected")


def _fix_sql() -> str:
    med = {c: f"(SELECT quantile_cont({duckdb_number(c)}, 0.5) FROM std)" for c in NUMERIC}
    mode = {c: f"(SELECT {c} FROM std WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
            for c in CATEG}
    arms = []
    for c in UPLOAD_COLUMNS:
        t = TYPES[c]
        if t == "numeric":
            arms.append(f"WHEN issue = 'Missing values' AND \"column\" = '{c}' THEN struct_pack("
                        f"f := 'Filled missing values using median (' || printf('%.2f', {med[c]}) || ')', "
                        f"w := 'Median preserves distribution and avoids outlier bias', "
                        f"i := 'Minor numerical approximation')")
        elif t == "categorical":
            arms.append(f"WHEN issue = 'Missing values' AND \"column\" = '{c}' THEN struct_pack("
                        f"f := 'Filled missing values using mode (\"' || {mode[c]} || '\")', "
                        f"w := 'Mode is the most frequent value in the category', "
                        f"i := 'Mode value used for ' || CAST(rows_affected AS VARCHAR) || ' rows')")
        elif t == "date":
            arms.append(f"WHEN issue = 'Missing values' AND \"column\" = '{c}' THEN struct_pack("
                        f"f := 'Missing dates kept as NaT (Not a Time)', "
                        f"w := 'Date imputation could introduce misleading temporal data', "
                        f"i := 'No data loss, missing dates remain null')")
        else:
            arms.append(f"WHEN issue = 'Missing values' AND \"column\" = '{c}' THEN struct_pack("
                        f"f := 'Filled missing values with empty string', "
                        f"w := 'Empty string is appropriate for text data', "
                        f"i := 'Missing text values set to empty')")
    arms += [
        "WHEN issue = 'Mixed date formats' THEN struct_pack(f := 'Converted all values to YYYY-MM-DD format', "
        "w := 'Consistent date formats are required for time-based analysis', i := 'No data loss')",
        "WHEN issue = 'Duplicate records' THEN struct_pack(f := 'Removed duplicate rows, keeping first occurrence', "
        "w := 'Duplicates would inflate metrics and analysis results', "
        "i := CAST(rows_affected AS VARCHAR) || ' rows removed')",
        "WHEN issue = 'Extreme outliers detected' THEN struct_pack(f := 'Outliers flagged but not removed', "
        "w := 'Outliers may represent valid extreme values', i := 'No data removed')",
        "WHEN issue = 'Type mismatch - high coercion loss' THEN struct_pack("
        "f := 'Column kept as string type due to high coercion loss', w := 'Preserves all data without loss', "
        "i := 'Column treated as text instead of numeric/date')",
    ]
    return ISSUES_SQL + ",\nfixed AS (SELECT *, CASE " + " ".join(arms) + " END AS fx FROM issues)"


FIXED_SQL = _fix_sql()


@register("issue_actions", FIXED_SQL + """
SELECT pos, "column", issue, rows_affected, fx.f AS fix_applied, fx.w AS why, fx.i AS impact FROM fixed""")
def q_issue_actions(spark, sf):
    cfg, std, issues = _issues(spark, sf)
    _, fixed, _ = CL.clean(std, issues, _schema(), "lenient", cfg)
    return VA.issues_frame(spark, fixed)


def _clean_sql(distinct: bool = True) -> str:
    sel = []
    for c in UPLOAD_COLUMNS:
        t = TYPES[c]
        if t == "numeric":
            sel.append(f"coalesce({duckdb_number(c)}, (SELECT quantile_cont({duckdb_number(c)}, 0.5) "
                       f"FROM std)) AS {c}")
        elif t == "date":
            sel.append(f"strftime({duckdb_parse(c)}, '%Y-%m-%d %H:%M:%S') AS {c}")
        elif t == "categorical":
            sel.append(f"coalesce({c}, (SELECT {c} FROM std WHERE {c} IS NOT NULL GROUP BY {c} "
                       f"ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}")
        else:
            sel.append(f"coalesce({c}, '') AS {c}")
    return BASE + f",\ncleaned AS (SELECT {'DISTINCT' if distinct else ''} {', '.join(sel)} FROM std)"


def _cleaned(spark, sf, mode="lenient"):
    stats = {}
    cfg, std, issues = _issues(spark, sf, stats=stats)
    cleaned, fixed, actions = CL.clean(std, issues, _schema(), mode, cfg, stats)
    # several phases scan the cleaned table (as in the pipeline): keep it once
    return cfg, std, _held(cleaned), fixed, actions


def _present(df):
    out = []
    for c in df.columns:
        t = TYPES[c]
        if t == "date":
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


@register("clean", _clean_sql() + "\nSELECT * FROM cleaned")
def q_clean(spark, sf):
    _, _, cleaned, _, _ = _cleaned(spark, sf)
    return _present(cleaned)


@register("impute_numeric", BASE + "\n" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(quantile_cont({duckdb_number(c)}, 0.5), 4) AS fill_value,
        count(*) - count({duckdb_number(c)}) AS filled FROM std""" for c in NUMERIC))
def q_impute_numeric(spark, sf):
    _, std = _prep(spark, sf)
    typed = std.select(*[parse_number(c).alias(c) for c in NUMERIC])
    rows = []
    for c in NUMERIC:
        med = CL.median_of(typed, c)
        filled = typed.filter(F.col(c).isNull()).count()
        rows.append((c, round(med, 4), filled))
    return spark.createDataFrame(rows, "column string, fill_value double, filled long")


@register("impute_mode", BASE + "\nSELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (SELECT {c} FROM std WHERE {c} IS NOT NULL GROUP BY {c}
        ORDER BY count(*) DESC, {c} LIMIT 1) AS fill_value, count(*) FILTER (WHERE {c} IS NULL) AS filled FROM std"""
    for c in CATEG) + ") WHERE filled > 0")
def q_impute_mode(spark, sf):
    _, std = _prep(spark, sf)
    nulls = std.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in CATEG]).collect()[0]
    rows = [(c, CL.mode_of(std, c), nulls[c]) for c in CATEG if nulls[c] > 0]
    return spark.createDataFrame(rows, "column string, fill_value string, filled long")


@register("impute_text", BASE + "\nSELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS filled,
        count(*) FILTER (WHERE coalesce({c}, '') = '') AS empty_after FROM std""" for c in TEXT) + ") WHERE filled > 0")
def q_impute_text(spark, sf):
    _, std = _prep(spark, sf)
    aggs = []
    for c in TEXT:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"n_{c}"),
                 F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias(f"e_{c}")]
    r = std.agg(*aggs).collect()[0]
    rows = [(c, r[f"n_{c}"], r[f"e_{c}"]) for c in TEXT if r[f"n_{c}"] > 0]
    return spark.createDataFrame(rows, "column string, filled long, empty_after long")


@register("standardize_dates", BASE + f"""
SELECT order_id, strftime({duckdb_parse('order_date')}, '%Y-%m-%d') AS order_date FROM std""")
def q_standardize_dates(spark, sf):
    _, std = _prep(spark, sf)
    return std.select("order_id", F.date_format(parse_date("order_date"), "yyyy-MM-dd").alias("order_date"))


@register("dedupe_lenient", _clean_sql() + """
SELECT (SELECT count(*) FROM std) AS rows_before, (SELECT count(*) FROM cleaned) AS rows_after,
       (SELECT count(*) FROM std) - (SELECT count(*) FROM cleaned) AS removed""")
def q_dedupe_lenient(spark, sf):
    _, std, cleaned, _, _ = _cleaned(spark, sf)
    a = std.agg(F.count(F.lit(1)).alias("rows_before"))
    b = cleaned.agg(F.count(F.lit(1)).alias("rows_after"))
    return a.crossJoin(b).select("rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("removed"))


@register("dedupe_strict", BASE + """
SELECT count(*) AS rows_before, count(*) AS rows_after,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM std)) AS flagged FROM std""")
def q_dedupe_strict(spark, sf):
    cfg, std, issues = _issues(spark, sf)
    cleaned, fixed, _ = CL.clean(std, issues, _schema(), "strict", cfg)
    flagged = sum(d["rows_affected"] for d in fixed if d["issue"] == VA.DUPLICATES)
    return (std.agg(F.count(F.lit(1)).alias("rows_before"))
               .crossJoin(cleaned.agg(F.count(F.lit(1)).alias("rows_after")))
               .withColumn("flagged", F.lit(flagged).cast("long")))


# ---------------------------------------------------------------- profiles

@register("numeric_profile", _clean_sql() + "\n" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(min({duckdb_number(c)}), 4) AS min, round(max({c}), 4) AS max,
        round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std,
        round(avg(power(({c} - (SELECT avg({c}) FROM cleaned)) / (SELECT stddev_pop({c}) FROM cleaned), 3)), 4)
          AS skewness FROM cleaned""" for c in NUMERIC))
def q_numeric_profile(spark, sf):
    cfg, _, cleaned, _, _ = _cleaned(spark, sf)
    cleaned = cleaned.select(*NUMERIC)
    rows = [(p["column"], round(p["min"], 4), round(p["max"], 4), round(p["mean"], 4), round(p["median"], 4),
             None if p["std"] is None else round(p["std"], 4),
             None if p["skewness"] is None else round(p["skewness"], 4))
            for p in PR.numeric_profiles(cleaned, NUMERIC, cfg)]
    return spark.createDataFrame(rows, "column string, min double, max double, mean double, median double, "
                                       "std double, skewness double")


def _topk_sql():
    parts = []
    for c in NUMERIC:
        parts.append(f"""SELECT '{c}' AS "column", k, thr AS threshold, top_sum, tot FROM (
            SELECT CAST(greatest(1, floor(count(*) * 10 / 100)) AS BIGINT) AS k, sum({c}) AS tot,
                   (SELECT sum(x) FROM (SELECT {c} AS x, row_number() OVER (ORDER BY {c} DESC) AS r FROM cleaned
                                       WHERE {c} IS NOT NULL) WHERE r <= greatest(1, floor((SELECT count({c}) FROM cleaned) * 10 / 100)))
                     AS top_sum,
                   (SELECT x FROM (SELECT {c} AS x, row_number() OVER (ORDER BY {c} DESC) AS r FROM cleaned
                                  WHERE {c} IS NOT NULL) WHERE r = greatest(1, floor((SELECT count({c}) FROM cleaned) * 10 / 100)))
                     AS thr
            FROM cleaned WHERE {c} IS NOT NULL)""")
    return _clean_sql() + ",\ntk AS (" + " UNION ALL ".join(parts) + ")"


@register("topk_share", _topk_sql() + """
SELECT "column", k, round(threshold, 4) AS threshold, round(top_sum, 2) AS top_sum,
       CASE WHEN tot > 0 THEN round(top_sum / tot * 100, 4) END AS share_pct FROM tk""")
def q_topk_share(spark, sf):
    cfg, _, cleaned, _, _ = _cleaned(spark, sf)
    rows = [(p["column"], p["topk"], round(p["topk_threshold"], 4), round(p["topk_sum"], 2),
             None if p["topk_share"] is None else round(p["topk_share"], 4)) for p in PR.numeric_profiles(cleaned.select(*NUMERIC), NUMERIC, cfg)]
    return spark.createDataFrame(rows, "column string, k long, threshold double, top_sum double, share_pct double")


def _numeric_notes_sql():
    arms = []
    for c in NUMERIC:
        title = c.replace("_", " ").title()
        arms.append(f"""SELECT '{c}' AS "column", concat_ws('; ',
            CASE WHEN sk > 0.5 THEN '{title} is right-skewed' WHEN sk < -0.5 THEN '{title} is left-skewed' END,
            CASE WHEN tot > 0 AND top_sum / tot * 100 > 50 THEN 'top 10% contribute ~' || printf('%.0f', top_sum / tot * 100)
                 || '% of total' END,
            CASE WHEN abs(med - mean) / (abs(mean) + 1e-10) > 0.2 THEN
                 CASE WHEN med < mean THEN 'distribution has high-value outliers' ELSE 'distribution has low-value outliers' END END
        ) AS n1, 'Values range from ' || printf('%.2f', mn) || ' to ' || printf('%.2f', mx) AS dflt
        FROM (SELECT avg(power(({c} - (SELECT avg({c}) FROM cleaned)) / (SELECT stddev_pop({c}) FROM cleaned), 3)) AS sk,
                     quantile_cont({c}, 0.5) AS med, avg({c}) AS mean, min({c}) AS mn, max({c}) AS mx FROM cleaned),
             (SELECT top_sum, tot FROM tk WHERE "column" = '{c}')""")
    return _topk_sql() + ",\nnt AS (" + " UNION ALL ".join(arms) + ")"


@register("numeric_notes", _numeric_notes_sql() + """
SELECT "column", CASE WHEN n1 = '' THEN dflt ELSE n1 END AS notes FROM nt""")
def q_numeric_notes(spark, sf):
    cfg, _, cleaned, _, _ = _cleaned(spark, sf)
    cleaned = cleaned.select(*NUMERIC)
    rows = [(p["column"], p["notes"]) for p in PR.numeric_profiles(cleaned, NUMERIC, cfg)]
    return spark.createDataFrame(rows, "column string, notes string")


def _cat_sql():
    parts = [f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM cleaned
                 WHERE {c} IS NOT NULL GROUP BY {c}""" for c in CATEG]
    return _clean_sql() + f""",
vc AS ({' UNION ALL '.join(parts)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank,
                  count(*) OVER (PARTITION BY "column") AS unique_count,
                  sum(count) OVER (PARTITION BY "column") AS total FROM vc)"""


@register("categorical_profile", _cat_sql() + """
SELECT "column", rank, value, count, unique_count FROM ranked WHERE rank <= 10""")
def q_categorical_profile(spark, sf):
    cfg, _, cleaned, _, _ = _cleaned(spark, sf)
    rows = []
    for p in PR.categorical_profiles(cleaned, CATEG, cfg):
        for r, (v, n) in enumerate(p["top_values"], start=1):
            rows.append((p["column"], r, v, n, p["unique_count"]))
    return spark.createDataFrame(rows, "column string, rank long, value string, count long, unique_count long")


@register("categorical_notes", _cat_sql() + """,
agg AS (SELECT "column", max(unique_count) AS d, max(total) AS total,
               max(count) FILTER (WHERE rank = 1) AS c1, max(value) FILTER (WHERE rank = 1) AS v1,
               max(count) FILTER (WHERE rank = 2) AS c2, max(value) FILTER (WHERE rank = 2) AS v2
        FROM ranked GROUP BY "column"),
nt AS (SELECT "column", d, concat_ws('; ',
          CASE WHEN c1 / total * 100 > 50 THEN 'Majority (' || printf('%.0f', c1 / total * 100) || '%) are ''' || v1 || ''''
               WHEN d >= 2 AND (c1 + c2) / total * 100 > 70 THEN 'Majority come from ''' || v1 || ''' and ''' || v2 || '''' END,
          CASE WHEN d / total > 0.8 THEN 'High diversity in values'
               WHEN d / total < 0.1 THEN 'Limited to ' || CAST(d AS VARCHAR) || ' distinct values' END) AS n1
       FROM agg)
SELECT "column", d AS unique_count, CASE WHEN n1 = '' THEN CAST(d AS VARCHAR) || ' unique values' ELSE n1 END AS notes
FROM nt""")
def q_categorical_notes(spark, sf):
    cfg, _, cleaned, _, _ = _cleaned(spark, sf)
    rows = [(p["column"], p["unique_count"], p["notes"]) for p in PR.categorical_profiles(cleaned, CATEG, cfg)]
    return spark.createDataFrame(rows, "column string, unique_count long, notes string")


@register("date_profile", _clean_sql() + """,
d AS (SELECT epoch_us(CAST(order_date AS TIMESTAMP)) AS t FROM cleaned WHERE order_date IS NOT NULL),
g AS (SELECT t - lag(t) OVER (ORDER BY t) AS gap FROM d),
s AS (SELECT min(t) AS lo, max(t) AS hi FROM d),
m AS (SELECT CAST(floor(quantile_cont(gap, 0.5) / 86400000000) AS BIGINT) AS md FROM g WHERE gap IS NOT NULL),
p AS (SELECT strftime(make_timestamp(lo), '%Y-%m-%d') AS min_date, strftime(make_timestamp(hi), '%Y-%m-%d') AS max_date,
             CAST(floor((hi - lo) / 86400000000) AS BIGINT) AS date_range_days, md AS median_gap_days,
             CASE WHEN md IS NULL THEN NULL WHEN md <= 1 THEN 'daily' WHEN md <= 7 THEN 'weekly' WHEN md <= 31 THEN 'monthly'
                  WHEN md <= 92 THEN 'quarterly' ELSE 'yearly' END AS estimated_frequency FROM s, m)
SELECT *, 'order_date' AS "column", concat_ws('; ',
       CASE WHEN date_range_days < 7 THEN 'Covers less than a week' WHEN date_range_days < 31 THEN 'Covers approximately one month'
            WHEN date_range_days < 365 THEN 'Covers ' || CAST(date_range_days // 30 AS VARCHAR) || ' months'
            ELSE 'Covers ' || CAST(date_range_days // 365 AS VARCHAR) || ' years' END,
       CASE WHEN estimated_frequency IS NOT NULL THEN 'appears to be ' || estimated_frequency || ' data' END) AS notes
FROM p""")
def q_date_profile(spark, sf):
    _, _, cleaned, _, _ = _cleaned(spark, sf)
    return PR.date_profile(cleaned, "order_date")


# ---------------------------------------------------------------- score

_SCORE_SQL = FIXED_SQL + """,
shape AS (SELECT CAST(count(*) AS DOUBLE) AS r, 8.0 AS c FROM (SELECT DISTINCT * FROM std_clean)),
comp AS (SELECT
   coalesce(sum(rows_affected) FILTER (WHERE issue = 'Missing values'), 0) AS missing,
   coalesce(arg_min(rows_affected, pos) FILTER (WHERE issue = 'Duplicate records'), 0) AS dups,
   coalesce(sum(rows_affected) FILTER (WHERE issue IN ('Mixed date formats', 'Type mismatch - high coercion loss')), 0) AS consist,
   coalesce(sum(rows_affected) FILTER (WHERE issue = 'Extreme outliers detected'), 0) AS outl FROM issues),
sc AS (SELECT greatest(0.0, 1 - missing / (r * c)) AS completeness, greatest(0.0, 1 - dups / r) AS uniqueness,
              greatest(0.0, 1 - consist / (r * c)) AS consistency, 1.0::DOUBLE AS validity,
              least(1.0, outl / r) AS outlier_penalty FROM comp, shape),
hs AS (SELECT *, round(greatest(0.0, least(1.0, completeness * 0.35 + uniqueness * 0.2 + consistency * 0.2
                  + validity * 0.15 - outlier_penalty * 0.1)), 2) AS health_score FROM sc)"""


def _score_sql():
    clean_cte = _clean_sql(distinct=False).replace("cleaned AS (", "std_clean AS (", 1)
    # reuse the issue CTEs: splice the cleaned-table CTE in front of the score CTEs
    return _SCORE_SQL.replace(BASE, clean_cte, 1)


@register("health_score", _score_sql() + """
SELECT round(completeness, 4) AS completeness, round(uniqueness, 4) AS uniqueness, round(consistency, 4) AS consistency,
       round(validity, 4) AS validity, round(outlier_penalty, 4) AS outlier_penalty, health_score FROM hs""")
def q_health_score(spark, sf):
    cfg, _, cleaned, fixed, _ = _cleaned(spark, sf)
    shape = cleaned.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(cleaned.columns)))
    return SC.health_score(VA.issues_frame(spark, fixed), shape, cfg["health_weights"])


@register("health_message", _score_sql() + """
SELECT health_score,
       CASE WHEN health_score >= 0.9 THEN 'Excellent data quality. Your data is ready for analysis.'
            WHEN health_score >= 0.75 THEN 'Good data quality with minor issues that were safely resolved. Your data is ready for analysis.'
            WHEN health_score >= 0.6 THEN 'Minor data quality issues were found and safely resolved. Your data is ready for analysis.'
            WHEN health_score >= 0.4 THEN 'Moderate data quality issues detected. Some issues were resolved, but manual review is recommended.'
            ELSE 'Significant data quality issues detected. Manual review and correction strongly recommended before analysis.' END
         AS message,
       health_score >= 0.6 AS analytics_ready FROM hs""")
def q_health_message(spark, sf):
    cfg, _, cleaned, fixed, _ = _cleaned(spark, sf)
    shape = cleaned.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(cleaned.columns)))
    return SC.with_message(SC.health_score(VA.issues_frame(spark, fixed), shape, cfg["health_weights"]),
                           "READY", cfg["manual_review"]["health_threshold"])


