"""Source / sink and pipeline queries.

File-based queries first write Spark-derived data (the upload table built
from ``orders``) to the shared scratch folder, then read it back through the
source under test, so their work grows with the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import load_config
from ..sources import files as FI
from ..sources import sinks as SK
from ..sources.csv import NA_TOKENS, ingest_metadata, read_csv
from ..sources.tables import sales_view, table
from ..sources.upload import RAW_UPLOAD_SQL, UPLOAD_COLUMNS, raw_upload
from ..session import scratch_path, written
from . import pipeline as PL
from . import q_insights as _q_insights  # noqa: F401  (their SQL is part of the insight check)
from . import q_rollups as _q_rollups  # noqa: F401
from .q_quality import DATES as _DATES
from .q_quality import FIXED_SQL, _clean_sql, _cleaned
from .registry import ORACLE, register


_UPLOAD_NAME = "orders_upload.csv"


def _upload_csv(spark, sf) -> str:
    path = scratch_path(spark, f"uploads/{uuid.uuid4().hex}/{_UPLOAD_NAME}")
    (raw_upload(spark, sf).write.mode("overwrite").option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


_NA = ", ".join("'" + t + "'" for t in NA_TOKENS)


@register("csv_scan", f"""WITH raw AS ({RAW_UPLOAD_SQL})
SELECT {', '.join(f"CASE WHEN ltrim({c}, ' ') IN ({_NA}) THEN NULL ELSE ltrim({c}, ' ') END AS {c}" for c in UPLOAD_COLUMNS)}
FROM raw""")
def q_csv_scan(spark, sf):
    df, _ = read_csv(spark, _upload_csv(spark, sf))
    return df


@register("ingest_metadata", f"""WITH raw AS ({RAW_UPLOAD_SQL})
SELECT '{_UPLOAD_NAME}' AS file_name, '.csv' AS file_format, count(*) AS rows_before, {len(UPLOAD_COLUMNS)}::BIGINT AS columns_raw,
       '{", ".join(UPLOAD_COLUMNS)}' AS original_columns, '{", ".join(UPLOAD_COLUMNS)}' AS normalized_columns, 'UTF-8' AS encoding FROM raw""")
def q_ingest_metadata(spark, sf):
    # The number and size of the files follow the partitioning of the run that wrote them.
    return ingest_metadata(spark, _upload_csv(spark, sf)).drop("n_files", "file_size_bytes")


@register("file_gate")
def q_file_gate(spark, sf):
    cfg = load_config()
    up = _upload_csv(spark, sf)
    a = FI.file_gate(spark, sf, cfg["upload"]["allowed_extensions"], cfg["upload"]["max_bytes"])
    b = FI.file_gate(spark, up, cfg["upload"]["allowed_extensions"], cfg["upload"]["max_bytes"])
    return a.unionByName(b)


@register("dataset_id", f"WITH raw AS ({RAW_UPLOAD_SQL}) SELECT 'upload_table' AS source, ("
          + FI.table_id_sql("raw", UPLOAD_COLUMNS) + ") AS dataset_id")
def q_dataset_id(spark, sf):
    return FI.table_id(raw_upload(spark, sf)).select(F.lit("upload_table").alias("source"), "dataset_id")


@register("file_ids")
def q_file_ids(spark, sf):
    return FI.file_ids(spark, _upload_csv(spark, sf))


@register("persist_clean", _clean_sql() + """
SELECT count(*) AS rows_written, count(*) AS rows_read FROM cleaned""")
def q_persist_clean(spark, sf):
    _, _, cleaned, _, _ = _cleaned(spark, sf)
    ref, written, back = SK.persist_clean(cleaned, "ds_" + uuid.uuid4().hex[:8])
    return spark.range(1).select(F.lit(written).cast("long").alias("rows_written"),
                                 F.lit(back).cast("long").alias("rows_read"))


@register("action_log", FIXED_SQL + """
SELECT "column", issue, fx.f AS fix_applied, rows_affected FROM fixed WHERE fx.f IS NOT NULL""")
def q_action_log(spark, sf):
    from ..operators import validate as VA
    _, _, _, fixed, _ = _cleaned(spark, sf)
    ds = "ds_" + uuid.uuid4().hex[:8]
    SK.persist_action_log(VA.issues_frame(spark, fixed).select("column", "issue", "fix_applied", "rows_affected"), ds)
    return SK.read_dataset(spark, f"sql:{ds}_action_log").drop("dataset_id")


@register("list_datasets")
def q_list_datasets(spark, sf):
    _, _, cleaned, _, _ = _cleaned(spark, sf)
    SK.persist_clean(cleaned, FI.table_id(cleaned).first()["dataset_id"])
    return SK.list_datasets(spark)


@register("sample_rows", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate
FROM orders ORDER BY sha256('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 10""")
def q_sample_rows(spark, sf, n: int = 10, seed: int = 42):
    """Repeatable sample of n rows: the n smallest seeded SHA-256 digests of the key.

    ``orderBy(...).limit(n)`` plans a TakeOrderedAndProject (n rows per task);
    the digest is engine-independent, so the sample can be checked.
    """
    o = table(spark, sf, "orders")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("o_orderkey").cast("string")), 256)
    return (o.orderBy(digest, "o_orderkey").limit(n)
             .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                     F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate")))


def _pipeline(spark, sf):
    return PL.run_validation(spark, raw_upload(spark, sf), "orders_upload.csv", persist=True, mode="lenient")


@register("validation_report")
def q_validation_report(spark, sf):
    return _pipeline(spark, sf)["report"]


@register("report_json")
def q_report_json(spark, sf):
    session = uuid.uuid4().hex
    SK.store_report(_pipeline(spark, sf)["report"], session)
    return SK.stored_report(spark, session)


@register("pipeline_summary")
def q_pipeline_summary(spark, sf):
    r = _pipeline(spark, sf)["report"]
    return r.select("dataset_id", "status", "analytics_ready", "summary.health_score", "summary.rows_before",
                    "summary.rows_after", "summary.message", F.size("issues").cast("long").alias("n_issues"),
                    F.size("column_profile").cast("long").alias("n_profiles"), "clean_data_ref")


# Every number of the report: (part, name, measure, value), with the forest off (it has a key of its own).
_MEASURES = {"min": 4, "max": 4, "mean": 4, "median": 4, "std": 4, "skewness": 4}


def _report_sql() -> str:
    def cells(query: str, part: str, name: str, measures: list[str]) -> list[str]:
        return [f"SELECT '{part}' AS part, {name} AS name, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM ({query})" for m in measures]

    table, profile = ORACLE["date_profile"].split(",\nd AS (")
    dates = [table + ",\nd AS (" + profile.replace("order_date", c) for c in _DATES]
    arms = (cells(ORACLE["validate_issues"], "issue", "concat_ws('|', pos, coalesce(\"column\", ''), issue)", ["rows_affected"])
            + cells(ORACLE["infer_schema"], "schema", "concat_ws('|', \"column\", type)", ["1"])
            + cells(ORACLE["numeric_profile"], "numeric", '"column"', list(_MEASURES))
            + cells(ORACLE["categorical_profile"], "categorical", "concat_ws('|', \"column\", rank, value)", ["count", "unique_count"])
            + [a for q in dates for a in cells(q, "date", "concat_ws('|', \"column\", min_date, max_date, estimated_frequency, notes)", ["date_range_days"])]
            + cells(ORACLE["health_score"], "summary", "'report'", ["health_score"])
            + cells(ORACLE["dedupe_lenient"], "summary", "'report'", ["rows_after"])
            + cells(f"WITH raw AS ({RAW_UPLOAD_SQL}) SELECT count(*) AS rows_before FROM raw", "summary", "'report'", ["rows_before"]))
    return "\nUNION ALL\n".join(arms)


@register("validation_values", _report_sql())
def q_validation_values(spark, sf):
    """Every value of the whole pipeline's report."""
    out = PL.run_validation(spark, raw_upload(spark, sf), persist=False, config={"outlier": {"isolation_forest": False}})
    r = out["report"].first()  # one row
    cells = [("issue", f"{k}|{d['column'] or ''}|{d['issue']}", "rows_affected", d["rows_affected"]) for k, d in enumerate(r["issues"])]
    cells += [("schema", f"{s['column']}|{s['type']}", "1", 1) for s in r["schema"]]
    for p in r["column_profile"]:
        if p["top_values"] is not None:
            for rank, top in enumerate(p["top_values"], start=1):
                name = f"{p['column']}|{rank}|{top['value']}"
                cells += [("categorical", name, "count", top["count"]), ("categorical", name, "unique_count", p["unique_count"])]
        elif p["min_date"] is not None:
            name = "|".join((p["column"], p["min_date"], p["max_date"], p["estimated_frequency"], p["notes"]))
            cells.append(("date", name, "date_range_days", p["date_range_days"]))
        else:
            cells += [("numeric", p["column"], m, round(p[m], digits)) for m, digits in _MEASURES.items()]
    cells += [("summary", "report", m, r["summary"][m]) for m in ("health_score", "rows_after", "rows_before")]
    return spark.createDataFrame([(a, b, c, float(v)) for a, b, c, v in cells], "part string, name string, measure string, value double")


#: Insight section -> (the single query with the same rows, key columns, measures).
INSIGHTS = {
    "forecasts": ("forecast_3m", ["series", "period", "step"], ["value"]),
    "orders_over_time": ("orders_over_time", ["x"], ["y"]),
    "revenue_over_time": ("revenue_over_time", ["x"], ["y"]),
    "sales_by_category": ("sales_by_category", ["id", "chart"], ["value"]),
    "sales_by_region": ("sales_by_region", ["id"], ["value"]),
    "orders_by_status": ("orders_by_status", ["id"], ["value"]),
    "qty_by_category": ("qty_by_category", ["id"], ["value"]),
    "rfm_analysis": ("rfm_segments", ["segment", "description"], ["count", "avg_monetary"]),
    "basket_analysis": ("basket_rules", ["antecedent", "consequent"], ["support", "confidence", "lift"]),
    "kpis": ("kpis", ["id", "label"], ["value"]),
}
# Sections without a hit in the sales view (no status of risk, no value beyond two deviations) give no rows.
EMPTY_INSIGHTS = {"risk_analysis": (["risk_level", "reason"], ["risk_score"]), "anomalies": (["column", "row_id"], ["value", "z_score"])}


def _insight_sql() -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{section}' AS section, concat_ws('|', {', '.join(keys)}) AS key, '{m}' AS measure, CAST({m} AS DOUBLE) AS value
FROM ({ORACLE[query]})""" for section, (query, keys, measures) in INSIGHTS.items() for m in measures)


@register("insights", _insight_sql())
def q_insights(spark, sf):
    """Every value of the insight pass as (section, key, measure, value)."""
    view = sales_view(spark, sf, ["order_id", "order_date", "amount", "quantity", "customer_id", "product", "category", "country", "status"])
    view = written(view, "sales-view")  # each table is joined in once; a section scans only its columns of the joined rows
    shapes = {s: (keys, measures) for s, (_, keys, measures) in INSIGHTS.items()} | EMPTY_INSIGHTS
    out = None
    for section, frame in PL.run_insights(view).items():
        keys, measures = shapes[section]
        cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
        part = frame.select(F.lit(section).alias("section"), F.concat_ws("|", *keys).alias("key"), cells.alias("cell")).select("section", "key", "cell.*")
        out = part if out is None else out.unionByName(part)
    return out


@register("orders_over_time_stream", """
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS x, count(*) AS y FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)
SELECT x, y FROM m WHERE (SELECT count(*) FROM m) >= 2 AND (SELECT sum(y) FROM m) >= 3""")
def q_orders_over_time_stream(spark, sf):
    from ..streaming.rollups import monthly_counts_stream, read_monthly
    run = uuid.uuid4().hex
    sink, ckpt = scratch_path(spark, f"stream/{run}/out"), scratch_path(spark, f"stream/{run}/checkpoint")
    q = monthly_counts_stream(spark, sf, "o_orderdate", sink, ckpt, glob="orders.parquet")
    q.awaitTermination()
    return read_monthly(spark, sink)
