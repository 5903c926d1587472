"""End-to-end passes.

``run_validation`` chains ingest -> standardise -> infer -> validate ->
clean -> profile -> score -> persist -> report.  Each phase is one or a few
distributed aggregates; the standardised and cleaned frames are persisted
once because several phases scan them.  The driver only holds the schema,
the issue list, per-column profiles and a handful of counts.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import load_config, normalize_mode
from ..functions.names import unique_names
from ..operators import anomalies as AN
from ..operators import basket as BK
from ..operators import clean as CL
from ..operators import forecast as FC
from ..operators import infer as INF
from ..operators import kpis as K
from ..operators import profile as PR
from ..operators import rfm as RFM
from ..operators import risk as RK
from ..operators import score as SC
from ..operators import standardize as ST
from ..operators import validate as VA
from ..roles import detect_roles, status_column
from ..sources import files as FI
from ..sources import sinks as SK
from ..sources.csv import read_csv

REPORT_SCHEMA = """
dataset_id string, status string, analytics_ready boolean,
summary struct<health_score: double, rows_before: long, rows_after: long, message: string>,
schema array<struct<column: string, type: string>>,
issues array<struct<column: string, issue: string, rows_affected: long, fix_applied: string, why: string,
                    impact: string>>,
column_profile array<struct<column: string, min: double, max: double, mean: double, median: double, std: double,
                            skewness: double, top_values: array<struct<value: string, count: long>>,
                            unique_count: long, min_date: string, max_date: string, date_range_days: long,
                            estimated_frequency: string, notes: string>>,
clean_data_ref string, error string
"""


def error_report(spark: SparkSession, dataset_id: str | None, message: str) -> DataFrame:
    return spark.createDataFrame([(dataset_id, "ERROR", False, None, [], [], [], None, message)], REPORT_SCHEMA)


def run_validation(spark: SparkSession, source, name: str = "upload.csv", persist: bool = True,
                   mode: str | None = "lenient", config: dict | None = None) -> dict:
    """Runs the nine phases; returns a dict with ``report`` (1-row frame), ``cleaned`` and the parts.

    Any failure becomes an error report, as in the reference.
    """
    try:
        mode = normalize_mode(mode)
    except ValueError as e:
        return {"report": error_report(spark, None, str(e)), "cleaned": None, "error": str(e)}
    try:
        return _run_validation(spark, source, name, persist, mode, config)
    except Exception as e:  # noqa: BLE001 - reported, not swallowed
        return {"report": error_report(spark, None, f"Validation failed: {e}"), "cleaned": None,
                "error": str(e)}


def _run_validation(spark, source, name, persist, mode, config) -> dict:
    held: list[DataFrame] = []
    try:
        return _phases(spark, source, persist, mode, config, held)
    finally:
        for frame in held:
            frame.unpersist()


def _phases(spark, source, persist, mode, config, held: list[DataFrame]) -> dict:
    cfg = load_config(config)
    mode = normalize_mode(mode)
    if isinstance(source, str):
        df, _ = read_csv(spark, source)
    else:
        df = source.toDF(*unique_names(source.columns))
    fp = FI.table_id(df).first()  # the fingerprint pass also counts the rows
    dataset_id, rows_before = fp["dataset_id"], fp["rows"]
    std = ST.standardize(df).persist(StorageLevel.MEMORY_AND_DISK)
    held.append(std)
    if rows_before == 0:
        return {"report": error_report(spark, dataset_id, "File contains no data"), "cleaned": None}
    schema = INF.infer_types(std, cfg)
    stats: dict = {}
    issues = VA.detect_issues(std, schema, cfg, stats=stats)
    cleaned, fixed, actions = CL.clean(std, issues, schema, mode, cfg, stats)
    cleaned = cleaned.persist(StorageLevel.MEMORY_AND_DISK)
    held.append(cleaned)
    rows_after = cleaned.count()
    by_type = {t: [s["column"] for s in schema if s["type"] == t] for t in ("numeric", "categorical", "date")}
    profiles = []
    for p in PR.numeric_profiles(cleaned, by_type["numeric"], cfg):
        profiles.append({"column": p["column"], "min": p["min"], "max": p["max"], "mean": p["mean"],
                         "median": p["median"], "std": p["std"], "skewness": p["skewness"], "notes": p["notes"]})
    for p in PR.categorical_profiles(cleaned, by_type["categorical"], cfg):
        profiles.append({"column": p["column"], "top_values": [{"value": v, "count": n} for v, n in p["top_values"]],
                         "unique_count": p["unique_count"], "notes": p["notes"]})
    for r in PR.date_profiles(cleaned, by_type["date"]).collect():
            profiles.append({"column": r["column"], "min_date": r["min_date"], "max_date": r["max_date"],
                             "date_range_days": r["date_range_days"], "estimated_frequency": r["estimated_frequency"],
                             "notes": r["notes"]})
    order = {s["column"]: i for i, s in enumerate(schema)}
    profiles.sort(key=lambda p: order[p["column"]])
    issue_df = VA.issues_frame(spark, fixed)
    shape = spark.range(1).select(F.lit(rows_after).cast("long").alias("n_rows"),
                                  F.lit(len(cleaned.columns)).cast("long").alias("n_cols"))
    scored = SC.with_message(SC.health_score(issue_df, shape, cfg["health_weights"]), "READY",
                             cfg["manual_review"]["health_threshold"]).first()
    ref = None
    if persist:
        ref, _, _ = SK.persist_clean(cleaned, dataset_id)
        SK.persist_action_log(issue_df.select("column", "issue", "fix_applied", "rows_affected"), dataset_id)
    keys = ["column", "min", "max", "mean", "median", "std", "skewness", "top_values", "unique_count", "min_date",
            "max_date", "date_range_days", "estimated_frequency", "notes"]
    report = spark.createDataFrame([(
        dataset_id, "READY", bool(scored["analytics_ready"]),
        (float(scored["health_score"]), int(rows_before), int(rows_after), scored["message"]),
        [(s["column"], s["type"]) for s in schema],
        [(d["column"], d["issue"], d["rows_affected"], d["fix_applied"], d["why"], d["impact"]) for d in fixed],
        [tuple(p.get(k) for k in keys) for p in profiles],
        ref, None)], REPORT_SCHEMA)
    if ref:
        cleaned = SK.read_dataset(spark, ref)  # the written table instead of the released frame
    return {"report": report, "cleaned": cleaned, "schema": schema, "issues": fixed, "actions": actions,
            "dataset_id": dataset_id, "health_score": scored["health_score"]}


def run_insights(df: DataFrame, mapping: dict | None = None) -> dict[str, DataFrame]:
    """The insight pass gated by column roles (anomalies, forecast, risk, roll-ups, RFM, baskets)."""
    roles = detect_roles(df.columns, mapping)
    out: dict[str, DataFrame] = {}
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "long", "integer", "float")]
    if numeric:
        rid = roles.get("order_id", numeric[0])
        out["anomalies"] = AN.anomalies(df, numeric, rid)
    d, a, q = roles.get("date"), roles.get("amount"), roles.get("quantity")
    cat, ctry, st = roles.get("category"), roles.get("country"), roles.get("status")
    if d and a:
        out["forecasts"] = FC.forecast_3m(df, d, a)
    sc = status_column(df.columns)
    if sc:
        out["risk_analysis"] = RK.risk_analysis(df, sc)
    if d:
        out["orders_over_time"] = K.orders_over_time(df, d)
    if d and a:
        out["revenue_over_time"] = K.revenue_over_time(df, d, a)
    if cat and a:
        out["sales_by_category"] = K.sales_by_category(df, cat, a)
    if cat and not a:
        out["count_by_category"] = K.count_by_category(df, cat)
    if ctry and a:
        out["sales_by_region"] = K.sales_by_region(df, ctry, a)
    if st:
        out["orders_by_status"] = K.orders_by_status(df, st)
    if cat and q and "sales_by_category" in out:
        out["qty_by_category"] = K.qty_by_category(df, cat, q)
    if d and a and roles.get("customer_id"):
        out["rfm_analysis"] = RFM.rfm_segments(RFM.rfm_table(df, d, a, roles["customer_id"]))
    if roles.get("order_id") and roles.get("product_id"):
        out["basket_analysis"] = BK.basket_rules(df, roles["order_id"], roles["product_id"])
    out["kpis"] = K.kpis(df, amount=a, order_id=roles.get("order_id"), quantity=q)
    return out
