"""Sinks: cleaned table, action log, dataset listing, report JSON.

Tables are parquet folders under the warehouse folder (``spark.sql.warehouse.dir``),
registered in the session catalog as external tables ``<dataset_id>_cleaned`` / ``<dataset_id>_action_log``.  Writes are
``overwrite`` (the reference replaces the table); the written row count comes
from an ``Observation`` on the write itself, not a second scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import table_path


def _write_table(df: DataFrame, name: str) -> tuple[str, int]:
    spark = df.sparkSession
    path = table_path(spark, f"tables/{name}")
    obs = Observation(name)
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    spark.catalog.createTable(name, path=path, source="parquet")
    return path, obs.get["rows"]


def persist_clean(df: DataFrame, dataset_id: str) -> tuple[str, int, int]:
    """Write the cleaned table; returns (reference, rows written, rows read back)."""
    name = f"{dataset_id}_cleaned"
    path, written = _write_table(df, name)
    back = df.sparkSession.read.table(name).count()
    return f"sql:{name}", written, back


def persist_action_log(actions: DataFrame, dataset_id: str) -> int:
    """Fixed issues plus ``dataset_id``; nothing is written when there is no fix."""
    rows = actions.filter(F.col("fix_applied").isNotNull()).withColumn("dataset_id", F.lit(dataset_id))
    if rows.isEmpty():
        return 0
    _, written = _write_table(rows, f"{dataset_id}_action_log")
    return written


def read_dataset(spark: SparkSession, ref: str) -> DataFrame:
    """Read a ``sql:<table>`` (or bare table name) reference back."""
    name = ref.split(":", 1)[1] if ":" in ref else ref
    return spark.read.table(name)


def list_datasets(spark: SparkSession) -> DataFrame:
    tables = [t.name for t in spark.catalog.listTables() if t.name.endswith("_cleaned")]
    return spark.createDataFrame([(t[: -len("_cleaned")], t) for t in sorted(tables)],
                                 "dataset_id string, table_name string")


def report_json(report: DataFrame) -> DataFrame:
    """One JSON text per report row (the session result store)."""
    return report.select(F.to_json(F.struct(*[F.col(c) for c in report.columns])).alias("report_json"))


def store_report(report: DataFrame, session_id: str) -> str:
    """Append a session's report JSON to the result store; returns the store's folder."""
    path = table_path(report.sparkSession, "session_results")
    rows = report_json(report).select(F.lit(session_id).alias("session_id"), "report_json")
    rows.write.mode("append").partitionBy("session_id").parquet(path)  # a session's read opens its own folder only
    return path


def stored_report(spark: SparkSession, session_id: str) -> DataFrame:
    """The stored report of one session."""
    stored = spark.read.schema("report_json string, session_id string").parquet(table_path(spark, "session_results"))
    return stored.filter(F.col("session_id") == session_id).select("report_json")
