"""One call contract for the assistant's data tools.

Every tool takes the dataset and named arguments and answers with one row: the tool,
whether it succeeded, why not, and its rows (at most ``MAX_ROWS``) as JSON with their
columns and number.  Columns are found by their names.  Unknown tools, arguments
and columns are answers too, so a caller never has to catch an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..roles import diagnostic_columns, forecast_columns
from . import diagnose as DG
from . import forecast as FC
from . import sqltool as SQ
from . import whatif as WI
from .guard import NotAllowed

RESULT = "tool string, ok boolean, error string, columns string, row_count long, rows string"
MAX_ROWS = SQ.MAX_ROWS


def execute_sql_query(df: DataFrame, query: str) -> DataFrame:
    return SQ.run_guarded(df.sparkSession, df, query)


def generate_forecast(df: DataFrame, horizon: int = 12) -> DataFrame:
    date, value = forecast_columns(df.columns)
    if date is None or value is None:
        raise ValueError("no date and value columns to forecast")
    if not 1 <= horizon <= MAX_ROWS:
        raise ValueError(f"the horizon must be 1 to {MAX_ROWS} months")
    return FC.forecast_answer(df, date, value, horizon)


def diagnose_change(df: DataFrame, metric: str, start: str, end: str, compare_start: str, compare_end: str) -> DataFrame:
    date, dims = diagnostic_columns(df.columns)
    found = next((c for c in df.columns if c.lower() == metric.lower()), None)
    if date is None or found is None:
        raise ValueError(f"no date column or no column '{metric}'")
    return DG.diagnose_answer(df, date, found, [d for d in dims if d != found], start, end, compare_start, compare_end)


def simulate_scenario(df: DataFrame, target: str, operation: str, value: float, condition: str | None = None) -> DataFrame:
    return WI.what_if_by_name(df, target, operation, value, condition)


# Fixed values that must equal the reference: the names of the tools.
TOOLS: dict[str, Callable[..., DataFrame]] = {
    "execute_sql_query": execute_sql_query, "simulate_scenario": simulate_scenario,
    "generate_forecast": generate_forecast, "diagnose_change": diagnose_change}


def call(df: DataFrame, tool: str, **arguments) -> DataFrame:
    """The tool's answer as one row of RESULT."""
    spark = df.sparkSession
    if tool not in TOOLS:
        return spark.createDataFrame([(tool, False, f"unknown tool '{tool}'", None, 0, None)], RESULT)
    try:
        out = TOOLS[tool](df, **arguments)
    except PySparkException as e:
        return spark.createDataFrame([(tool, False, f"{e.getCondition()}", None, 0, None)], RESULT)
    except (NotAllowed, ValueError, TypeError) as e:
        return spark.createDataFrame([(tool, False, str(e), None, 0, None)], RESULT)
    columns = [c for c in out.columns if c != "error"]
    error = F.col("error") if "error" in out.columns else F.lit(None).cast("string")
    shown = out.limit(MAX_ROWS).select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), error.alias("error"))
    packed = shown.agg(F.max("error").alias("error"), F.count(F.lit(1)).alias("n"), F.to_json(F.collect_list("row")).alias("rows"))
    fine = F.col("error").isNull()
    return packed.select(F.lit(tool).alias("tool"), fine.alias("ok"), "error", F.when(fine, F.lit(",".join(columns))).alias("columns"),
                         F.when(fine, F.col("n")).otherwise(0).alias("row_count"), F.when(fine, F.col("rows")).alias("rows"))
