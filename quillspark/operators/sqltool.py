"""Guarded ad-hoc SQL over one dataset.

The dataset is bound under the names ``data`` and ``dataset`` in a session of its
own.  A statement is judged by its parsed plan (operators.guard), which must also
be one query whose outermost step is a LIMIT of at most ``MAX_ROWS``.
"""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .guard import Guard, NotAllowed

# Fixed values that must equal the reference: words that no statement may hold.
BLOCKED = ["drop", "delete", "insert", "update", "alter", "create", "truncate", "exec", "execute"]
MAX_ROWS = 100
NAMES = ("data", "dataset")

_CATALYST = "org.apache.spark.sql.catalyst.plans.logical."
_STRFTIME = re.compile(r"strftime\(\s*'%Y-%m'\s*,\s*([A-Za-z_][A-Za-z0-9_]*)\s*\)", re.IGNORECASE)


def bind(query: str) -> str:
    """Map the one DuckDB date function that the generated SQL uses."""
    return _STRFTIME.sub(r"date_format(\1, 'yyyy-MM')", query)


def check_limits(guard: Guard, plan, query: str) -> None:
    """The statement is one query with a bounded outermost LIMIT."""
    kinds = [guard.spark._jvm.java.lang.Class.forName(_CATALYST + k) for k in ("Command", "ParsedStatement")]
    if any(k.isInstance(plan) for k in kinds):
        raise NotAllowed(f"only a query is allowed, not {plan.nodeName()}")
    while plan.nodeName() in ("UnresolvedWith", "WithCTE") and plan.children().size():
        plan = plan.children().apply(0)
    if plan.nodeName() != "GlobalLimit":
        raise NotAllowed(f"the query must end in LIMIT (at most {MAX_ROWS})")
    limit = plan.limitExpr().toString()
    if not limit.isdigit() or int(limit) > MAX_ROWS:
        raise NotAllowed(f"LIMIT {limit} is over {MAX_ROWS}")
    for word in BLOCKED:
        if re.search(rf"\b{word}\b", query, re.IGNORECASE):
            raise NotAllowed(f"the word '{word}' is not allowed")


def run_guarded(spark: SparkSession, df: DataFrame, query: str, bypass: bool = False) -> DataFrame:
    """Rows of the query; raises ``NotAllowed`` (``bypass``: a stored statement, without the limit rules)."""
    guard, text = Guard(spark), bind(query)
    plan = guard.parsed(text)
    if not bypass:
        check_limits(guard, plan, query)
    guard.check_plan(plan, NAMES)
    out = guard.analysed(df, text, NAMES)
    return out if bypass else out.limit(MAX_ROWS)


_ANSWER = "ok boolean, error string, columns string, row_count long, rows string"


def answer(spark: SparkSession, df: DataFrame, query: str) -> DataFrame:
    """One row: the result (columns, row count, rows as JSON), or why there is none."""
    try:
        out = run_guarded(spark, df, query)
    except (NotAllowed, PySparkException) as e:
        text = str(e) if isinstance(e, NotAllowed) else f"{e.getCondition()}"
        return spark.createDataFrame([(False, text, None, 0, None)], _ANSWER)
    packed = out.select(F.struct(*[F.col(f"`{c}`") for c in out.columns]).alias("r")).agg(  # at most MAX_ROWS rows
        F.count(F.lit(1)).alias("row_count"), F.to_json(F.collect_list("r")).alias("rows"))
    return packed.select(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"),
                         F.lit(",".join(out.columns)).alias("columns"), "row_count", "rows")


def answer_all(spark: SparkSession, df: DataFrame, queries: list[str]) -> list[DataFrame]:
    """Answers of stored statements; one that fails does not stop the others."""
    return [answer(spark, df, q) for q in queries]
