"""Standardisation: trim, placeholders to NULL, drop empty rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import NULL_PLACEHOLDERS

# Characters Python's ``str.strip()`` removes: every code point with isspace().
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def whitespace_sql() -> str:
    """The same character set as a DuckDB expression (oracle only)."""
    return " || ".join(f"chr({ord(ch)})" for ch in WHITESPACE)


def _clean_col(name: str, dtype) -> F.Column:
    c = F.col(name)
    if isinstance(dtype, T.StringType):
        # Trimming goes through every character: only cells with white space at an end are trimmed.
        edge = F.substring(c, 1, 1).isin(*WHITESPACE) | F.substring(c, -1, 1).isin(*WHITESPACE)
        null, trimmed = F.lit(None).cast("string"), F.btrim(c, F.lit(WHITESPACE))
        return (F.when(edge, F.when(trimmed.isin(NULL_PLACEHOLDERS), null).otherwise(trimmed))
                .when(c.isin(NULL_PLACEHOLDERS), null).otherwise(c).alias(name))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c), F.lit(None).cast(dtype)).otherwise(c).alias(name)
    return c.alias(name)


def replace_placeholders(df: DataFrame) -> DataFrame:
    """Trim strings and turn placeholder texts / NaN into NULL (one projection)."""
    return df.select(*[_clean_col(f.name, f.dataType) for f in df.schema.fields])


def _all_null(df: DataFrame):
    cond = F.lit(True)
    for c in df.columns:
        cond = cond & F.col(c).isNull()
    return cond


def standardize(df: DataFrame) -> DataFrame:
    """The standardised frame: trimmed, placeholders NULL, all-NULL rows dropped."""
    rep = replace_placeholders(df)
    return rep.filter(~_all_null(rep))


def standardize_log(df: DataFrame) -> DataFrame:
    """One row: rows_before, rows_after, empty_rows_removed, nulls_replaced, n_columns.

    ``nulls_replaced`` counts every NULL after replacement, before the row drop.
    """
    rep = replace_placeholders(df)
    nulls = sum((F.count_if(F.col(c).isNull()) for c in rep.columns), F.lit(0))
    empty = F.count_if(_all_null(rep))
    return (rep.agg(F.count(F.lit(1)).alias("rows_before"), empty.alias("empty_rows_removed"),
                    nulls.alias("nulls_replaced"))
               .select("rows_before", (F.col("rows_before") - F.col("empty_rows_removed")).alias("rows_after"),
                       "empty_rows_removed", F.col("nulls_replaced").cast("long").alias("nulls_replaced"),
                       F.lit(len(df.columns)).cast("long").alias("n_columns")))
