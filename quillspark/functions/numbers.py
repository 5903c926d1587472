"""Strict text-to-number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A whole cell that is a plain decimal number or an infinity.  The engine's own
# casts also take type suffixes ("12D", "7f"), hexadecimal floats and "NaN".
NUMBER = r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)"


def parse_number(c: Column | str) -> Column:
    """Double of a text cell (blanks around it ignored); NULL where it is not a number."""
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(s.rlike(rf"^[\x00-\x20]*{NUMBER}[\x00-\x20]*$"), s.try_cast("double"))


def duckdb_number(col_sql: str) -> str:
    return f"(CASE WHEN regexp_full_match(trim(CAST({col_sql} AS VARCHAR)), '{NUMBER}') THEN try_cast({col_sql} AS DOUBLE) END)"
