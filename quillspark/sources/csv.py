"""CSV ingestion.

Rows with more fields than the header are skipped and short rows are padded,
like pandas ``on_bad_lines='skip'``: the schema is all strings plus one
trailing ``__overflow`` column that is only filled by over-long rows.
(``DROPMALFORMED`` would also drop the short rows.)  The encoding is UTF-8
unless some line is not valid UTF-8, then Latin-1 (which never fails).

Files are read range by range (sources.csv_split), also where quoted fields
hold line ends, so one large file is read by many tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import unique_names
from ..session import scratch_path
from . import csv_split

# pandas' default NA strings plus the reference's extra ones.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "NONE"]
OVERFLOW = "__overflow"


# RFC 4180: quotes are doubled inside quotes, backslashes are plain, quoted line ends belong to the field.
FORMAT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE"}


def _reader(spark: SparkSession, encoding: str):
    return spark.read.options(**FORMAT).option("encoding", encoding)


def scan_ranges(spark: SparkSession, path: str) -> tuple[DataFrame, str, bool]:
    """Transitions of the files' ranges (written), the encoding, and whether any line ends inside a quoted field."""
    target = f"{scratch_path(spark, 'csv')}/ranges-{uuid.uuid4().hex}"
    csv_split.transitions(spark, path).write.parquet(target)
    states = spark.read.schema(csv_split.STATES).parquet(target)
    valid, opened = states.agg(F.bool_and("valid"), F.bool_or("opened")).first()
    return states, "UTF-8" if valid in (True, None) else "ISO-8859-1", bool(opened)


def header_names(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """Raw header field names: the first record, by the same parser (one row through the driver)."""
    first = _reader(spark, encoding).option("multiLine", True).option("header", False).csv(path).first()
    if first is None:
        raise ValueError("File contains no data")
    return [(x or "").lstrip("\ufeff") for x in first]


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> tuple[DataFrame, dict]:
    """(frame of string columns with sanitised unique names, ingest metadata)."""
    states, detected, opened = scan_ranges(spark, path)
    enc = encoding or detected
    raw_names = header_names(spark, path, enc)
    names = unique_names(raw_names)
    schema = ", ".join(f"{c} string" for c in (*(f"_c{i}" for i in range(len(names))), OVERFLOW))
    if opened:
        found = csv_split.records(spark, path, csv_split.range_starts(states), enc).filter(~F.col("first"))
        df = found.select(F.from_csv("record", schema, {**FORMAT, "multiLine": "true"}).alias("r")).select("r.*")
    else:
        df = _reader(spark, enc).schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    df = df.filter(F.col(OVERFLOW).isNull())
    cols = [F.when(F.col(f"_c{i}").isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(F.col(f"_c{i}")).alias(n)
            for i, n in enumerate(names)]
    meta = {"file_format": ".csv", "encoding": enc, "original_columns": raw_names,
            "normalized_columns": names, "columns_raw": len(names)}
    return df.select(*cols), meta


def ingest_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row: file name, format, files, rows, columns, original / normalised names, bytes, encoding.

    A file without data rows raises ``ValueError``, as one without a header does.
    """
    df, meta = read_csv(spark, path)
    n_rows = df.count()
    if n_rows == 0:
        raise ValueError("File contains no data")
    files = (spark.read.format("binaryFile").load(path).select("path", "length")
                  .filter(F.col("path").endswith(".csv")))
    sizes = files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("file_size_bytes"))
    return sizes.select(
        F.lit(path.rstrip("/").rpartition("/")[2]).alias("file_name"), F.lit(meta["file_format"]).alias("file_format"), "n_files",
        F.lit(n_rows).cast("long").alias("rows_before"), F.lit(meta["columns_raw"]).cast("long").alias("columns_raw"),
        F.lit(", ".join(meta["original_columns"])).alias("original_columns"),
        F.lit(", ".join(meta["normalized_columns"])).alias("normalized_columns"),
        F.col("file_size_bytes").cast("long").alias("file_size_bytes"), F.lit(meta["encoding"]).alias("encoding"))
