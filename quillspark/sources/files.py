"""File-level sources: upload gate, fingerprints, workbook scan."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of every file under ``path``, zero-length files included.

    Spark's file sources skip empty files, so the listing goes through the
    Hadoop FileSystem of the session (metadata only, as Spark's own file
    index does).  Any failure of the listing is raised.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    it = root.getFileSystem(conf).listFiles(root, True)
    rows = []
    while it.hasNext():
        st = it.next()
        name = st.getPath().getName()
        if not name.startswith((".", "_")):
            rows.append((st.getPath().toString(), int(st.getLen())))
    return spark.createDataFrame(rows, "path string, length long")


def file_gate(spark: SparkSession, path: str, allowed: list[str], max_bytes: int) -> DataFrame:
    """``(file_name, length, ok, error)`` per file; file contents are never read.

    Checks in the reference's order: too big, empty, extension.
    """
    files = list_files(spark, path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    mb = F.col("length") / (1024 * 1024)
    err = (F.when(F.col("length") > max_bytes,
                  F.format_string("File size (%.2f MB) exceeds maximum allowed size (%.2f MB)", mb,
                                  F.lit(max_bytes / (1024 * 1024))))
            .when(F.col("length") == 0, F.lit("File is empty"))
            .when(~ext.isin(allowed), F.format_string("Unsupported file format '%s'. Allowed formats: %s", ext,
                                                      F.lit(", ".join(allowed)))))
    return files.select(name.alias("file_name"), "length", err.isNull().alias("ok"), err.alias("error"))


def file_ids(spark: SparkSession, path: str) -> DataFrame:
    """``ds_`` + first 8 hex digits of the SHA-256 of each file's bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
                        F.concat(F.lit("ds_"), F.substring(F.sha2("content", 256), 1, 8)).alias("dataset_id"))


def table_id(df: DataFrame) -> DataFrame:
    """Order-insensitive fingerprint of a table: ``ds_`` + sha256(rows, sum of row hashes)[:8].

    A row's hash is the first 60 bits of the SHA-256 of its cells as text, so that
    any engine can repeat it (``table_id_sql``).
    """
    cells = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns])
    h = F.conv(F.substring(F.sha2(cells, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    agg = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("checksum"))
    return agg.select(F.concat(F.lit("ds_"), F.substring(F.sha2(F.concat_ws(":", F.col("rows").cast("string"),
                                                                              "checksum"), 256), 1, 8))
                       .alias("dataset_id"), "rows", "checksum")


def table_id_sql(relation: str, columns: list[str]) -> str:
    """``dataset_id`` of a relation of text columns, for the oracle."""
    cells = ", ".join(f"coalesce({c}, chr(0))" for c in columns)
    return f"""SELECT 'ds_' || substr(sha256(count(*) || ':' || coalesce(sum(CAST(('0x' || substr(sha256(concat_ws(chr(31), {cells})), 1, 15)) AS BIGINT)), 0)), 1, 8)
FROM {relation}"""


# ---------------------------------------------------------------- workbooks

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _cells(content: bytes):
    """(row, col, value) of the first sheet of one .xlsx (stdlib zip + xml)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ET.fromstring(z.read("xl/sharedStrings.xml"))
            for si in root.findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        sheets = sorted(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n))
        if not sheets:
            return
        root = ET.fromstring(z.read(sheets[0]))
        for row in root.iter(f"{{{_NS['m']}}}row"):
            r = int(row.get("r")) - 1
            for c in row.findall("m:c", _NS):
                t = c.get("t")
                if t == "inlineStr":
                    v = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
                else:
                    node = c.find("m:v", _NS)
                    v = None if node is None else node.text
                    if t == "s" and v is not None:
                        v = shared[int(v)]
                yield r, _col_index(c.get("r")), v


def _explode_workbooks(batches):
    for pdf in batches:
        out = [(p, r, c, v) for p, content in zip(pdf["path"], pdf["content"]) for r, c, v in _cells(content)]
        yield pd.DataFrame(out, columns=["path", "row", "col", "value"])


def xlsx_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cell rows ``(path, row, col, value)`` of the first sheet of every workbook in ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(_explode_workbooks, "path string, row long, col long, value string")


def read_xlsx(spark: SparkSession, path: str, columns: int | None = None) -> DataFrame:
    """Workbooks to a table: row 0 holds the header; one output row per (file, sheet row)."""
    from ..functions.names import unique_names
    from .csv import NA_TOKENS
    cells = xlsx_cells(spark, path)
    header = cells.filter(F.col("row") == 0).groupBy("col").agg(F.first("value").alias("name")).orderBy("col").collect()
    names = unique_names([h["name"] or "" for h in header][:columns])
    body = (cells.filter(F.col("row") > 0).groupBy("path", "row")
                 .pivot("col", list(range(len(names)))).agg(F.first("value")))
    return body.select(*[F.when(F.col(str(i)).isin(NA_TOKENS), None).otherwise(F.col(str(i))).alias(n)
                         for i, n in enumerate(names)])
