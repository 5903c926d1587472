"""Sources and sinks: workbook scan, fingerprints, persisted tables, samples."""

import os
import tempfile
import zipfile

from pyspark.sql import functions as F

from quillspark.sources import files as FI
from quillspark.sources import sinks as SK


def _write_xlsx(path, rows):
    """Minimal workbook (shared strings + one sheet), written with the stdlib."""
    strings, idx = [], {}
    def sid(v):
        if v not in idx:
            idx[v] = len(strings)
            strings.append(v)
        return idx[v]
    cells = []
    for r, row in enumerate(rows, start=1):
        cs = []
        for c, v in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if v is None:
                continue
            if isinstance(v, (int, float)):
                cs.append(f'<c r="{ref}"><v>{v}</v></c>')
            else:
                cs.append(f'<c r="{ref}" t="s"><v>{sid(v)}</v></c>')
        cells.append(f'<row r="{r}">{"".join(cs)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}>' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(cells)}</sheetData></worksheet>')


def test_xlsx_scan(spark):
    d = tempfile.mkdtemp(prefix="quill-xlsx-")
    _write_xlsx(os.path.join(d, "a.xlsx"), [["Order ID", "Region", "Sales"], ["ORD1", "US", 10.5],
                                            ["ORD2", "NA", 20], ["ORD3", None, 7]])
    df = FI.read_xlsx(spark, d)
    assert df.columns == ["order_id", "region", "sales"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("ORD1", "US", "10.5"), ("ORD2", None, "20"), ("ORD3", None, "7")]


def test_table_id_ignores_row_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, v string")
    b = a.orderBy(F.desc("k")).repartition(3)
    ia, ib = FI.table_id(a).first()["dataset_id"], FI.table_id(b).first()["dataset_id"]
    assert ia == ib and ia.startswith("ds_") and len(ia) == 11
    c = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, v string")
    assert FI.table_id(c).first()["dataset_id"] != ia


def test_persist_and_list(spark):
    df = spark.range(25).withColumn("v", F.col("id") * 2)
    ref, written, back = SK.persist_clean(df, "ds_test0001")
    assert (ref, written, back) == ("sql:ds_test0001_cleaned", 25, 25)
    assert "ds_test0001" in [r["dataset_id"] for r in SK.list_datasets(spark).collect()]
    acts = spark.createDataFrame([("a", "Missing values", "fix", 3), ("b", "Type mismatch", None, 2)],
                                 "column string, issue string, fix_applied string, rows_affected long")
    assert SK.persist_action_log(acts, "ds_test0001") == 1
    assert SK.read_dataset(spark, "sql:ds_test0001_action_log").first()["dataset_id"] == "ds_test0001"
