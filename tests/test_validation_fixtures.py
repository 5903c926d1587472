"""The reference's CSV scenarios, end to end (expected values: FIXTURES.md)."""

import os
import tempfile

import pytest

from quillspark.plans.pipeline import run_validation
from quillspark.sources import files as FI
from quillspark.sources.csv import read_csv


def _run(spark, path, mode="lenient"):
    out = run_validation(spark, path, os.path.basename(path), persist=True, mode=mode)
    rep = out["report"].first()
    return out, rep


def _issue(rep, name, column=None):
    return [i for i in rep["issues"] if i["issue"] == name and (column is None or i["column"] == column)]


def test_clean_file(spark, fixture_path):
    out, rep = _run(spark, fixture_path("sample_clean.csv"))
    assert rep["status"] == "READY"
    assert rep["issues"] == []
    assert rep["summary"]["health_score"] == pytest.approx(0.90)
    assert rep["analytics_ready"] is True
    types = {s["column"]: s["type"] for s in rep["schema"]}
    assert types == {"order_id": "string", "order_date": "date", "region": "string", "sales": "numeric"}


def test_missing_values(spark, fixture_path):
    out, rep = _run(spark, fixture_path("sample_missing_values.csv"))
    missing = _issue(rep, "Missing values")
    assert {(i["column"], i["rows_affected"]) for i in missing} == {("order_date", 3), ("region", 2), ("sales", 4)}
    sales = _issue(rep, "Missing values", "sales")[0]
    assert sales["fix_applied"] == "Filled missing values using median (212.50)"
    assert _issue(rep, "Missing values", "order_date")[0]["fix_applied"] == "Missing dates kept as NaT (Not a Time)"
    cleaned = out["cleaned"]
    assert cleaned.filter("sales is null").count() == 0
    assert cleaned.filter("region = ''").count() == 2
    assert cleaned.filter("order_date is null").count() == 3
    assert rep["summary"]["health_score"] == pytest.approx(0.82)


def test_duplicates_lenient_and_strict(spark, fixture_path):
    out, rep = _run(spark, fixture_path("sample_duplicates.csv"), "lenient")
    assert _issue(rep, "Duplicate records")[0]["rows_affected"] == 3
    assert rep["summary"]["rows_after"] == 7
    assert rep["summary"]["health_score"] == pytest.approx(0.81)
    out, rep = _run(spark, fixture_path("sample_duplicates.csv"), "strict")
    assert rep["summary"]["rows_after"] == 10
    assert _issue(rep, "Duplicate records")[0]["fix_applied"] == "Duplicates flagged for manual review"
    assert rep["summary"]["health_score"] == pytest.approx(0.84)


def test_mixed_dates(spark, fixture_path):
    out, rep = _run(spark, fixture_path("sample_mixed_dates.csv"))
    types = {s["column"]: s["type"] for s in rep["schema"]}
    assert types["order_date"] == "date"
    mixed = _issue(rep, "Mixed date formats", "order_date")
    assert mixed and mixed[0]["rows_affected"] == 5
    assert out["cleaned"].filter("order_date is not null").count() == 8
    assert rep["summary"]["health_score"] == pytest.approx(0.87)


def test_outliers_flagged_not_removed(spark, fixture_path):
    out, rep = _run(spark, fixture_path("sample_outliers.csv"))
    o = _issue(rep, "Extreme outliers detected", "sales")
    assert o and o[0]["rows_affected"] == 1
    assert o[0]["fix_applied"] == "Outliers flagged but not removed"
    assert rep["summary"]["rows_after"] == 15
    assert rep["summary"]["health_score"] == pytest.approx(0.89)


def test_determinism(spark, fixture_path):
    _, a = _run(spark, fixture_path("sample_missing_values.csv"))
    _, b = _run(spark, fixture_path("sample_missing_values.csv"))
    assert a["dataset_id"] == b["dataset_id"]
    assert a["summary"]["health_score"] == b["summary"]["health_score"]
    assert a["issues"] == b["issues"] and a["schema"] == b["schema"]


def test_csv_bad_and_short_rows(spark):
    d = tempfile.mkdtemp(prefix="quill-csv-")
    with open(os.path.join(d, "t.csv"), "w") as f:
        f.write("Order ID,Order Date,order id, 2nd\n  a,2024-01-01,x,1\nb,2024-01-02,y,2,EXTRA\nc,NA\n\nd,N/A,z,4\n")
    df, meta = read_csv(spark, d)
    assert df.columns == ["order_id", "order_date", "order_id_1", "col_2nd"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("a", "2024-01-01", "x", "1"), ("c", None, None, None), ("d", None, "z", "4")]


def test_latin1_detection(spark):
    d = tempfile.mkdtemp(prefix="quill-csv-")
    with open(os.path.join(d, "t.csv"), "wb") as f:
        f.write("name,city\nJos\xe9,M\xfcnchen\n".encode("latin-1"))
    df, meta = read_csv(spark, d)
    assert meta["encoding"] == "ISO-8859-1"
    assert df.first()["name"] == "José"


def test_file_gate(spark):
    d = tempfile.mkdtemp(prefix="quill-gate-")
    with open(os.path.join(d, "big.csv"), "wb") as f:
        f.write(b"a\n" * (21 * 1024 * 1024 // 2))
    open(os.path.join(d, "notes.txt"), "w").write("hello")
    open(os.path.join(d, "empty.csv"), "w").close()
    got = {r["file_name"]: r["error"] for r in FI.file_gate(spark, d, [".csv", ".xlsx"], 20_000_000).collect()}
    assert got["big.csv"] == "File size (21.00 MB) exceeds maximum allowed size (19.07 MB)"
    assert got["empty.csv"] == "File is empty"
    assert got["notes.txt"] == "Unsupported file format '.txt'. Allowed formats: .csv, .xlsx"


def test_median_fill_on_short_numeric_column(spark):
    d = tempfile.mkdtemp(prefix="quill-csv-")
    with open(os.path.join(d, "t.csv"), "w") as f:
        f.write("sales,name\n1.5,a\n,b\n3.5,c\n")
    out = run_validation(spark, d, persist=False)
    assert out["issues"][0]["fix_applied"] == "Filled missing values using median (2.50)"
    assert sorted(r["sales"] for r in out["cleaned"].collect()) == [1.5, 2.5, 3.5]


def test_report_shape_and_json(spark, fixture_path):
    import json
    from quillspark.sources import sinks as SK
    out, rep = _run(spark, fixture_path("sample_missing_values.csv"))
    assert set(out["report"].columns) >= {"dataset_id", "status", "analytics_ready", "summary", "schema", "issues",
                                           "column_profile", "clean_data_ref"}
    assert rep["dataset_id"].startswith("ds_") and rep["clean_data_ref"] == f"sql:{rep['dataset_id']}_cleaned"
    assert set(rep["summary"].asDict()) == {"health_score", "rows_before", "rows_after", "message"}
    profiles = {p["column"]: p for p in rep["column_profile"]}
    assert profiles["sales"]["median"] == pytest.approx(212.5)
    assert profiles["order_date"]["min_date"] == "2024-01-15"
    doc = json.loads(SK.report_json(out["report"]).first()["report_json"])
    assert doc["summary"]["rows_before"] == 10 and len(doc["issues"]) == 3
