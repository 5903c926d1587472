"""One large quoted file is read range by range: same rows as a single-split reader."""

import csv as pycsv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.sources import csv as CSV
from quillspark.sources import csv_split as CS


def one_split(spark, path, encoding="UTF-8"):
    """Raw rows by Spark's whole-file reader, overlong rows left out."""
    names = CSV.header_names(spark, path, encoding)
    schema = ", ".join(f"_c{i} string" for i in range(len(names) + 1))
    df = spark.read.options(**CSV.FORMAT).option("multiLine", True).option("encoding", encoding).schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    rows = [tuple(r) for r in df.collect()]
    return sorted((r[:-1] for r in rows if r[-1] is None and any(v is not None for v in r)), key=repr)


def by_ranges(spark, path, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df, meta = CSV.read_csv(spark, path)
        parts = CS.lines(spark, path).rdd.getNumPartitions()
        return sorted((tuple(r) for r in df.collect() if any(v is not None for v in r)), key=repr), meta, parts
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def clean(rows):
    return sorted((tuple(None if v in CSV.NA_TOKENS else v for v in r) for r in rows if any(v is not None and v not in CSV.NA_TOKENS for v in r)), key=repr)


def sample(seed, n, end="\n"):
    r = random.Random(seed)
    out = io.StringIO()
    w = pycsv.writer(out, lineterminator=end)
    w.writerow(["id", "note", "tail, too"])
    for k in range(n):
        note = r.choice(["plain", 'say "hi"', "two\nlines", "a,b", "", "\n\n", '"', 'x"\n,"y', "é 日本", " lead"]) * r.choice([1, 1, 3])
        w.writerow([f"r{k}", note, r.choice(["z", "q\nq", "end"])])
    return out.getvalue()


@pytest.mark.parametrize("size", [64, 257, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_same_rows_as_one_split(spark, tmp_path, size, end):
    path = tmp_path / "one.csv"
    path.write_bytes(sample(size, 150, end).encode())
    got, meta, parts = by_ranges(spark, str(path), size)
    assert got == clean(one_split(spark, str(path))) and len(got) == 150
    assert meta["columns_raw"] == 3 and (parts > 8 or size > 1000)


def test_several_files_and_plain_lines(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_bytes(sample(k, 40).encode())
    assert by_ranges(spark, str(tmp_path), 100)[0] == clean(one_split(spark, str(tmp_path)))
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "a.csv").write_text("a,b\n1,\"x, y\"\n\n2,\"say \"\"hi\"\"\"\n3\n4,5,6\n")
    assert by_ranges(spark, str(plain), 8)[0] == [("1", "x, y"), ("2", 'say "hi"'), ("3", None)]


def test_a_field_longer_than_many_ranges(spark, tmp_path):
    path = tmp_path / "long.csv"
    text = "\n".join("line, of a long field" for _ in range(400))
    path.write_text(f'a,b\n1,"{text}"\n2,x\n3,"{text}\n')  # the last field is never closed
    got = by_ranges(spark, str(path), 200)[0]
    assert got == [("1", text), ("2", "x"), ("3", text + "\n")] or got == [("1", text), ("2", "x"), ("3", text)]


def test_latin_1(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("a,b\n1,\"é\nü\"\n2,ß\n".encode("latin-1"))
    got, meta, _ = by_ranges(spark, str(path), 6)
    assert meta["encoding"] == "ISO-8859-1" and got == [("1", "é\nü"), ("2", "ß")]


def automaton(text: bytes, quoted: bool) -> bool:
    """The same by one character at a time."""
    state = "Q" if quoted else "S"
    at = 0
    while at < len(text):
        c = text[at:at + 1]
        if state == "S":
            state = "Q" if c == b'"' else "S" if c in (b" ", b"\t", b",") else "U"
        elif state == "U":
            state = "S" if c == b"," else "U"
        elif c == b'"':
            if text[at + 1:at + 2] == b'"':
                at += 1
            else:
                state = "U"
        at += 1
    return state == "Q"


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='",a \t', max_size=20), st.booleans())
def test_transition_of_a_line(text, quoted):
    assert CS.ends_open(text.encode(), quoted) == automaton(text.encode(), quoted)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), min_size=1, max_size=9))
def test_functions_are_composed(spark, functions):
    states = spark.createDataFrame([("f", 10 * k, a, b, a, True) for k, (a, b) in enumerate(functions)], CS.STATES)
    got = {r.start: r.quoted for r in CS.range_starts(states).collect()}
    state = False
    for k, (a, b) in enumerate(functions):
        assert got[10 * k] == state
        state = b if state else a


def test_ingest_metadata(spark, tmp_path):
    (tmp_path / "up.csv").write_text("Order ID,Note\n1,\"a\nb\"\n2,c\n")
    r = CSV.ingest_metadata(spark, str(tmp_path / "up.csv")).first().asDict()
    assert r == {"file_name": "up.csv", "file_format": ".csv", "n_files": 1, "rows_before": 2, "columns_raw": 2, "original_columns": "Order ID, Note",
                 "normalized_columns": "order_id, note", "file_size_bytes": 26, "encoding": "UTF-8"}
    for text in ("a,b\n", "a,b\n\n", ""):
        (tmp_path / "none.csv").write_text(text)
        with pytest.raises(ValueError, match="no data"):
            CSV.ingest_metadata(spark, str(tmp_path / "none.csv"))
