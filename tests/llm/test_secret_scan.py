import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm.secret_scan import (BASE_RULES, Rule, read_ledger, redact_documents, scan_versions, secret_digest)

ASSIGN = re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
HEX = "0123456789abcdef" * 3
TEXTS = ["", None, "no secrets here", 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', "AKIA" + "A1" * 8, "AKIAAKIA" + "B" * 11,
         "AKIA123", "é̀😀 password:abcdefgh", "PassWd='short' SECRET : long-enough/value==", "secret:token: abcdefghijk", "api_key=12345678apikey = 87654321",
         HEX + "g" + HEX[:31] + "G" + HEX[:32], "token:=abcdefgh token==abcdefgh", "ſecret=abcdefgh toKen=abcdefgh", "x" * 200_000 + " token=abcdefgh " + "y" * 1000,
         "token=" + HEX, "token = abcdefgh " * 400]


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    spans.sort()
    line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    kinds = [k for *_, k in spans]
    return (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(line.encode()).hexdigest(), line)


def scan(spark, texts, ledger):
    versions = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "path long, content string, blob string")
    return {r.doc_id: tuple(r)[1:] for r in secret_digest(scan_versions(versions, ledger)).collect()}


def test_spans_of_edge_cases(spark, tmp_path):
    got = scan(spark, TEXTS, str(tmp_path / "ledger"))
    for k, t in enumerate(TEXTS):
        assert got[k] == brute(t), t


def test_spans_of_any_text(spark, tmp_path):
    texts = []

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(["token", "Secret", "api_key", "passwd", "AKIA", "A1B2", "=", ":", " ", '"', "'", "abcdefgh", "0af9" * 5, "é", "😀", "-", ".\n"]),
                    max_size=25).map("".join))
    def gather(text):
        texts.append(text)

    gather()
    got = scan(spark, texts, str(tmp_path / "ledger"))
    assert [got[k] for k in range(len(texts))] == [brute(t) for t in texts]


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    schema = "path string, content string"
    first = spark.createDataFrame([("a/1", "token=abcdefgh"), ("a/2", "token=abcdefgh"), (None, None), (None, None), ("b", "clean")], schema)
    got = scan_versions(first, ledger).collect()
    assert sorted((str(r.path), len(r.findings)) for r in got) == [("None", 0), ("None", 0), ("a/1", 1), ("a/2", 1), ("b", 0)]
    assert read_ledger(spark, ledger).count() == 3 * len(BASE_RULES)  # blobs, not paths
    second = first.unionByName(spark.createDataFrame([("c", "clean"), ("d", "AKIA" + "Z" * 16)], schema))
    assert {r.path: len(r.findings) for r in scan_versions(second, ledger).collect()}["d"] == 1
    assert read_ledger(spark, ledger).count() == 4 * len(BASE_RULES)
    more = (*BASE_RULES, Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1))
    scan_versions(second, ledger, more)
    assert read_ledger(spark, ledger).count() == 4 * len(more)  # only the new rule was scanned
    assert scan_versions(first.limit(0), ledger).count() == 0


def test_added_kinds_leave_the_base_digest(spark, tmp_path):
    versions = spark.createDataFrame([("p", "-----BEGIN PRIVATE KEY----- token=abcdefgh")], "path string, content string")
    rules = (*BASE_RULES, Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1))
    r = secret_digest(scan_versions(versions, str(tmp_path / "l"), rules), rules).first()
    assert r.spans == "pem:0:27,assign:28:42" and r.base_sha256 == hashlib.sha256(b"assign:28:42").hexdigest()


def test_redaction(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a token=" + HEX + " b AKIA" + "Q" * 16, 5, "x"), (2, None, 0, "y"), (3, "é fine", 6, None), (None, "secret=12345678", 15, "")],
                                 "doc_id long, text string, n_chars long, blob string")
    got = {r.doc_id: r for r in redact_documents(docs, str(tmp_path / "l")).collect()}
    assert got[1].text == "a [REDACTED] b [REDACTED]" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "é fine" and got[3].n_chars == 6 and got[None].text == "[REDACTED]"


def test_main_path_is_native(spark, tmp_path):
    versions = spark.createDataFrame([(1, "token=abcdefgh")], "path long, content string")
    plan = secret_digest(scan_versions(versions, str(tmp_path / "l")))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert F is not None
