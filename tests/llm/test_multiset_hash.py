import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import multiset_hash as M

SCHEMA = "doc_id long, text string, rank int, h string, block int, vector string"


def edited(text, following):
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def query(spark, docs):
    rows = spark.createDataFrame([(d, t, 1, "x", 2, "y") for d, t in docs], SCHEMA)
    found = M.edited_fingerprints(rows)
    near = lambda o: M.likeness(F.col("own.vector"), F.col(f"{o}.vector"), (F.col("own.norm"), F.col(f"{o}.norm")))
    return found.select("doc_id", "n_chars", "edited_sha256", M.fingerprint(F.col("own.vector")).alias("fingerprint"),
                        M.fingerprint(F.col("edited.vector")).alias("edited_fingerprint"), M.fingerprint(F.col("next.vector")).alias("next_print"),
                        near("edited").alias("near_edited"), near("next").alias("near_next"))


def corpus(seed, n, ids=lambda r, k: k):
    r = random.Random(seed)
    lines = ["one line. two sentences.", "é 日本。語", "", "plain words only", "x" * 300, "a b? c! d."]
    return [(ids(r, k), r.choice([None, "", "\n", "\n".join(r.choices(lines, k=r.choice([1, 2, 9]))) + str(r.random())])) for k in range(n)]


def check(spark, docs):
    order = sorted(docs, key=lambda d: -d[0])
    want = sorted((d, len(t or ""), hashlib.sha256(edited(t or "", order[(k + 1) % len(order)][1] or "").encode()).hexdigest()) for k, (d, t) in enumerate(order))
    got = query(spark, docs).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    texts = {d: t or "" for d, t in docs}
    prints = {}
    for r in got:
        key = tuple(sorted(texts[r.doc_id].split("\n")))
        assert prints.setdefault(key, r.fingerprint) == r.fingerprint
        assert (r.near_edited == 1) or r.fingerprint != r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(set(prints.values())) == len(prints)  # other multisets, other fingerprints
    by_id = {r.doc_id: r.fingerprint for r in got}
    for k, (d, _) in enumerate(order):
        assert next(r.next_print for r in got if r.doc_id == d) == by_id[order[(k + 1) % len(order)][0]]


def test_edited_texts_in_one_block(spark):
    check(spark, corpus(1, 60))


def test_edited_texts_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BYTES", 700)
    check(spark, corpus(2, 80, lambda r, k: (k - 40) * 2 ** 55))


@pytest.mark.parametrize("docs", [[(3, "only one.")], [(2, None), (1, "")], [(2**63 - 1, "a\nb"), (-2**63 + 1, "b\na"), (0, "c")]], ids=["one", "empty", "ends"])
def test_small_tables(spark, docs):
    check(spark, docs)


def test_empty_table(spark):
    assert query(spark, []).count() == 0


def test_hot_ids_and_copies_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BYTES", 400)
    r = random.Random(3)
    docs = ([(7, f"text {r.random()}.") for _ in range(60)] + [(7, "the same text.")] * 50 + [(None, "no id")] * 40 + [(k, f"own {k}") for k in range(20)])
    rows = spark.createDataFrame([(d, t, 1, "x", 2, "y") for d, t in docs], SCHEMA)
    blocks = M.in_blocks(rows).groupBy(*M.PLACE).count().collect()
    assert max(b["count"] for b in blocks) <= 50 and len({(b["sub"], b["part"], b["piece"]) for b in blocks}) > 4
    # Each row's next one is the next in the order of (id, text hash), whatever block it stands in.
    placed = M.in_blocks(rows).select("rank", "h", "text").collect()
    order = sorted(placed, key=lambda x: (x["rank"], x["h"]))
    want = sorted((a.text, b.text) for a, b in zip(order, order[1:] + order[:1]))
    got = sorted((x.text, x.next_text) for x in M.with_next(rows).filter(~F.col("copied")).collect())
    assert got == want


def vectors(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    return M.text_vectors(rows, ["k"], "t")


def test_sums_are_independent_of_order_and_can_be_undone(spark):
    made = vectors(spark, ["a.\nb c. d.\ne", "e\na.\nb c. d.", "a.\ne", "b c. d.", "a."]).collect()
    v = {r.k: r.vector for r in made}
    assert v[0] == v[1] and v[0] != v[2]
    wide = vectors(spark, ["a.\nb c. d.\ne", "a.\ne", "b c. d."]).groupBy().pivot("k", [0, 1, 2]).agg(F.first("vector"))
    sums = wide.select(M.add_vectors(F.col("1"), F.col("2")).alias("sum"), M.subtract_vectors(F.col("0"), F.col("2")).alias("rest"), "0", "1").first()
    assert sums["sum"] == sums["0"] and sums["rest"] == sums["1"]


def test_vector_of_a_paragraph_is_its_digest(spark):
    v = vectors(spark, ["one paragraph"]).first().vector
    digest = hashlib.sha512(b"one paragraph").digest()
    assert list(v.identity) == [zlib.crc32(digest[4 * k:4 * k + 4]) for k in range(16)]
    assert v.n == 1 and {x & 0xFFFFFFFF for x in v.counts} | {x >> 32 for x in v.counts} == {0, 1} and 2 * len(v.counts) == M.SIGN_LANES


def test_likeness_follows_the_shared_part(spark):
    r = random.Random(5)
    line = lambda: " ".join(str(r.random())[2:8] for _ in range(8)) + "."
    base = [line() for _ in range(100)]
    texts = ["\n".join(base)] + ["\n".join(base[:n] + [line() for _ in range(100 - n)]) for n in (100, 90, 50, 0)]
    made = vectors(spark, texts).cache()
    base_of = made.filter("k = 0").select(F.col("vector").alias("a"))
    near = {x.k: x.n for x in made.filter("k > 0").join(F.broadcast(base_of)).select("k", M.likeness(F.col("a"), F.col("vector")).alias("n")).collect()}
    assert near[1] == 1 and abs(near[2] - 0.9) < 0.12 and abs(near[3] - 0.5) < 0.25 and near[4] < 0.3


def test_main_path_is_native(spark):
    plan = query(spark, [(1, "a. b"), (2, "c")])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
