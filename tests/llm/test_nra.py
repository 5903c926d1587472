import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import nra

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    """Every document scored for every query."""
    held = [(d, Counter(terms_of(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    rows = []
    for item, text in set(items):
        scored = []
        for d, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in set(terms_of(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d))
        rows += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(rows, key=repr)


def found(spark, docs, items, k, docs_type="doc_id long, text string, score long, query int"):
    d = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], docs_type)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in nra.ranked_search(d, i, k).collect()), key=repr)


WORDS = ["The", "the", "fox", "über", "10", "日本", "a", "zebra", "lake", "hill", "é"]


def corpus(seed, n):
    r = random.Random(seed)
    return [(r.choice([k, k, k, 7, None]), None if r.random() < 0.03 else r.choice([" ", ", ", "[", "\n"]).join(r.choices(WORDS, k=r.choice([0, 1, 3, 8, 40]))))
            for k in range(n)]


ITEMS = [(1, "the fox"), (2, "zebra zebra LAKE é"), (3, None), (4, "..."), (5, "nowhere"), (6, "日本 10 hill a the"), (6, "fox"), (1, "the fox"), (None, "lake")]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_equals_scoring_every_document(spark, k):
    docs = corpus(1, 300)
    assert found(spark, docs, ITEMS, k) == brute(docs, ITEMS, k)


def test_ties_nulls_and_long_texts(spark):
    docs = [(k, "same text here") for k in range(40, 0, -1)] + [(None, "same text here"), (None, None), (99, ""), (5, "same text here"),
                                                              (100, "here " * 200_000 + "same")]
    items = [(1, "same here"), (2, "text")]
    assert found(spark, docs, items, 10) == brute(docs, items, 10)
    assert found(spark, docs, items, 100) == brute(docs, items, 100)


def test_empty_tables(spark):
    assert found(spark, [], ITEMS, 5) == [] and found(spark, [(1, "a b")], [], 5) == [] and found(spark, [(1, "..."), (2, None)], ITEMS, 5) == []


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    docs = corpus(2, 120)
    monkeypatch.setattr(nra, "BLOCK_CHARS", 12)
    assert found(spark, docs, ITEMS, 4) == brute(docs, ITEMS, 4)


def test_column_types_of_the_result(spark):
    out = nra.ranked_search(spark.createDataFrame([(1, "a")], "doc_id int, text string"), spark.createDataFrame([("x", "a")], "item_id string, text string"))
    assert dict(out.dtypes) == {"item_id": "string", "rank": "int", "doc_id": "bigint", "score": "bigint"}


POSTINGS = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 30), st.integers(0, 4)), max_size=120)


@settings(max_examples=200, deadline=None)
@given(POSTINGS, st.integers(1, 12), st.integers(1, 8), st.integers(0, 9))
def test_a_shard_resolves_membership_ties_and_scores(postings, k, first_read, least):
    lists = {(t, d): s for t, d, s in postings}
    shard = nra.Shard(31, 6, *(np.array(x, dtype=np.int64) for x in zip(*((t, d, s) for (t, d), s in lists.items()))) if lists
                      else (np.empty(0, np.int64),) * 3)
    before, nra.FIRST_READ = nra.FIRST_READ, first_read
    try:
        docs, scores = shard.search(np.arange(0, 6, 2), k, least)
    finally:
        nra.FIRST_READ = before
    total = Counter()
    for (t, d), s in lists.items():
        total[d] += s * (t % 2 == 0)
    want = sorted(((-s, d) for d, s in total.items() if s >= max(least, 1)))[:k]
    assert [(-s, d) for d, s in zip(docs.tolist(), scores.tolist())] == want


def test_reading_stops_early():
    n = 5000
    docs = np.concatenate([np.arange(n), np.arange(n)])
    terms = np.repeat([0, 1], n)
    impacts = np.concatenate([np.arange(n), np.arange(n)]) ** 2
    shard = nra.Shard(n, 2, terms, docs, impacts)
    read = []
    shard.docs = type("Seen", (np.ndarray,), {"__getitem__": lambda self, at: (read.append(np.size(at)), np.ndarray.__getitem__(self, at))[1]})(
        shape=shard.docs.shape, dtype=shard.docs.dtype, buffer=shard.docs.copy())
    assert shard.search(np.array([0, 1]), 10, 0)[0].tolist() == list(range(n - 1, n - 11, -1))
    assert sum(read) < n


def test_statistics_count_all_documents():
    impacts = nra.Impacts(10, 100, np.array([1, 10]))
    assert impacts.weights.tolist() == [math.floor(1000 * math.log(22 / 3)), math.floor(1000 * math.log(22 / 21))]
