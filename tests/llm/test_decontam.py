import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import decontam
from quillspark.llm.decontam import WuManber, contamination, contamination_digest, item_windows, words_of


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    words, hit, found = brute_words(text), set(), set()
    for item, t in items:
        own = brute_words(t)
        m = min(window, len(own))
        for at in range(len(own) - m + 1 if own else 0):
            for k in range(len(words) - m + 1):
                if words[k:k + m] == own[at:at + m]:
                    hit |= set(range(k, k + m))
                    found.add("null" if item is None else str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


WORD = st.sampled_from(["a", "b", "C", "é", "x1"])


@settings(max_examples=300, deadline=None)
@given(st.lists(WORD, max_size=40), st.lists(st.lists(WORD, max_size=6), max_size=5))
def test_search_finds_every_window(words, items):
    rows = [(k, " ".join(i)) for k, i in enumerate(items)]
    text = " ".join(words)
    spans, found = WuManber(item_windows(rows, 4)).search(words_of(text))
    hit = {p for a, b in spans for p in range(a, b)}
    want = brute(text, rows, 4)
    assert (len(words_of(text)), len(hit), len(found)) == want[:3]


LONG = " ".join(f"w{k}" for k in range(30))
ITEMS = [(1, LONG), (2, "Short item"), (3, ""), (4, None), (None, "null id words"), (5, "one"), (2, "Short item"), (10, " ".join(f"w{k}" for k in range(5, 20)))]
TEXTS = [None, "", "!!!", "nothing here", "x " + LONG.upper() + " y", "short, ITEM; short item", "a null id\nwords b one", "one" * 3,
         " ".join(f"w{k}" for k in range(9)), "w " * 50_000 + LONG, "ÉÀ one É"]


def digest(spark, texts, items):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: tuple(r)[1:] for r in contamination_digest(contamination(docs, bench)).collect()}


def test_edge_cases_in_one_block_and_in_many(spark, monkeypatch):
    want = {k: brute(t, ITEMS) for k, t in enumerate(TEXTS) if len(t or "") < 10_000}
    for chars in (decontam.BLOCK_CHARS, 60):
        monkeypatch.setattr(decontam, "BLOCK_CHARS", chars)
        got = digest(spark, TEXTS, ITEMS)
        assert {k: got[k] for k in want} == want
        assert got[9][0] == 50_030 and got[9][1] == 30 and got[9][2] == 2


def test_empty_tables_and_repeated_rows(spark):
    assert digest(spark, TEXTS, [])[4][1:3] == (0, 0)
    docs = spark.createDataFrame([(1, LONG), (1, LONG)], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [r.n_hit for r in contamination_digest(contamination(docs, bench)).collect()] == [30, 30]
    assert contamination(docs.limit(0), bench).count() == 0


def test_repeated_benchmark_rows_count_once_for_the_blocks(spark, monkeypatch):
    from quillspark.llm import decontam
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    items = spark.createDataFrame([(1, "a b c d")] * 300, "item_id long, text string")
    assert list(decontam.benchmark_blocks(items)) == [{(b"a", b"b", b"c", b"d"): {"1"}}]
