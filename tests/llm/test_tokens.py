import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import tokens
from quillspark.llm.packing import (best_fit, length_patterns, op2_best_fit_packing, pack_documents, pack_histogram,
                                    plan_slots)
from quillspark.llm.token_hist import length_histogram, length_quantile, op6_token_counts, truncated_total
from quillspark.llm.token_orc import ids_digest, op8_token_orc, read_token_orc, write_token_orc
from quillspark.llm.tokens import BYTE_VOCABULARY, WORD_VOCABULARY, TextEncoder, vocabulary_path

PATHS = [vocabulary_path(WORD_VOCABULARY), vocabulary_path(BYTE_VOCABULARY)]
ENCODERS = {p: TextEncoder(p) for p in PATHS}
TEXTS = ["", "a", "Hello, World!", "a\tb  c\n\n d", "  x", "x  ", "\n", "don't 'tis l'été D'ACC ''x' 's",
         "a \n b", "a\n b", "é combining", "ª º µ × ÷ ß ÿ Ÿ", "\x85 \x1c 　 ﻿", "<|endoftext|> <|startoftext|>",
         "日本語 mixed текст", "%%%&&& a1b2 12,345.6", "İstanbul ǅ ſ K", "very " * 3000]


def plain(path, text):
    return ENCODERS[path].tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", PATHS)
def test_memoised_ids_equal_plain_encoding(path):
    for _ in range(2):  # the second time from the memo
        for t in TEXTS:
            assert np.frombuffer(ENCODERS[path].encode(t), "<u4").tolist() == plain(path, t), t


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abÀéß'’ \n\t.,!|%1239sStTdlLmre-́\x85ñ"), max_size=40))
def test_memoised_ids_equal_plain_encoding_of_any_text(text):
    for path in PATHS:
        assert np.frombuffer(ENCODERS[path].encode(text), "<u4").tolist() == plain(path, text)


@pytest.mark.parametrize("path", PATHS)
def test_special_token_strings_equal_a_fresh_tokenizer(path):
    from tokenizers import Tokenizer
    fresh = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a<|startoftext|>b c", "x y\n<|endoftext|><|endoftext|>  z", "<|ENDOFTEXT|> a", "<|endoftext |> a", *TEXTS]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(ENCODERS[path].encode(t), "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids, t
    assert 50256 in fresh.encode(texts[0]).ids or 49407 in fresh.encode(texts[0]).ids


def test_words_are_found_by_one_lookup_and_ends_by_their_letters():
    enc = TextEncoder(PATHS[1])
    enc.encode("one two, three. two")
    assert isinstance(enc.words.get("two"), bytes)
    misses = []
    enc.words.encode = misses.append  # every word is known by now: none is encoded again
    assert np.frombuffer(enc.encode("one two, three. two"), "<u4").tolist() == plain(PATHS[1], "one two, three. two")
    assert misses == [] and "three" in enc.words


def counted(path):
    """An encoder and the list of the calls that reach the library."""
    enc, calls = TextEncoder(path), []
    merge, ids = enc._merge, enc._ids
    enc._merge = lambda letters, space: calls.append(letters) or merge(letters, space)
    enc._ids = lambda text: calls.append(text) or ids(text)
    return enc, calls


def test_words_around_line_feeds_are_known_words():
    enc, calls = counted(PATHS[1])
    for t in ("x one two.\nThree four", "x five\n\nSix two.", "x one\n"):
        enc.encode(t)
    calls.clear()
    for t in ("x four\nThree one\nSix two.\nThree", "x five\n\nThree", "x two.\nSix\n\nSix", "x four\n"):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == plain(PATHS[1], t), t
    assert calls == []
    for t in ("x one\n\n", "\n\nThree", "\nThree", "x one\n\n\nThree", " \nThree", "x \nThree\n four"):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == plain(PATHS[1], t), t


@pytest.mark.parametrize("path", PATHS)
def test_words_met_once_leave_room_for_frequent_ones(path, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 60)
    monkeypatch.setattr(tokens, "MEMO_ANY", 20, raising=False)
    monkeypatch.setattr(tokens, "RECENT", 10, raising=False)
    enc, calls = counted(path)
    letters = "abcdefghijklmnopqrst"
    rare = [a + b + c for a in letters for b in letters for c in "uvwxyz"]
    frequent = ["often" + a for a in letters]
    for k in range(0, len(rare), 20):  # words met once, and among later ones the frequent words
        text = " ".join(["x", *rare[k:k + 20], *(frequent if k >= 400 else [])])
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain(path, text)
    calls.clear()
    assert np.frombuffer(enc.encode(" ".join(["x", *frequent])), "<u4").tolist() == plain(path, " ".join(["x", *frequent]))
    assert calls == [] and len(enc.words) <= 60


def test_a_worker_holds_one_large_table():
    from quillspark.llm import common
    first = tokens.encoder(PATHS[0])
    assert tokens.encoder(PATHS[0]) is first
    tokens.encoder(PATHS[1])
    assert list(common._HELD) == [PATHS[1]]
    common.release()
    assert not common._HELD and tokens.encoder(PATHS[0]) is not first


def rows(spark, schema):
    data = [(k, t, "en", "x", "y") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None, None), (None, "null id", None, None, None),
                                                                   (99, None, "de", "", ""), (2, "other text, same id", None, None, None)]
    return spark.createDataFrame(data, schema)


def expected(path, docs):
    return [(r.doc_id, plain(path, r.text or "") + [0]) for r in docs.collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_orc_round_trip(spark, docs_schema, tmp_path):
    docs = rows(spark, docs_schema)
    write_token_orc(docs.repartition(5), str(tmp_path / "ids"), PATHS[1])
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in ids_digest(read_token_orc(spark, str(tmp_path / "ids"))).collect()]
    want = expected(PATHS[1], docs)
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((d, len(i), crc(i)) for d, i in want)
    got.sort(key=lambda r: r[1])
    assert [g[1] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]  # gapless
    assert [g[0] for g in got] == sorted((g[0] for g in got), key=lambda d: -1 if d is None else d)
    ids = {r.doc_id: list(r.ids) for r in read_token_orc(spark, str(tmp_path / "ids")).filter("doc_id = 7").collect()}
    assert ids == {7: plain(PATHS[1], TEXTS[7]) + [0]}


def test_orc_predicate_reaches_the_files(spark, docs_schema, tmp_path):
    write_token_orc(rows(spark, docs_schema), str(tmp_path / "ids"), PATHS[1])
    plan = read_token_orc(spark, str(tmp_path / "ids")).filter("doc_id = 7")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(doc_id,7)" in plan


def test_orc_empty(spark, docs_schema, tmp_path):
    write_token_orc(spark.createDataFrame([], docs_schema), str(tmp_path / "ids"), PATHS[1])
    assert ids_digest(read_token_orc(spark, str(tmp_path / "ids"))).count() == 0


def test_op8_against_plain_encoding(spark, small):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op8_token_orc(spark, small).collect())
    at, want = 0, []
    for doc, text in sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()):
        ids = plain(PATHS[1], text) + [0]
        want.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want


def test_histogram(spark, docs_schema):
    docs = rows(spark, docs_schema)
    sizes = np.array([len(i) for _, i in expected(PATHS[1], docs)])
    hist = length_histogram(docs, PATHS[1])
    for r in hist.collect():
        n = r.n_tokens
        assert r.n_docs == (sizes == n).sum() and r.docs_le == (sizes <= n).sum() and r.docs_gt == (sizes > n).sum()
        assert r.tokens_le == sizes[sizes <= n].sum() and r.tokens_gt == sizes[sizes > n].sum()
        assert r.truncated_tokens == np.minimum(sizes, n).sum()
        assert r["quantile"] == pytest.approx((sizes <= n).mean())
    for limit in (1, 5, 1000, 10**6):
        t = truncated_total(hist, limit).first()
        assert (t.tokens_kept, t.docs_cut) == (np.minimum(sizes, limit).sum(), (sizes > limit).sum())
        assert t.tokens_lost == np.maximum(sizes - limit, 0).sum() and t.docs_whole == (sizes <= limit).sum()
    for q in (0.01, 0.5, 0.9, 1.0):
        assert length_quantile(hist, q).first()[0] == min(n for n in sizes if (sizes <= n).mean() >= q)
    empty = length_histogram(docs.limit(0), PATHS[1])
    assert empty.count() == 0 and truncated_total(empty, 5).first().tokens_kept == 0


def test_op6_counts_all_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = Counter(len(plain(PATHS[1], r.text or "")) + 1 for r in docs.collect())
    assert {r.n_tokens: r.n_docs for r in op6_token_counts(spark, small).collect()} == dict(sizes)


def check_packing(got, want, capacity):
    """got: rows of pack_documents; want: (doc_id, ids) of every document."""
    pieces = Counter()
    for doc, ids in want:
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            pieces[(doc, k, at, len(part), crc(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_edge_cases(spark, docs_schema):
    docs = rows(spark, docs_schema)
    check_packing(pack_documents(docs.repartition(4), PATHS[0], 64).collect(), expected(PATHS[0], docs), 64)
    assert pack_documents(docs.limit(0), PATHS[0], 64).count() == 0


def test_op2_packs_within_two_percent_of_the_bound(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = [(r.doc_id, plain(PATHS[0], r.text or "") + [0]) for r in docs.collect()]
    used = check_packing(op2_best_fit_packing(spark, small).collect(), want, 2048)
    assert used <= 1 + 1.02 * sum(len(i) for _, i in want) / 2048


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), max_size=30))
def test_plans_use_up_the_histogram(histogram):
    plan = pack_histogram(histogram, 40)
    used = Counter()
    for pattern, repeats in plan:
        assert sum(pattern) <= 40 and repeats > 0
        for length in pattern:
            used[length] += repeats
    assert used == Counter(histogram)
    if histogram:
        length, first, sequence, offset = plan_slots(plan)
        assert set(zip(length.tolist(), first.tolist())) >= {(k, 0) for k in histogram}


def test_patterns_fill_a_sequence():
    lengths = np.array([3, 5, 7, 10, 20])
    found = {tuple(p) for p in length_patterns(lengths, 20).tolist()}
    assert found == {(20, 0, 0), (10, 10, 0), (10, 7, 3), (10, 5, 5)}
    assert dict(best_fit(np.array([0, 0, 0, 4]), 7)) == {(3, 3): 2}


def test_patterns_carry_the_bulk_of_a_large_histogram():
    rng = np.random.default_rng(0)
    histogram = Counter(np.clip(rng.lognormal(5.5, 0.8, 400_000), 1, 2048).astype(int).tolist())
    plan = pack_histogram(dict(histogram), 2048)
    tokens = sum(k * n for k, n in histogram.items())
    assert sum(r for _, r in plan) <= 1.01 * tokens / 2048 + 1
    assert len(plan) < 60_000  # bounded by the capacity, not by the number of pieces
