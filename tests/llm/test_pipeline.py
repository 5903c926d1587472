import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from quillspark.llm.tokens import WORD_VOCABULARY, vocabulary_path

from .test_decontam import brute as brute_windows
from .test_jaccard import brute as brute_components
from .test_secret_scan import brute as brute_secrets


def masked(text):
    spans = [s.split(":")[1:] for s in brute_secrets(text)[4].split(",") if s]
    out, at = "", 0
    for a, b in ((int(a), int(b)) for a, b in spans):
        if a >= at:
            out += text[at:a] + "[REDACTED]"
        at = max(at, b)
    return out + text[at:]


def test_stages_and_result_against_brute_force(spark, small, monkeypatch):
    seen = []

    def watch(name, stage):
        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            assert len(corpus_pipeline.STAGES) == len(seen) + 1 or out.columns == docs.columns or name == "packing"
            seen.append((name, docs.collect()))
            return out
        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watch(n, f)) for n, f in corpus_pipeline.STAGES])
    rows = corpus_pipeline.run(spark, small).collect()
    names, inputs = zip(*seen)
    assert names == ("quality", "near_duplicates", "decontamination", "secrets", "packing")
    docs, scored, unique, clean, safe = inputs

    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r.doc_id for r in scored}
    assert np.mean([(d.doc_id in kept) == (quality[d.doc_id] == 1) for d in docs if d.doc_id in quality]) >= 0.9
    component = {d: c for d, _, c in brute_components([(r.doc_id, r.text) for r in scored])}
    assert sorted(r.doc_id for r in unique) == sorted(d for d, c in component.items() if d == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    windows = {tuple(w) for w in _windows(items)}
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in unique if not _contaminated(r.text, windows))
    assert {r.doc_id: r.text for r in safe} == {r.doc_id: masked(r.text) for r in clean}
    assert all(r.n_chars == len(r.text) for r in safe if "[REDACTED]" in r.text)

    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(vocabulary_path(WORD_VOCABULARY))
    want = Counter()
    for r in safe:
        ids = plain.encode(r.text, add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at:at + 2048], dtype="<u4")
            want[(r.doc_id, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


def _windows(items):
    from .test_decontam import brute_words
    for _, text in items:
        words = brute_words(text)
        m = min(10, len(words))
        yield from (words[k:k + m] for k in range(len(words) - m + 1 if words else 0))


def _contaminated(text, windows):
    from .test_decontam import brute_words
    words = brute_words(text)
    sizes = {len(w) for w in windows}
    return any(tuple(words[k:k + m]) in windows for m in sizes for k in range(len(words) - m + 1))


def test_edge_rows_pass_every_stage(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (None, "some text here", "en", None, 14), (3, "some text here and more", "en", "s", 23),
            (3, "some text here and more", "en", "s", 23), (4, "Some text here and more", "en", "s", 23), (5, "the bench item", "en", "s", 14), (6, "x token=abcdefgh", "en", "s", 16)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "Bench item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "6", "None"]
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_brute_force_helper_agrees():
    assert brute_windows("a b", [(1, "b")])[:3] == (2, 1, 1)


def test_unrelated_texts_of_one_id_stay(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    other = [f"text {k} has words of its own {k * 7} {k * 11}" for k in range(6)]
    rows = [(1, t) for t in other] + [(1, other[0]), (2, other[1]), (0, other[2]), (3, ""), (3, ""), (3, None), (4, ""), (None, other[3]), (None, other[3])]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], schema)
    want = Counter([(1, t) for t in other if t != other[2]] + [(0, other[2]), (3, ""), (3, None), (4, ""), (None, other[3]), (None, other[3])])
    for parts in (1, 5):
        got = corpus_pipeline.near_duplicates(spark, docs.repartition(parts), "").collect()
        assert Counter((r.doc_id, r.text) for r in got) == want
