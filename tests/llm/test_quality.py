import zlib

import numpy as np

from quillspark.llm.quality import Settings, WordTable, document_features, op5_quality_classifier, quality_scores, word_shape

JUNK = ["BUY!! NOW!! CHEAP!! STUFF!!", "a | b | c | d | e", "spam spam spam spam spam", "x*** y### z%%% w&&&"]


def documents(n):
    rng = np.random.default_rng(4)
    words = np.array([f"{a}{b}{c}" for a in ("an", "er", "th") for b in ("in", "on", "e") for c in ("es", "ly", "t")])
    good = [(2 * k, " ".join(rng.choice(words, 40)) + ".", 1) for k in range(n)]
    return good + [(2 * k + 1, " ".join(rng.choice(JUNK, 6)), 0) for k in range(n)]


def test_separates_classes_without_seeing_the_held_out(spark):
    rows = documents(150)
    docs = spark.createDataFrame([(d, t, "en", "s", 0.5) for d, t, _ in rows] + [(None, None, None, None, None), (900, "", "", "", 1.0), (901, "w " * 100_000, "", "", 0.0), (901, "w", "", "", 0.0)],
                                 "doc_id long, text string, label string, quality string, score double")
    labels = spark.createDataFrame([(d, q, None) for d, _, q in rows] + [(None, 1, 1), (902, 1, 0), (0, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == 304 and all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {d: q for d, _, q in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and r.held_out]) >= 0.97
    flipped = spark.createDataFrame([(d, 1 - q if zlib.crc32(str(d).encode()) % 3 == 1 else q, 0) for d, _, q in rows], labels.schema)
    clean = labels.filter("doc_id < 300 and quality in (0, 1)")
    assert sorted(map(tuple, quality_scores(docs.filter("doc_id < 300"), clean).collect())) == sorted(map(tuple, quality_scores(docs.filter("doc_id < 300"), flipped.join(clean.select("doc_id"), "doc_id", "left_semi")).collect()))
    assert quality_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality_scores(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_scores_equal_the_mean_of_feature_weights():
    from quillspark.llm.quality import _scores
    s = Settings(buckets=512)
    weights = np.random.default_rng(1).normal(size=512)
    texts = ["", "one", "one one two", "Ab!! c | d e%", "ü ñ " * 50]
    got = _scores(texts, WordTable(s, weights), weights, 0.3)
    for t, p in zip(texts, got):
        features, times = document_features(t, WordTable(s))
        mean = (weights[features] * times).sum() / max(1, times.sum())
        assert abs(p - 1 / (1 + np.exp(-(mean + 0.3)))) < 1e-9
    assert word_shape("ABC!!") == "A!" and word_shape("Abc12") == "Aa0"


def test_op5_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in op5_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in quality]
    for label in (0, 1):
        assert np.mean([r.predicted == label for r in held if quality[r.doc_id] == label]) >= 0.9


def test_long_words_have_all_grams_and_the_whole_shape():
    from quillspark.llm import quality
    s = Settings()

    def buckets(word):
        return np.concatenate([np.asarray(b) for b in quality.word_features(word, s)]).tolist()

    for word in ("x1ü日😀-" * 40, "a" * 61, "Ab9" * 200):
        marked = f"<{word}>"
        grams = [marked[i:i + n] for n in s.char_grams for i in range(len(marked) - n + 1)]
        want = [quality._hash(g) % s.buckets for g in ["w" + marked, "s" + word_shape(word), *grams]]
        assert buckets(word) == want
    assert buckets("a1" * 150 + "!")[1] != buckets("a1" * 150 + "?")[1]


def test_gram_blocks_leave_no_gram_out(monkeypatch):
    from quillspark.llm import quality
    whole = np.concatenate(list(quality.long_grams("日本x語" * 50, 3, 1 << 17)))
    monkeypatch.setattr(quality, "GRAM_BLOCK", 7)
    assert np.concatenate(list(quality.long_grams("日本x語" * 50, 3, 1 << 17))).tolist() == whole.tolist()


def test_training_sees_all_features_of_a_row(spark):
    from quillspark.llm.quality import training_bags
    text = " ".join(f"word{k}" for k in range(700)) + " " + "長" * 90 + "語" * 90
    docs = spark.createDataFrame([(0, text), (1, "short text")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    bags, y = training_bags(docs, labels, Settings())
    for (features, times), want in zip(bags, (text, "short text")):
        f, t = document_features(want, WordTable(Settings()))
        assert features.tolist() == f.tolist() and times.tolist() == t.tolist()
    assert y.tolist() == [1, 0]


def test_many_rows_of_one_id_are_reduced_before_they_are_collected(spark, monkeypatch):
    from quillspark.llm import quality
    counts, keep = [], quality.stored

    def counted(df, label):
        out = keep(df, label)
        counts.append(out.count())
        return out

    monkeypatch.setattr(quality, "stored", counted)
    docs = spark.createDataFrame([(0, f"text {k % 9}") for k in range(500)] + [(1, "other")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    first, y = quality.training_bags(docs, labels, Settings())
    again, _ = quality.training_bags(docs.repartition(2), labels, Settings())
    assert counts == [2, 2] and y.tolist() == [1, 0]
    assert [f.tolist() for f, _ in first] == [f.tolist() for f, _ in again]


def test_training_features_take_four_bytes_each():
    from quillspark.llm.quality import Settings, WordTable, document_features, word_features
    s, table = Settings(), WordTable(Settings())
    text = "one two one " + "x" * 100
    bags, times = document_features(text, table)
    want = {}
    for w in text.split():
        for block in word_features(w, s):
            for b in block:
                want[int(b)] = want.get(int(b), 0) + 1
    pairs = table.pairs(table.ids(text.split()))
    for b in pairs.tolist():
        want[b] = want.get(b, 0) + 1
    assert dict(zip(bags.tolist(), times.tolist())) == want
    assert table.features.itemsize == 4 and len(table.features) == sum(table.sizes)
