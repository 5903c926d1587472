import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, group string, leaf string, rank int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified by plain recursion."""

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k:k + 3]) for k in range(0, len(levels[-1]), 3)])
        return levels

    def way(levels, at):
        out = []
        for nodes in levels[:-1]:
            run = at - at % 3
            out.append((nodes[run:at], nodes[at + 1:run + 3]))
            at //= 3
        return out

    groups = {}
    for doc_id, text, lang, source, n in rows:
        leaf = h(enc(doc_id), enc(source), enc(lang), enc(n), enc(text))
        told = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, h(enc(doc_id), enc(source), enc(lang), enc(n), enc(told)), doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, claimed, doc_id) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            node, proof = claimed, ""
            for left, right in way(trees[s], at) + way(top, k):
                node = h(*left, node, *right)
                proof += "".join(left + right)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    told = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    out = merkle.verify_leaves(merkle.build_manifest(merkle.leaf_table(docs, told))).drop("proof")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def corpus(seed, n, ids, sources):
    r = random.Random(seed)
    return [(ids(r, k), r.choice([None, "", "a\nb", "é\n日本", "plain", "x" * 50]), r.choice([None, "en", ""]), r.choice(sources), r.choice([None, 3, -1]))
            for k in range(n)]


@pytest.mark.parametrize("rows", [
    [(5, "one", "en", "s", 3)],
    [(5, None, None, None, None), (6, "a\n", "", "", 2)],
    corpus(1, 40, lambda r, k: k, ["a", "b", None, "", "é"]),
    corpus(2, 60, lambda r, k: r.choice([None, 1, 1, 2, k, -k, 2**62 + k, -2**63, 2**63 - 1]), ["a", "a", None]),
    [(7, "same", "en", "s", 4)] * 11 + [(8, "b", None, "s", None)],
], ids=["one", "nulls", "groups", "repeated-ids", "equal-rows"])
def test_equals_plain_recursion(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_several_passes(spark):
    rows = corpus(3, 300, lambda r, k: 3 * k, ["hot", "hot", "hot", *[f"s{k}" for k in range(12)]])
    leaves = merkle.leaf_table(spark.createDataFrame([(*r, "", "", 1) for r in rows], SCHEMA))
    manifest = merkle.build_manifest(leaves, merkle.Slots(2))
    assert len(manifest.passes) > 2
    want = {r[0]: r for r in brute(rows)}
    for r in merkle.verify_leaves(manifest).collect():
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == want[r.doc_id][1:5] and r.verified


def test_empty_table_and_types(spark):
    assert found(spark, []) == []
    manifest = merkle.build_manifest(merkle.leaf_table(spark.createDataFrame([], SCHEMA)))
    assert manifest.root is None


def test_untold_text_verifies_everything(spark):
    docs = spark.createDataFrame([(*r, "", "", 1) for r in corpus(4, 30, lambda r, k: k, ["a", "b"])], SCHEMA)
    out = merkle.verify_leaves(merkle.build_manifest(merkle.leaf_table(docs)))
    for r in out.collect():
        assert r.verified and merkle.fold(r.leaf, r.proof) == r.root


IDS = st.lists(st.integers(0, 65535), min_size=1, max_size=300, unique=True)


@settings(max_examples=100, deadline=None)
@given(st.one_of(IDS, st.builds(lambda a, n: list(range(a, min(65536, a + n))), st.integers(0, 65000), st.integers(1, 70000)),
                 st.builds(lambda s: list(range(0, 65536, s)), st.integers(1, 40))))
def test_bitmaps_round_trip_and_rank(ids):
    lows = np.array(sorted(ids))
    bits = merkle.pack_bits(lows)
    assert merkle.unpack_bits(bits).tolist() == lows.tolist()
    asked = np.unique(np.concatenate([lows[:50], [0, 1, 63, 64, 40000, 65535]]))
    assert merkle.rank_in_chunk(bits, merkle.directory_of(lows), asked).tolist() == np.searchsorted(lows, asked).tolist()


def test_slots_of_any_size():
    for n in [1, 2, 3, 4, 9, 10, 27, 100, 2187]:
        leaves = [h(str(k)) for k in range(n)]
        order = np.random.default_rng(n).permutation(n)
        levels = merkle.Slots().filled(order, [leaves[k] for k in order], n)
        assert len(levels[-1]) == 1
        for slot in {0, n - 1, n // 2}:
            assert merkle.fold(leaves[slot], merkle.siblings(levels, slot)) == levels[-1][0]


def test_running_totals(spark):
    rows = [(k % 3, k, k * k) for k in range(100)]
    got = merkle.running_totals(spark.createDataFrame(rows, "g int, o int, v long"), ["g"], ["o"], F.col("v"), "t").collect()
    for r in got:
        same = [v for g, o, v in rows if g == r.g]
        assert r.before == sum(v for g, o, v in rows if g == r.g and o < r.o) and r.total == sum(same)
