import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import jaccard
from quillspark.llm.jaccard import Shingler, components, least_shared, overlaps, part_hashes, similar_documents, size_classes, spanning


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + 3]) for k in range(max(1, len(words) - 2)))


def brute(rows):
    """(doc_id, n, component) per row; rows that share an id are tied."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for j in range(i):
            b, t = sets[j]
            if a is None or b is None:
                continue
            inter = len(s & t)
            if (s and t and 100 * inter >= 90 * len(s | t)) or (a == b and s and t):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return Counter((d, len(s), least.get(find(i)) if d is not None else None) for i, (d, s) in enumerate(sets))


def got(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, label int")
    return Counter(tuple(r) for r in similar_documents(docs).collect())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(3)
    rows = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "one two three"),
            (1007, "One\ttwo three"), (None, "one two three"), (None, None), (1008, "a b c d"), (1009, "one two"), (1009, "one two")]
    k = 0
    for size in (4, 12, 19, 20, 40, 41, 80, 200, 700):
        base = [f"b{size}x{rng.randrange(10**6)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6):
            rows.append((k, edited(rng, base, edits)))
            k += 1
        rows.append((k, " ".join(base[:-1])))
        rows.append((k + 1, " ".join(base + ["more", "words"])))
        k += 2
    # A chain: each text a few words further than the last.
    chain = [f"c{j}" for j in range(120)]
    for step in range(0, 24, 3):
        rows.append((k, " ".join(chain[step:step + 90])))
        k += 1
    rows += [(5000, "x " * 30_000), (5001, "x " * 29_000), (4999, "x x x")]
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_small_groups_give_the_same_components(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{j}" for j in range(60)]
    rows = [(k, edited(rng, base, rng.choice((0, 1, 1, 2, 3)))) for k in range(90)]
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 300)  # chunks of 8, so that groups meet
    monkeypatch.setattr(jaccard, "BROADCAST_NODES", 0)
    assert got(spark, rows) == brute(rows)


def test_repeated_id_with_other_text_ties_components(spark):
    rows = [(1, "a b c d"), (5, "a b c d"), (5, "p q r s"), (7, "p q r s"), (9, "z z z")]
    assert got(spark, rows) == Counter([(1, 2, 1), (5, 2, 1), (5, 2, 1), (7, 2, 1), (9, 1, 9)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert similar_documents(docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 10**6), st.sampled_from([50, 80, 90]))
def test_linked_sets_share_a_part(n, differ, seed, threshold):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**63, 600, dtype=np.uint64)
    a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[differ // 2:n], pool[500:500 + differ - differ // 2]]))
    if not len(b):
        return
    inter = len(np.intersect1d(a, b))
    if 100 * inter >= threshold * (len(a) + len(b) - inter):
        ends = size_classes(2000)
        shared = set(part_hashes(a, ends, threshold)) & set(part_hashes(b, ends, threshold))
        assert len(shared) >= max(least_shared(len(a), ends, threshold), least_shared(len(b), ends, threshold)) >= 1


def test_overlaps_and_spanning():
    sets = [np.array(s, dtype=np.uint64) for s in ([1, 2, 3], [2, 3, 4], [9], [])]
    assert overlaps(sets, sets).tolist() == [[3, 2, 0, 0], [2, 3, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]]
    assert spanning(np.array([[0, 1], [1, 2], [0, 2], [3, 4]]), np.array([7, 8, 9, 5, 5])) == [(0, 1), (1, 2)]
    assert [s.tolist() for s in Shingler().sets(["", None])] == [[], []]


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7)], [(k, k + 1) for k in range(40)], [(50, k) for k in range(20)]])
def test_components_of_links(spark, edges):
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert found == label


def test_thresholds_beyond_the_size_classes_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for threshold in (50, 66, 101):
        with pytest.raises(ValueError):
            similar_documents(docs, threshold)


def test_nodes_meet_few_groups_of_a_large_cluster(spark, monkeypatch):
    """Edited copies that link with nothing are settled by their own tokens, and a large component does not ask its many groups."""
    rng = random.Random(8)
    base = [f"b{j}" for j in range(150)]
    rows = [(k, edited(rng, base, rng.choice((0, 1, 1, 1, 4, 5, 6)))) for k in range(260)]
    rows_of, write = {}, jaccard.stored

    def counted(df, label):
        out = write(df, label)
        rows_of[label] = out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 1200)  # chunks of 8
    assert got(spark, rows) == brute(rows)
    assert rows_of["meetings"] <= 8 * len(rows)


def test_partner_sizes_keep_every_link(spark):
    rng = random.Random(9)
    sets = {k: sorted(rng.sample(range(60), rng.randrange(30, 60))) + [1000 * (k + 1) + j for j in range(rng.randrange(4))] for k in range(60)}
    nodes = spark.createDataFrame([(k, k % 17, len(s), s) for k, s in sets.items()], "node long, component long, n long, tokens array<long>")
    sides = {r.node: r for r in jaccard.partner_sizes(nodes, 80).collect()}
    links = [(a, b) for a in sets for b in sets if a % 17 != b % 17
             and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))]
    assert links and all(sides[a].least <= len(sets[b]) <= sides[a].most for a, b in links)
