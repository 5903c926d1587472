"""Exact distributed selection and qcut ranks against NumPy / pandas."""

import numpy as np
import pandas as pd
import pytest

from quillspark.functions.ranking import bucket_of, rank_cuts_many
from quillspark.functions.selection import quantiles, select_kth, select_kth_any


def test_select_kth_matches_sort(spark):
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.lognormal(2, 3, 3000), np.full(2000, 5.0), rng.integers(-50, 50, 1000).astype(float)])
    b = rng.normal(0, 1, 300)
    rows = [(0, float(x)) for x in a] + [(1, float(x)) for x in b]
    df = spark.createDataFrame(rows, "gid long, v double")
    sa, sb = np.sort(a), np.sort(b)
    ks = [(0, 0), (0, 2999), (0, 5999), (0, 3500), (1, 0), (1, 150), (1, 299), (1, 300)]
    got = select_kth(df, ks)
    for g, k in ks:
        ref = sa if g == 0 else sb
        assert got[(g, k)] == (ref[k] if k < len(ref) else None)


def test_weighted_selection(spark):
    df = spark.createDataFrame([(0, 1.0, 3), (0, 2.0, 1), (0, 10.0, 5)], "gid long, v double, w long")
    got = select_kth(df, [(0, 0), (0, 2), (0, 3), (0, 4), (0, 8)], weight="w")
    assert [got[(0, k)] for k in (0, 2, 3, 4, 8)] == [1.0, 1.0, 2.0, 10.0, 10.0]


def test_quantiles_linear(spark):
    vals = [100.5, 175.25, 200.0, 225.0, 275.5, 300.0, 3.0]
    df = spark.createDataFrame([(0, v) for v in vals], "gid long, v double")
    q = quantiles(df, "gid", "v", {0: len(vals)}, [0.25, 0.5, 0.75])
    for p in (0.25, 0.5, 0.75):
        assert q[(0, p)] == pytest.approx(float(np.quantile(vals, p)))


@pytest.mark.parametrize("n", [2, 3, 5, 6, 7, 13, 40])
def test_qcut_of_first_rank(spark, n):
    rng = np.random.default_rng(n)
    vals = rng.integers(0, 4, n).astype(float)  # heavy ties
    keys = rng.permutation(n).astype(float)
    pdf = pd.DataFrame({"k": keys, "v": vals}).sort_values("k")
    expected = pd.qcut(pdf["v"].rank(method="first"), 4, labels=[1, 2, 3, 4]).astype(int)
    df = spark.createDataFrame(pdf)
    cuts = rank_cuts_many(df, ["v"], "k", n)["v"]
    got = df.select("k", bucket_of("v", "k", cuts).alias("q")).toPandas().sort_values("k")
    assert list(got["q"]) == list(expected)


def test_approx_quantiles_close_to_exact(spark):
    rng = np.random.default_rng(4)
    vals = rng.normal(50, 10, 5000)
    df = spark.createDataFrame([(0, float(v)) for v in vals], "gid long, v double")
    q = quantiles(df, "gid", "v", {0: len(vals)}, [0.25, 0.5, 0.75], exact=False)
    for p in (0.25, 0.5, 0.75):
        assert abs(q[(0, p)] - float(np.quantile(vals, p))) < 0.5


def test_select_kth_with_infinite_and_extreme_values(spark):
    rng = np.random.default_rng(8)
    a = np.concatenate([rng.normal(0, 1, 6000), [np.inf, np.inf, -np.inf, 1.7e308, -1.7e308, 5e-324, 0.0, -0.0]])
    df = spark.createDataFrame([(0, float(x)) for x in a] + [(0, float("nan")), (0, None)], "gid long, v double")
    s = np.sort(a)
    ks = [0, 1, 2, 3000, 4321, len(a) - 3, len(a) - 1, len(a)]
    got = select_kth(df, [(0, k) for k in ks])
    assert [got[(0, k)] for k in ks] == [*(s[k] for k in ks[:-1]), None]


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_select_kth_of_other_types(spark, kind):
    rng = np.random.default_rng(9)
    if kind == "string":
        vals = [f"customer number {x}" for x in rng.integers(0, 40, 120)] + ["", "a", "ab", "é", "customer number 10", "c"]
        order = sorted(vals, key=str.encode)
    else:
        vals = [int(x) for x in rng.integers(-2**62, 2**62, 80)] + [2**53, 2**53 + 1, 2**53 + 2, -2**63, 2**63 - 1]
        order = sorted(vals)
    df = spark.createDataFrame([(0, v) for v in vals] + [(0, None)], f"gid long, v {kind}")
    ks = [0, 1, 2, 40, len(vals) - 1, len(vals)]
    got = select_kth_any(df, [(0, k) for k in ks])
    assert [got[(0, k)] for k in ks] == [*(order[k] for k in ks[:-1]), None]


def test_ranks_with_text_keys(spark):
    vals = [1.0, 1.0, 1.0, 1.0, 2.0, 1.0, 1.0, 3.0, 1.0]
    keys = [f"c{k}@mail.example" for k in (9, 10, 8, 7, 6, 5, 4, 3, 20)]
    pdf = pd.DataFrame({"k": keys, "v": vals}).sort_values("k")
    expected = pd.qcut(pdf["v"].rank(method="first"), 4, labels=[1, 2, 3, 4]).astype(int)
    df = spark.createDataFrame(pdf)
    cuts = rank_cuts_many(df, ["v"], "k", len(vals))["v"]
    got = df.select("k", bucket_of("v", "k", cuts).alias("q")).toPandas().sort_values("k")
    assert list(got["q"]) == list(expected)


def test_brackets_of_a_sketch(spark, monkeypatch):
    from quillspark.functions import selection as SEL
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(0, 1, 5000), 1: np.round(rng.normal(0, 2, 3000)), 2: np.array([float("inf"), float("-inf"), 0.0, -0.0, 5e-324] * 20), 3: np.array([7.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [(0, None), (1, float("nan"))], "gid int, v double").repartition(4)
    targets = [(g, k) for g, vs in groups.items() for k in {0, 1, len(vs) // 4, len(vs) // 2, len(vs) - 1, len(vs)}] + [(9, 0)]
    want = {(g, k): (sorted(groups[g])[k] if g in groups and k < len(groups[g]) else None) for g, k in targets}
    assert SEL.select_kth(df, targets) == want
    monkeypatch.setattr(SEL, "COUNTED", 5)  # the last step stays in Spark
    assert SEL.select_kth(df, targets) == want
    monkeypatch.setattr(SEL, "_grid_brackets", lambda sketch, ts: {g: [(1e300, 1e301)] for g in sketch})  # a sketch that misses everything
    assert SEL.select_kth(df, targets) == want
    monkeypatch.setattr(SEL, "COUNTED", 200_000)
    assert SEL.select_kth(df, targets) == want


def test_running_totals_and_neighbours(spark):
    from pyspark.sql import functions as F
    from quillspark.functions.running import running_totals, with_previous
    rows = [(k % 3, k, k * k) for k in range(100)]
    df = spark.createDataFrame(rows, "g int, o long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for r in running_totals(df, ["g"], ["o"], F.col("v")).collect():
            assert r.before == sum(v for g, o, v in rows if g == r.g and o < r.o) and r.total == sum(v for g, _, v in rows if g == r.g)
        for r in with_previous(df, ["g"], "o").collect():
            assert r.previous == (None if r.o < 3 else r.o - 3)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
