"""Column profiles.

Numeric statistics for all numeric columns come from one aggregate; medians
and the top-k% thresholds from the distributed selection; the top-k% sum
needs no sort: with t the k-th largest value, the k largest values sum to
``sum(x > t) + (k - count(x > t)) * t``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import epoch_micros, from_epoch_micros
from ..functions.running import with_previous
from ..functions.selection import quantiles, select_keys


# Fixed values that must equal the reference: profile note templates.
NOTE_SKEW = "{title} is {side}-skewed"
NOTE_TOPK = "top {pct}% contribute ~{share:.0f}% of total"
NOTE_HIGH_OUTLIERS = "distribution has high-value outliers"
NOTE_LOW_OUTLIERS = "distribution has low-value outliers"
NOTE_RANGE = "Values range from {lo:.2f} to {hi:.2f}"
NOTE_MAJORITY = "Majority ({pct:.0f}%) are '{value}'"
NOTE_TOP2 = "Majority come from '{a}' and '{b}'"
NOTE_DIVERSE = "High diversity in values"
NOTE_LIMITED = "Limited to {n} distinct values"
NOTE_UNIQUE = "{n} unique values"
DATE_NOTES = ["Covers less than a week", "Covers approximately one month", "Covers {n} months", "Covers {n} years",
              "appears to be {freq} data"]
FREQUENCIES = [(1, "daily"), (7, "weekly"), (31, "monthly"), (92, "quarterly")]  # else "yearly"


def _title(name: str) -> str:
    return name.replace("_", " ").title()


def numeric_profiles(df: DataFrame, columns: list[str], config: dict) -> list[dict]:
    """min, max, mean, median, std (n>1), skewness (n>=3, population), top-k share, notes."""
    if not columns:
        return []
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"),
                 F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"sd{i}"), F.skewness(v).alias(f"sk{i}"),
                 F.sum(v).alias(f"s{i}")]
    r = df.agg(*aggs).collect()[0]
    vals = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("gid"), F.col(c).cast("double").alias("v"))
                                         for i, c in enumerate(columns)])).alias("x")).select("x.gid", "x.v")
    counts = {i: r[f"n{i}"] for i in range(len(columns)) if r[f"n{i}"]}
    pct = config["analysis"]["top_k_contribution_pct"]
    ks = {i: max(1, int(n * pct / 100)) for i, n in counts.items()}
    # one selection for the medians and the top-k thresholds of every column
    extra = [(i, counts[i] - ks[i]) for i in counts]
    exact = config["analysis"].get("exact_quantiles", True)
    med, kth = quantiles(vals, "gid", "v", counts, [0.5], extra=extra, exact=exact) if counts else ({}, {})
    thr_aggs = []
    for i in counts:
        t = kth[(i, counts[i] - ks[i])]
        v = F.col(columns[i]).cast("double")
        thr_aggs += [F.sum(F.when(v > t, v)).alias(f"a{i}"), F.count_if(v > t).alias(f"b{i}")]
    thr = df.agg(*thr_aggs).collect()[0].asDict() if thr_aggs else {}
    out = []
    for i, c in enumerate(columns):
        n = r[f"n{i}"]
        if not n:
            continue
        p = {"column": c, "n": n, "min": r[f"mn{i}"], "max": r[f"mx{i}"], "mean": r[f"m{i}"],
             "median": med[(i, 0.5)], "std": r[f"sd{i}"] if n > 1 else None,
             "skewness": r[f"sk{i}"] if n >= 3 else None}
        t = kth[(i, n - ks[i])]
        top_sum = (thr[f"a{i}"] or 0.0) + (ks[i] - thr[f"b{i}"]) * t
        total = r[f"s{i}"]
        p["topk_share"] = top_sum / total * 100 if total and total > 0 else None
        p.update(topk=ks[i], topk_threshold=t, topk_sum=top_sum)
        p["notes"] = numeric_notes(p, config)
        out.append(p)
    return out


def numeric_notes(p: dict, config: dict) -> str:
    notes = []
    sk = p.get("skewness")
    if sk is not None and sk == sk and abs(sk) > config["analysis"]["skewness_threshold"]:
        notes.append(NOTE_SKEW.format(title=_title(p["column"]), side="right" if sk > 0 else "left"))
    share = p.get("topk_share")
    if share is not None and share > 50:
        notes.append(NOTE_TOPK.format(pct=config["analysis"]["top_k_contribution_pct"], share=share))
    if abs(p["median"] - p["mean"]) / (abs(p["mean"]) + 1e-10) > 0.2:
        notes.append(NOTE_HIGH_OUTLIERS if p["median"] < p["mean"] else NOTE_LOW_OUTLIERS)
    if not notes:
        notes.append(NOTE_RANGE.format(lo=p["min"], hi=p["max"]))
    return "; ".join(notes)


def categorical_top(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """``(value, count)`` of the ``top`` most frequent non-null values (TakeOrderedAndProject)."""
    return (df.filter(F.col(column).isNotNull())
              .groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), F.col("value")).limit(top))


def categorical_profiles(df: DataFrame, columns: list[str], config: dict) -> list[dict]:
    """Top values, distinct count and notes per categorical column.

    One ``(column, value)`` count aggregate feeds both the distinct/total
    counts and the top-N per column.  The top-N uses ``row_number() <= N``,
    for which Spark plans a partial WindowGroupLimit before the shuffle, so
    no task ever receives more than N rows per column and map partition.
    """
    from pyspark.sql import Window
    out = []
    if not columns:
        return out
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("string").alias("v"))
                                for i, c in enumerate(columns)])).alias("x")
    vc = (df.select(cells).select("x.k", "x.v").filter(F.col("v").isNotNull())
            .groupBy("k", "v").agg(F.count(F.lit(1)).alias("count"))).persist()
    try:
        per = vc.groupBy("k").agg(F.count(F.lit(1)).alias("distinct"), F.sum("count").alias("total")).collect()
        top_n = config["analysis"]["top_values_count"]
        w = Window.partitionBy("k").orderBy(F.col("count").desc(), F.col("v"))
        tops = (vc.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
                  .select("k", "rank", "v", "count").collect())
    finally:
        vc.unpersist()
    stats = {r["k"]: r for r in per}
    by_k: dict[int, list] = {}
    for r in sorted(tops, key=lambda r: (r["k"], r["rank"])):
        by_k.setdefault(r["k"], []).append((r["v"], r["count"]))
    for i, c in enumerate(columns):
        if i not in stats:
            continue
        d, total = stats[i]["distinct"], stats[i]["total"]
        t = by_k.get(i, [])
        out.append({"column": c, "top_values": t, "unique_count": d, "notes": categorical_notes(t, d, total)})
    return out


def categorical_notes(tops: list[tuple], distinct: int, total: int) -> str:
    notes = []
    if tops:
        top_pct = tops[0][1] / total * 100
        if top_pct > 50:
            notes.append(NOTE_MAJORITY.format(pct=top_pct, value=tops[0][0]))
        elif distinct >= 2:
            top2 = (tops[0][1] + tops[1][1]) / total * 100
            if top2 > 70:
                notes.append(NOTE_TOP2.format(a=tops[0][0], b=tops[1][0]))
    ratio = distinct / total
    if ratio > 0.8:
        notes.append(NOTE_DIVERSE)
    elif ratio < 0.1:
        notes.append(NOTE_LIMITED.format(n=distinct))
    if not notes:
        notes.append(NOTE_UNIQUE.format(n=distinct))
    return "; ".join(notes)


_DAY = 86_400_000_000


def date_profile(df: DataFrame, column: str) -> DataFrame:
    """One row (none without dates): min_date, max_date, date_range_days, median_gap_days, estimated_frequency, column, notes."""
    return date_profiles(df, [column])


def date_profiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Profiles of all date columns at once.

    The gaps of a column's sorted dates are one gap between consecutive distinct
    values (weight 1) plus a zero gap for every repeat (weight count - 1).  Neighbours
    are paired within range partitions that carry their last value on.
    """
    spark = df.sparkSession
    schema = ("min_date string, max_date string, date_range_days long, median_gap_days long, estimated_frequency string, "
              "column string, notes string")
    if not columns:
        return spark.createDataFrame([], schema)
    cells = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("g"), epoch_micros(c).alias("t")) for i, c in enumerate(columns)])).alias("x")
    counts = df.select(cells).select("x.*").filter(F.col("t").isNotNull()).groupBy("g", "t").agg(F.count(F.lit(1)).alias("c"))
    paired = with_previous(counts, ["g"], "t").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        day = lambda c: F.date_format(from_epoch_micros(c), "yyyy-MM-dd")
        stats = paired.groupBy("g").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.sum("c").alias("n")).select(
            "g", "lo", "hi", "n", day("lo").alias("first"), day("hi").alias("last")).collect()  # one row per column
        gaps = paired.select("g", F.explode(F.array(
            F.struct((F.col("t") - F.col("previous")).alias("gap"), F.lit(1).cast("long").alias("w")),
            F.struct(F.lit(0).cast("long").alias("gap"), (F.col("c") - 1).alias("w")))).alias("x")).select(
                F.col("g").alias("_g"), F.col("x.gap").alias("_k"), F.col("x.w").alias("_w"))
        middle = {r["g"]: (r["n"] - 2) * 0.5 for r in stats if r["n"] > 1}
        got = select_keys(gaps, [(g, k) for g, h in middle.items() for k in sorted({int(h), min(int(h) + 1, int(2 * h))})]) if middle else {}
    finally:
        paired.unpersist()
    rows = []
    for r in sorted(stats, key=lambda r: r["g"]):
        median, frequency = None, None
        if r["g"] in middle:
            h = middle[r["g"]]
            a, b = got[(r["g"], int(h))], got[(r["g"], min(int(h) + 1, int(2 * h)))]
            median = int((a + (b - a) * (h - int(h))) // _DAY)
            frequency = next((name for bound, name in FREQUENCIES if median <= bound), "yearly")
        days = (r["hi"] - r["lo"]) // _DAY
        rows.append((r["first"], r["last"], days, median, frequency, columns[r["g"]], date_notes(days, frequency)))
    return spark.createDataFrame(rows, schema)


def date_notes(days: int, frequency: str | None) -> str:
    span = (DATE_NOTES[0] if days < 7 else DATE_NOTES[1] if days < 31
            else DATE_NOTES[2].format(n=days // 30) if days < 365 else DATE_NOTES[3].format(n=days // 365))
    return span if frequency is None else f"{span}; {DATE_NOTES[4].format(freq=frequency)}"


#: Columns of one block of the co-moment matrix.
CORR_BLOCK = 512
_PAIRS = "a int, b int, r double"


def _block_pairs(df: DataFrame, left: list[int], right: list[int], columns: list[str], means: list[float]) -> DataFrame:
    """(a, b, r) of the column pairs a < b of two blocks, over the rows where both values are present.

    A task sums products of its rows in matrices (values less their column's mean); the
    rows of these matrices are added up per column, so no pair is an aggregate of its own.
    """
    every = sorted({*left, *right})
    at = {c: i for i, c in enumerate(every)}
    l_at, r_at, shift = [at[c] for c in left], [at[c] for c in right], np.array([means[c] for c in every])

    def moments(batches):
        sums = None
        for rows in batches:
            x = rows.to_numpy(dtype=float) - shift
            m = ~np.isnan(x)
            x = np.where(m, x, 0.0)
            mask, square = m.astype(float), x * x
            lx, rx, lm, rm = x[:, l_at], x[:, r_at], mask[:, l_at], mask[:, r_at]
            part = np.stack([lm.T @ rm, lx.T @ rm, lm.T @ rx, square[:, l_at].T @ rm, lm.T @ square[:, r_at], lx.T @ rx])
            sums = part if sums is None else sums + part
        if sums is not None:
            yield pd.DataFrame({"a": left, "sums": [sums[:, i, :].tobytes() for i in range(len(left))]})

    def correlate(parts: pd.DataFrame) -> pd.DataFrame:
        a = int(parts["a"].iloc[0])
        n, sx, sy, sxx, syy, sxy = sum(np.frombuffer(b).reshape(6, -1) for b in parts["sums"])
        with np.errstate(all="ignore"):
            spread = (sxx - sx * sx / n) * (syy - sy * sy / n)
            r = np.where(spread > 0, (sxy - sx * sy / n) / np.sqrt(spread), np.nan)
        pairs = pd.DataFrame({"a": a, "b": right, "r": r})
        return pairs[(pairs["b"] > a) & pairs["r"].notna()]

    cells = df.select(*[F.col(columns[c]).cast("double").alias(f"c{c}") for c in every])
    return cells.mapInPandas(moments, "a int, sums binary").groupBy("a").applyInPandas(correlate, _PAIRS)


def correlations(df: DataFrame, columns: list[str], threshold: float = 0.7, top: int = 5) -> DataFrame:
    """Pairs with |pearson r| > threshold, strongest 5, strength High (> 0.9) / Medium (older pass)."""
    spark = df.sparkSession
    if len(columns) < 2:
        return spark.createDataFrame([], "col_a string, col_b string, correlation double, strength string")
    means = [m or 0.0 for m in df.agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))) for c in columns]).first()]
    blocks = [list(range(k, min(k + CORR_BLOCK, len(columns)))) for k in range(0, len(columns), CORR_BLOCK)]
    pairs = None
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            part = _block_pairs(df, left, right, columns, means)
            pairs = part if pairs is None else pairs.unionByName(part)
    names = F.array(*map(F.lit, columns))
    return (pairs.filter(F.abs("r") > threshold).select(names[F.col("a")].alias("col_a"), names[F.col("b")].alias("col_b"), "r")
                 .orderBy(F.abs("r").desc(), "col_a", "col_b").limit(top)
                 .select("col_a", "col_b", F.round("r", 2).alias("correlation"),
                         F.when(F.abs("r") > 0.9, "High").otherwise("Medium").alias("strength")))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins ``(column, bin, lower, upper, count)``; last bin closed, empty bins kept."""
    return histograms(df, [column], bins)


def histograms(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Histograms of several columns in two passes: one aggregate for every
    column's range (two numbers each, read back as literals), one aggregate
    of (column, bin) counts.  Empty bins come from a small range frame."""
    spark = df.sparkSession
    mm = df.agg(*[F.min(F.col(c).cast("double")).alias(f"mn{i}") for i, c in enumerate(columns)],
                *[F.max(F.col(c).cast("double")).alias(f"mx{i}") for i, c in enumerate(columns)]).first()
    edges = []
    for i, c in enumerate(columns):
        lo, hi = mm[f"mn{i}"], mm[f"mx{i}"]
        if lo is None:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        edges.append((i, c, float(lo), float(hi)))
    if not edges:
        return spark.createDataFrame([], "column string, bin long, lower double, upper double, count long")
    cells = []
    for i, c, lo, hi in edges:
        v = F.col(c).cast("double")
        w = (hi - lo) / bins
        b = F.least(F.floor((v - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)).cast("long")
        cells.append(F.when(v.isNotNull() & ~F.isnan(v), F.struct(F.lit(i).alias("k"), b.alias("bin"))))
    counted = (df.select(F.explode(F.array(*cells)).alias("x")).filter(F.col("x").isNotNull())
                 .groupBy("x.k", "x.bin").agg(F.count(F.lit(1)).alias("count")))
    frame = spark.createDataFrame([(i, c, lo, hi, j) for i, c, lo, hi in edges for j in range(bins)],
                                  "k int, column string, lo double, hi double, bin long")
    w = (F.col("hi") - F.col("lo")) / bins
    return (frame.join(counted, ["k", "bin"], "left")
                 .select("column", "bin", F.round(F.col("lo") + F.col("bin") * w, 2).alias("lower"),
                         F.round(F.col("lo") + (F.col("bin") + 1) * w, 2).alias("upper"),
                         F.coalesce("count", F.lit(0)).cast("long").alias("count")))


PANDAS_DTYPES = {"LongType": "int64", "IntegerType": "int32", "ShortType": "int16", "ByteType": "int8",
                 "DoubleType": "float64", "FloatType": "float32", "StringType": "object", "BooleanType": "bool",
                 "TimestampType": "datetime64[ns]", "TimestampNTZType": "datetime64[ns]", "DateType": "object"}


def dtype_profile(df: DataFrame, top: int = 5) -> list[dict]:
    """Per column: dtype name; numeric min/max/mean/sum/std; text distinct count and top values."""
    from .infer import distinct_counts
    fields = df.schema.fields
    kinds = {f.name: PANDAS_DTYPES.get(type(f.dataType).__name__, "object") for f in fields}
    num = [f.name for f in fields if kinds[f.name].startswith(("int", "float"))]
    txt = [f.name for f in fields if kinds[f.name] == "object"]
    aggs = []
    for i, c in enumerate(num):
        v = F.col(c).cast("double")
        aggs += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"), F.avg(v).alias(f"m{i}"),
                 F.sum(v).alias(f"s{i}"), F.stddev_samp(v).alias(f"sd{i}")]
    r = df.agg(*aggs).collect()[0] if aggs else None
    dist = distinct_counts(df, txt)
    out = []
    for f in fields:
        c = f.name
        rec = {"column": c, "type": kinds[c], "min": None, "max": None, "mean": None, "sum": None, "std": None,
               "unique_count": None, "top_values": None}
        if c in num:
            i = num.index(c)
            sd = r[f"sd{i}"]
            rec.update(min=r[f"mn{i}"], max=r[f"mx{i}"], mean=r[f"m{i}"], sum=r[f"s{i}"],
                       std=sd if sd is not None and sd == sd else 0.0)
        elif c in txt:
            tops = categorical_top(df, c, top).collect()
            rec.update(unique_count=dist[c], top_values=", ".join(f"{x['value']}:{x['count']}" for x in tops))
        out.append(rec)
    return out
