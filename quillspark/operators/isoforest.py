"""Isolation-forest outlier counts of numeric columns.

All columns go through one keyed pass over their distinct values and counts:

* draw: a tree's sample are rows drawn by rank.  The ranks come from a hash of
  (seed, tree, draw), so any engine and any partitioning draws the same rows; the
  running counts of the sorted values tell which value a rank holds;
* grow: one grouped call per column.  A one-dimensional tree cuts the line into
  intervals: sorted split points and a path length per interval.  A node's split
  point comes from a hash of (seed, tree, node);
* score: one ``searchsorted`` per tree in an Arrow-batched UDF, once per distinct
  value; scores are multiples of 2^-40;
* cut: the interpolated ``contamination`` quantile of all rows' scores by exact
  selection; rows below it are counted, as scikit-learn's ``fit_predict`` does.

``flagged_sql`` spells the same forest in SQL.  Only finite values take part.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.running import running_totals
from ..functions.selection import select_keys
from ..session import scratch_path

TREES, SAMPLES, SEED = 100, 256, 42
#: Columns of one pass: their forests (below 0.5 MB each) are broadcast.
COLUMNS = 64
_EULER = 0.5772156649015329
#: Path lengths are multiples of 2^-30 (their sums are exact), scores of 2^-40.
_PATH, _SCORE = 1 << 30, 1 << 40


def uniform(*parts) -> float:
    """A number in [0, 1) from the MD5 of the parts: its first 52 bits."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / (1 << 52)


def avg_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` values."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + _EULER) - 2.0 * (n - 1) / n


def drawn_ranks(n: int, tree: int, samples: int = SAMPLES, seed: int = SEED) -> list[int]:
    """Ranks (of ``n`` rows) that a tree samples: all of them, or the first distinct ones of twice as many draws."""
    if n <= samples:
        return list(range(n))
    return list(dict.fromkeys(int(uniform(seed, tree, j) * n) for j in range(2 * samples)))[:samples]


def grow_tree(values: np.ndarray, tree: int, limit: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Split points and the path length of every interval between them."""
    splits, leaves = [], []

    def node(s: np.ndarray, number: int, depth: int):
        if depth >= limit or len(s) <= 1 or s[0] == s[-1]:
            leaves.append(math.floor((depth + avg_path(len(s))) * _PATH + 0.5) / _PATH)
            return
        p = s[0] + uniform(seed, tree, "n", number) * (s[-1] - s[0])
        at = int(np.searchsorted(s, p, side="left"))
        node(s[:at], 2 * number, depth + 1)
        splits.append(p)
        node(s[at:], 2 * number + 1, depth + 1)

    node(np.sort(values), 1, 0)
    return np.array(splits), np.array(leaves)


def depth_limit(m: int) -> int:
    return math.ceil(math.log2(max(m, 2)))


def score_keys(v: np.ndarray, trees: list, m: int) -> np.ndarray:
    """Scores (low: isolated) as integers, in units of 2^-40."""
    depth = np.zeros(len(v))
    for splits, leaves in trees:
        depth += leaves[np.searchsorted(splits, v, side="right")]
    norm = avg_path(m)
    score = -np.power(2.0, -(depth / len(trees)) / norm) if norm else np.full(len(v), -0.5)
    return np.floor(score * _SCORE + 0.5).astype(np.int64)


def column_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """g, v, c, before, total: the distinct finite values of every column with their counts and running counts."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("cell")
    fits = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    counts = df.select(cells).select("cell.*").filter(fits).groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    return running_totals(counts, ["g"], ["v"], F.col("c"))


def grown_forests(values: DataFrame, totals: dict[int, int], n_trees: int, samples: int, seed: int) -> dict[int, tuple[list, int]]:
    """{g: (trees, sample size)}: at most ``n_trees * samples`` rows per column are drawn, and one task grows a column's trees."""
    spark = values.sparkSession
    by_column = {}
    for g, n in totals.items():
        pairs = sorted((r, t) for t in range(n_trees) for r in drawn_ranks(n, t, samples, seed))
        by_column[g] = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    wanted = spark.sparkContext.broadcast(by_column)

    def pick(batches):
        for rows in batches:
            for g, part in rows.groupby("g"):
                ranks, trees = wanted.value[g]
                lo = np.searchsorted(ranks, part["before"].to_numpy())
                hi = np.searchsorted(ranks, (part["before"] + part["c"]).to_numpy())
                at = np.arange((hi - lo).sum()) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
                yield pd.DataFrame({"g": np.full(len(at), g, np.int32), "t": trees[at].astype(np.int32), "v": np.repeat(part["v"].to_numpy(), hi - lo)})

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        rows, of_tree = [], dict(list(sample.groupby("t")["v"]))
        for t in range(n_trees):
            v = of_tree[t].to_numpy()
            splits, leaves = grow_tree(v, t, depth_limit(len(v)), seed)
            rows.append((sample["g"].iloc[0], t, len(v), splits.tobytes(), leaves.tobytes()))
        return pd.DataFrame(rows, columns=["g", "t", "m", "splits", "leaves"])

    drawn = values.select("g", "v", "c", "before").mapInPandas(pick, "g int, t int, v double")
    forests: dict[int, tuple[list, int]] = {}
    for r in drawn.groupBy("g").applyInPandas(grow, "g int, t int, m int, splits binary, leaves binary").orderBy("g", "t").collect():
        trees, m = forests.get(r["g"], ([], 0))
        forests[r["g"]] = [*trees, (np.frombuffer(r["splits"]), np.frombuffer(r["leaves"]))], max(m, r["m"])
    return forests


def isolation_counts(df: DataFrame, columns: list[str], contamination: float = 0.05, min_rows: int = 50,
                     n_trees: int = TREES, max_samples: int = SAMPLES, seed: int = SEED) -> dict[str, int]:
    """{column: rows flagged}; columns with fewer than ``min_rows`` values get 0."""
    out = {}
    for k in range(0, len(columns), COLUMNS):
        out |= _block_counts(df, columns[k:k + COLUMNS], contamination, min_rows, n_trees, max_samples, seed)
    return out


def _block_counts(df, columns, contamination, min_rows, n_trees, samples, seed) -> dict[str, int]:
    spark = df.sparkSession
    values = column_values(df, columns)
    sizes = {r["g"]: r["n"] for r in values.groupBy("g").agg(F.max("total").alias("n")).collect()}
    totals = {g: n for g, n in sizes.items() if n >= min_rows}
    if not totals:
        return {c: 0 for c in columns}
    values = values.filter(F.col("g").isin(list(totals)))
    forests = spark.sparkContext.broadcast(grown_forests(values, totals, n_trees, samples, seed))

    @F.pandas_udf("long")
    def score(g: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int64)
        for one in g.unique():
            at = (g == one).to_numpy()
            out[at] = score_keys(v.to_numpy()[at], *forests.value[one])
        return pd.Series(out)

    path = f"{scratch_path(spark, 'forest')}/{uuid.uuid4().hex}"
    values.select(F.col("g").cast("long").alias("_g"), score("g", "v").alias("_k"), F.col("c").cast("double").alias("_w")).write.parquet(path)
    scored = spark.read.schema("_g long, _k long, _w double").parquet(path)
    at = {g: int((n - 1) * contamination) for g, n in totals.items()}
    found = select_keys(scored, [(g, k + d) for g, k in at.items() for d in (0, 1) if k + d < totals[g]])
    cut = {}
    for g, n in totals.items():
        a, part = found[(g, at[g])], (n - 1) * contamination - at[g]
        cut[g] = a + (found.get((g, at[g] + 1), a) - a) * part
    limits = F.create_map(*[x for g, v in cut.items() for x in (F.lit(g).cast("long"), F.lit(float(v)))])
    flagged = scored.filter(F.col("_k") < limits[F.col("_g")]).groupBy("_g").agg(F.sum("_w").alias("n")).collect()
    counts = {r["_g"]: int(r["n"]) for r in flagged}
    return {c: counts.get(i, 0) for i, c in enumerate(columns)}


def flagged_sql(values: str, contamination: float = 0.05, n_trees: int = TREES, samples: int = SAMPLES, seed: int = SEED) -> str:
    """DuckDB SQL for n and flagged of one column; ``values`` selects its rows as ``v`` (double, not null)."""
    u = lambda text: f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0)"
    c = f"CASE WHEN k <= 1 THEN 0.0 WHEN k = 2 THEN 1.0 ELSE 2.0 * (ln(k - 1) + {_EULER}) - 2.0 * (k - 1) / k END"
    return f"""
WITH RECURSIVE rows_ AS ({values}),
counted AS (SELECT v, count(*) AS c FROM rows_ GROUP BY v),
cum AS (SELECT v, c, sum(c) OVER (ORDER BY v) - c AS before FROM counted),
total AS (SELECT count(*) AS n FROM rows_),
draws AS (SELECT t, j, CASE WHEN n <= {samples} THEN j ELSE CAST(floor({u(f"'{seed}:' || t || ':' || j")} * n) AS BIGINT) END AS r
          FROM total, range({n_trees}) a(t), range({2 * samples}) b(j) WHERE n > {samples} OR j < n),
firsts AS (SELECT t, r FROM (SELECT t, r, min(j) AS j FROM draws GROUP BY t, r) QUALIFY row_number() OVER (PARTITION BY t ORDER BY j) <= {samples}),
sample AS (SELECT t, v FROM firsts JOIN cum ON r >= before AND r < before + c),
trees AS (SELECT t, list(v) AS vs, count(*) AS m FROM sample GROUP BY t),
nodes(t, node, depth, lo, hi, vs, lim, p) AS (
  SELECT t, 1::BIGINT, 0, '-inf'::DOUBLE, 'inf'::DOUBLE, vs, CAST(ceil(log2(greatest(m, 2))) AS INTEGER),
         list_min(vs) + {u(f"'{seed}:' || t || ':n:1'")} * (list_max(vs) - list_min(vs)) FROM trees
  UNION ALL
  SELECT t, node, depth, lo, hi, vs, lim, list_min(vs) + {u(f"'{seed}:' || t || ':n:' || node")} * (list_max(vs) - list_min(vs)) FROM (
    SELECT t, 2 * node + side AS node, depth + 1 AS depth, CASE side WHEN 0 THEN lo ELSE p END AS lo, CASE side WHEN 0 THEN p ELSE hi END AS hi,
           CASE side WHEN 0 THEN list_filter(vs, lambda x: x < p) ELSE list_filter(vs, lambda x: x >= p) END AS vs, lim
    FROM nodes, (VALUES (0), (1)) s(side) WHERE depth < lim AND len(vs) > 1 AND list_min(vs) < list_max(vs))),
leaves AS (SELECT t, lo, hi, floor((depth + {c.replace("k", "len(vs)")}) * {_PATH} + 0.5) / {_PATH} AS path
           FROM nodes WHERE depth >= lim OR len(vs) <= 1 OR list_min(vs) = list_max(vs)),
norm AS (SELECT {c.replace("k", "m")} AS norm FROM (SELECT max(m) AS m FROM trees)),
scored AS (SELECT v, any_value(c) AS c, CAST(floor(-pow(2.0, -(sum(path) / {n_trees}) / any_value(norm)) * {_SCORE} + 0.5) AS BIGINT) AS k
           FROM counted JOIN leaves ON v >= lo AND v < hi, norm GROUP BY v),
ranked AS (SELECT k, sum(c) OVER (ORDER BY k, v) - c AS before, c FROM scored),
spot AS (SELECT (n - 1) * {contamination!r} AS h, CAST(floor((n - 1) * {contamination!r}) AS BIGINT) AS f FROM total),
cut AS (SELECT max(k) FILTER (before <= f) AS a, max(k) FILTER (before <= f + 1) AS b, any_value(h) - any_value(f) AS part FROM ranked, spot)
SELECT (SELECT n FROM total) AS n, CAST(coalesce(sum(c) FILTER (k < a + (b - a) * part), 0) AS BIGINT) AS flagged FROM scored, cut"""
