"""Profile queries of the insight pass on the driver tables."""

from __future__ import annotations

from ..operators import profile as PR
from ..sources.tables import table
from .registry import register

# The pricing columns of lineitem plus the two TPC-style derived amounts.
LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_amount", "charge"]
_LINE_SQL = ("(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS net_amount, "
             "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem)")


def _line_amounts(spark, sf):
    from pyspark.sql import functions as F
    li = table(spark, sf, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", net.alias("net_amount"),
                     (net * (1 + F.col("l_tax"))).alias("charge"))
PART_NUM = ["p_partkey", "p_size", "p_retailprice"]
PART_TXT = ["p_name", "p_brand", "p_type"]


def _corr_sql():
    pairs = [(a, b) for i, a in enumerate(LINE_NUM) for b in LINE_NUM[i + 1:]]
    arms = " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM {_LINE_SQL}"
                              for a, b in pairs)
    return f"""SELECT col_a, col_b, round(r, 2) AS correlation, CASE WHEN abs(r) > 0.9 THEN 'High' ELSE 'Medium' END AS strength
FROM ({arms}) WHERE abs(r) > 0.7 ORDER BY abs(r) DESC, col_a, col_b LIMIT 5"""


@register("correlations", _corr_sql())
def q_correlations(spark, sf):
    return PR.correlations(_line_amounts(spark, sf), LINE_NUM)


def _hist_sql():
    arms = []
    for c in PART_NUM:
        arms.append(f"""SELECT '{c}' AS "column", r.bin,
  round(lo + r.bin * (hi - lo) / 10, 2) AS lower, round(lo + (r.bin + 1) * (hi - lo) / 10, 2) AS upper,
  coalesce((SELECT count(*) FROM part, e{c}
            WHERE {c} IS NOT NULL AND CAST(least(floor((CAST({c} AS DOUBLE) - lo) / ((hi - lo) / 10)), 9) AS BIGINT) = r.bin), 0)
    AS count
FROM (SELECT range AS bin FROM range(10)) r, e{c}""")
    ctes = ", ".join(f"""e{c} AS (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END::DOUBLE AS lo,
                                 CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END::DOUBLE AS hi FROM part)"""
                     for c in PART_NUM)
    return f"WITH {ctes}\n" + "\nUNION ALL ".join(arms)


@register("histogram", _hist_sql())
def q_histogram(spark, sf):
    return PR.histograms(table(spark, sf, "part"), PART_NUM)


@register("distribution", " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM part
        WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY count DESC, value LIMIT 10)""" for c in PART_TXT))
def q_distribution(spark, sf):
    from pyspark.sql import functions as F
    p = table(spark, sf, "part")
    out = None
    for c in PART_TXT:
        t = PR.categorical_top(p, c, 10).select(F.lit(c).alias("column"), "value", "count")
        out = t if out is None else out.unionByName(t)
    return out


def _profile_sql():
    arms = []
    for c, kind in [("p_partkey", "int64"), ("p_name", "object"), ("p_brand", "object"), ("p_type", "object"),
                    ("p_size", "int32"), ("p_retailprice", "float64")]:
        if kind == "object":
            arms.append(f"""SELECT '{c}' AS "column", '{kind}' AS type, NULL::DOUBLE AS min, NULL::DOUBLE AS max,
  NULL::DOUBLE AS mean, NULL::DOUBLE AS sum, NULL::DOUBLE AS std, count(DISTINCT {c}) AS unique_count,
  (SELECT string_agg(v || ':' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, v) FROM
     (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5))
    AS top_values FROM part""")
        else:
            arms.append(f"""SELECT '{c}' AS "column", '{kind}' AS type, round(min({c}), 4) AS min, round(max({c}), 4) AS max,
  round(avg({c}), 4) AS mean, round(sum({c}), 4) AS sum, round(coalesce(stddev_samp({c}), 0), 4) AS std,
  NULL::BIGINT AS unique_count, NULL::VARCHAR AS top_values FROM part""")
    return "\nUNION ALL ".join(arms)


@register("profile_table", _profile_sql())
def q_profile_table(spark, sf):
    rows = []
    for p in PR.dtype_profile(table(spark, sf, "part")):
        r4 = (lambda x: None if x is None else round(float(x), 4))
        rows.append((p["column"], p["type"], r4(p["min"]), r4(p["max"]), r4(p["mean"]), r4(p["sum"]), r4(p["std"]),
                     p["unique_count"], p["top_values"]))
    return spark.createDataFrame(rows, "column string, type string, min double, max double, mean double, sum double, "
                                       "std double, unique_count long, top_values string")
