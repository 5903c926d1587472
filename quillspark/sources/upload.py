"""A raw "uploaded" table derived from the driver's ``orders`` table.

The driver tables are clean, so the validation queries read an all-text
projection of *every* ``orders`` row with deterministic dirt: placeholders,
padding, seventeen date layouts, text residue and near-numbers in a numeric column, a date-like
column that is mostly text, fully empty rows and repeated rows.  The same
expressions exist as DuckDB SQL (``RAW_UPLOAD_SQL``) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

UPLOAD_COLUMNS = ["order_id", "order_date", "ship_day", "customer", "status", "priority", "total", "note"]


def raw_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    blank = (k % 97) == 0

    def cell(expr):
        return F.when(blank, F.lit("NA")).otherwise(expr)

    cols = {
        "order_id": cell(F.concat(F.lit("ORD"), k.cast("string"))),
        "order_date": cell(F.when(k % 17 == 0, F.lit("N/A"))
                            .when(k % 31 == 0, F.lit("not a date"))
                            .when(k % 37 == 0, F.concat(F.date_format(d, "M/d/yyyy"), F.lit(" 0:00")))
                            .when(k % 43 == 0, F.date_format(d, "yyyy/MM/dd"))
                            .when(k % 47 == 0, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:00:00Z")))
                            .when(k % 53 == 0, F.date_format(d, "d MMM yyyy"))
                            .when(k % 59 == 0, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 10:30:05.25")))
                            .when(k % 73 == 0, F.date_format(d, "M/d/yy"))
                            .when(k % 79 == 0, F.date_format(d, "dd.MM.yyyy"))
                            .when(k % 83 == 0, F.date_format(d, "MMM d yyyy"))
                            .when(k % 89 == 0, F.date_format(d, "yyyyMMdd"))
                            .when(k % 101 == 0, F.date_format(d, "dd-MMM-yyyy"))
                            .when(k % 103 == 0, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 10:00 PM")))
                            .when(k % 107 == 0, F.date_format(d, "yyyy-MM"))
                            .when(k % 109 == 0, F.date_format(d, "EEE, d MMM yyyy"))
                            .when(k % 113 == 0, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 10:30:05.123456789")))
                            .when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd"))
                            .when(k % 3 == 1, F.date_format(d, "MM/dd/yyyy"))
                            .otherwise(F.date_format(d, "dd-MM-yyyy"))),
        "ship_day": cell(F.when(k % 5 < 3, F.date_format(d, "yyyy-MM-dd")).otherwise(F.lit("pending"))),
        "customer": cell(F.when(k % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("CUST-"),
                                                                          F.col("o_custkey").cast("string")))),
        "status": cell(F.when(k % 11 == 0, F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit(" ")))
                        .otherwise(F.col("o_orderstatus"))),
        "priority": cell(F.when(k % 19 == 0, F.lit("NULL")).otherwise(F.col("o_orderpriority"))),
        "total": cell(F.when(k % 23 == 0, F.lit("nan")).when(k % 29 == 0, F.lit("unknown"))
                       .when(k % 41 == 0, F.lit("-")).when(k % 37 == 0, F.lit("12D")).when(k % 43 == 0, F.lit("NAN"))
                       .otherwise(F.format_string("%.2f", F.col("o_totalprice")))),
        "note": cell(F.when(k % 61 == 0, F.lit('say "hi" now')).when(k % 67 == 0, F.lit("two\nlines, one cell"))
                      .when(k % 71 == 0, F.lit("C:\\")).when(k % 5 == 0, F.lit("rush order")).otherwise(F.lit("--"))),
    }
    copies = F.explode(F.sequence(F.lit(1), F.when(k % 20 == 0, F.lit(2)).otherwise(F.lit(1))))
    return (o.select(copies.alias("_copy"), *[v.alias(c) for c, v in cols.items()])
             .select(*UPLOAD_COLUMNS))


RAW_UPLOAD_SQL = """
SELECT
  CASE WHEN k % 97 = 0 THEN 'NA' ELSE 'ORD' || CAST(k AS VARCHAR) END AS order_id,
  CASE WHEN k % 97 = 0 THEN 'NA' WHEN k % 17 = 0 THEN 'N/A' WHEN k % 31 = 0 THEN 'not a date'
       WHEN k % 37 = 0 THEN strftime(d, '%-m/%-d/%Y') || ' 0:00' WHEN k % 43 = 0 THEN strftime(d, '%Y/%m/%d')
       WHEN k % 47 = 0 THEN strftime(d, '%Y-%m-%d') || 'T10:00:00Z' WHEN k % 53 = 0 THEN strftime(d, '%-d %b %Y')
       WHEN k % 59 = 0 THEN strftime(d, '%Y-%m-%d') || ' 10:30:05.25'
       WHEN k % 73 = 0 THEN strftime(d, '%-m/%-d/%y') WHEN k % 79 = 0 THEN strftime(d, '%d.%m.%Y')
       WHEN k % 83 = 0 THEN strftime(d, '%b %-d %Y') WHEN k % 89 = 0 THEN strftime(d, '%Y%m%d')
       WHEN k % 101 = 0 THEN strftime(d, '%d-%b-%Y') WHEN k % 103 = 0 THEN strftime(d, '%Y-%m-%d') || ' 10:00 PM'
       WHEN k % 107 = 0 THEN strftime(d, '%Y-%m') WHEN k % 109 = 0 THEN strftime(d, '%a, %-d %b %Y')
       WHEN k % 113 = 0 THEN strftime(d, '%Y-%m-%d') || ' 10:30:05.123456789'
       WHEN k % 3 = 0 THEN strftime(d, '%Y-%m-%d') WHEN k % 3 = 1 THEN strftime(d, '%m/%d/%Y')
       ELSE strftime(d, '%d-%m-%Y') END AS order_date,
  CASE WHEN k % 97 = 0 THEN 'NA' WHEN k % 5 < 3 THEN strftime(d, '%Y-%m-%d') ELSE 'pending' END AS ship_day,
  CASE WHEN k % 97 = 0 THEN 'NA' WHEN k % 13 = 0 THEN '' ELSE 'CUST-' || CAST(o_custkey AS VARCHAR) END AS customer,
  CASE WHEN k % 97 = 0 THEN 'NA' WHEN k % 11 = 0 THEN '  ' || o_orderstatus || ' ' ELSE o_orderstatus END AS status,
  CASE WHEN k % 97 = 0 THEN 'NA' WHEN k % 19 = 0 THEN 'NULL' ELSE o_orderpriority END AS priority,
  CASE WHEN k % 97 = 0 THEN 'NA' WHEN k % 23 = 0 THEN 'nan' WHEN k % 29 = 0 THEN 'unknown'
       WHEN k % 41 = 0 THEN '-' WHEN k % 37 = 0 THEN '12D' WHEN k % 43 = 0 THEN 'NAN' ELSE printf('%.2f', o_totalprice) END AS total,
  CASE WHEN k % 97 = 0 THEN 'NA' WHEN k % 61 = 0 THEN 'say "hi" now' WHEN k % 67 = 0 THEN 'two' || chr(10) || 'lines, one cell'
       WHEN k % 71 = 0 THEN 'C:' || chr(92) WHEN k % 5 = 0 THEN 'rush order' ELSE '--' END AS note
FROM (SELECT o_orderkey AS k, o_orderdate AS d, o_custkey, o_orderstatus, o_orderpriority, o_totalprice,
             unnest(generate_series(1, CASE WHEN o_orderkey % 20 = 0 THEN 2 ELSE 1 END)) AS _copy
      FROM orders)
"""
