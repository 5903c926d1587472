"""KPIs and roll-ups.

All roll-ups are a single ``groupBy`` with map-side partial aggregation, so a
hot key costs one partial row per input partition, never one task holding the
hot group.  Top-N uses ``orderBy(...).limit(n)`` which plans as
``TakeOrderedAndProject``: each partition keeps n rows, the driver merges
``n * partitions`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _month(c: str):
    return F.date_format(F.col(c), "yyyy-MM")


def kpis(df: DataFrame, amount: str | None = None, order_id: str | None = None,
         quantity: str | None = None) -> DataFrame:
    """Automatic KPI rows ``(id, label, value)`` in the reference's order."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if amount:
        aggs += [F.sum(amount).alias("s_amount"), F.avg(amount).alias("a_amount")]
    if quantity:
        aggs.append(F.sum(quantity).alias("s_qty"))
    if order_id:
        aggs.append(F.countDistinct(order_id).alias("n_orders"))
    one = df.agg(*aggs)
    rows = []
    if amount:
        rows.append(("total_revenue", "Total Revenue", F.col("s_amount")))
        if order_id:
            rows.append(("avg_order_value", "Avg Order Value",
                         F.coalesce(F.try_divide(F.col("s_amount"), F.col("n_orders")), F.lit(0.0))))
        else:
            rows.append(("avg_transaction", "Avg Transaction", F.col("a_amount")))
    if quantity:
        rows.append(("total_units", "Total Units Sold", F.col("s_qty")))
    if order_id:
        rows.append(("total_orders", "Total Orders", F.col("n_orders")))
    rows.append(("total_records", "Total Records", F.col("n_rows")))
    arr = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("id"), F.lit(lbl).alias("label"),
                             F.round(v.cast("double"), 2).alias("value"))
                    for i, (k, lbl, v) in enumerate(rows)])
    return (one.select(F.inline(arr))
               .select(F.col("pos").cast("long").alias("pos"), "id", "label", "value"))


def _gate(monthly: DataFrame, min_months: int, min_rows: int = 0) -> DataFrame:
    """Keep the monthly frame only if it has enough months / rows.

    ``monthly`` holds one row per month, so an unpartitioned window over it
    is bounded by the number of months; crossing with a separate aggregate
    would instead evaluate the whole upstream plan a second time.
    """
    from pyspark.sql import Window
    w = Window.partitionBy()
    return (monthly.withColumn("_months", F.count(F.lit(1)).over(w))
                   .withColumn("_rows_total", F.sum("_rows").over(w))
                   .filter((F.col("_months") >= min_months) & (F.col("_rows_total") >= min_rows))
                   .drop("_months", "_rows_total", "_rows"))


def orders_over_time(df: DataFrame, date: str, min_rows: int = 3, min_months: int = 2,
                     weight: str | None = None) -> DataFrame:
    """Monthly row counts ``(x, y)``; empty unless >= 3 dated rows and >= 2 months.

    ``weight`` names a per-row multiplicity column (pre-aggregated input).
    """
    n = F.sum(weight).cast("long") if weight else F.count(F.lit(1))
    monthly = (df.select(date, *([weight] if weight else [])).filter(F.col(date).isNotNull())
                 .groupBy(_month(date).alias("x"))
                 .agg(n.alias("y"))
                 .withColumn("_rows", F.col("y")))
    return _gate(monthly, min_months, min_rows).select("x", "y")


def revenue_over_time(df: DataFrame, date: str, amount: str, min_months: int = 2) -> DataFrame:
    """Monthly sums ``(x, y)``; empty unless >= 2 months."""
    monthly = (df.select(date, amount).filter(F.col(date).isNotNull())
                 .groupBy(_month(date).alias("x"))
                 .agg(F.round(F.sum(amount), 2).alias("y"), F.count(F.lit(1)).alias("_rows")))
    return _gate(monthly, min_months).select("x", "y")


def top_groups(df: DataFrame, key: str, value: str | None, n: int | None,
               agg: str = "sum", pie_max: int | None = None, weight: str | None = None) -> DataFrame:
    """``(id, value)`` per key, descending, first ``n``.

    With ``pie_max`` a ``chart`` column says pie when the total number of
    groups is <= pie_max.  That is decided on the ``max(n, pie_max + 1)``
    largest groups (a bounded TakeOrderedAndProject), so the grouped frame
    is computed once and never gathered whole.
    """
    from pyspark.sql import Window
    if agg == "count":
        vexpr = (F.sum(weight).cast("long") if weight else F.count(F.lit(1))).alias("value")
    else:
        vexpr = F.round(F.sum(value), 2).alias("value")
    grouped = df.groupBy(F.col(key).cast("string").alias("id")).agg(vexpr)
    order = [F.col("value").desc(), F.col("id").asc_nulls_last()]
    if pie_max is None:
        out = grouped.orderBy(*order)
        return out.limit(n) if n is not None else out
    head = grouped.orderBy(*order).limit(max(n or 0, pie_max + 1))
    w = Window.partitionBy()
    out = (head.withColumn("_groups", F.count(F.lit(1)).over(w))
               .withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
               .withColumn("chart", F.when(F.col("_groups") <= pie_max, F.lit("pie_chart"))
                                     .otherwise(F.lit("bar_chart"))))
    if n is not None:
        out = out.filter(F.col("_rank") <= n)
    return out.drop("_groups", "_rank")


def sales_by_category(df, category, amount):
    return top_groups(df, category, amount, 9, pie_max=12)


def count_by_category(df, category, max_distinct: int = 12, weight: str | None = None):
    """Counts per category, top 9, only when the category has <= 12 values."""
    from pyspark.sql import Window
    n = F.sum(weight).cast("long") if weight else F.count(F.lit(1))
    grouped = df.groupBy(F.col(category).cast("string").alias("id")).agg(n.alias("value"))
    order = [F.col("value").desc(), F.col("id").asc_nulls_last()]
    head = grouped.orderBy(*order).limit(max_distinct + 1)
    return (head.withColumn("_groups", F.count(F.lit(1)).over(Window.partitionBy()))
                .withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
                .filter((F.col("_groups") <= max_distinct) & (F.col("_rank") <= 9))
                .drop("_groups", "_rank"))


def sales_by_region(df, country, amount):
    return top_groups(df, country, amount, 10)


def orders_by_status(df, status, weight: str | None = None):
    return top_groups(df, status, None, None, agg="count", weight=weight)


def qty_by_category(df, category, quantity):
    return top_groups(df, category, quantity, 8)


def industry_context(df, target, weight: str | None = None):
    """Top 3 values of the product/category column by row count."""
    n = F.sum(weight).cast("long") if weight else F.count(F.lit(1))
    return (df.groupBy(F.col(target).cast("string").alias("id")).agg(n.alias("cnt"))
              .orderBy(F.col("cnt").desc(), F.col("id")).limit(3))


def period_total(df: DataFrame, date: str, metric: str, start: str, end: str) -> DataFrame:
    """``SUM(metric)`` with ``start <= date <= end`` (string bounds), 0 when empty."""
    return (df.select(date, metric)
              .filter((F.col(date) >= F.lit(start).cast("timestamp_ntz"))
                      & (F.col(date) <= F.lit(end).cast("timestamp_ntz")))
              .agg(F.round(F.coalesce(F.sum(metric), F.lit(0.0)), 2).alias("total")))


def slope_change(series: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """First and last point of a series and the % change between them."""
    return series.agg(
        F.min_by(F.col(y), F.col(x)).alias("first_y"),
        F.max_by(F.col(y), F.col(x)).alias("last_y"),
        F.min(x).alias("first_x"), F.max(x).alias("last_x"),
    ).select("first_x", "last_x", F.round("first_y", 2).alias("first_y"), F.round("last_y", 2).alias("last_y"),
             F.round(F.coalesce(F.try_divide((F.col("last_y") - F.col("first_y")) * 100.0, F.col("first_y")),
                                F.lit(0.0)), 2).alias("pct_change"))


def share_of_total(chart: DataFrame, value: str = "value") -> DataFrame:
    """value / total * 100 (1 decimal) over the rows of a chart (pie widget).

    ``chart`` is an already limited top-N frame (a handful of slices), so the
    total is an unpartitioned window over those rows.
    """
    from pyspark.sql import Window
    total = F.sum(value).over(Window.partitionBy())
    return chart.withColumn("share_pct", F.round(F.coalesce(F.try_divide(F.col(value) * 100.0, total),
                                                            F.lit(0.0)), 1))
