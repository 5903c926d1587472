"""Roll-up queries on the bound sales view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpis as K
from ..sources.tables import customer_sales, order_sales, period_sales, part_sales, sales_view, sales_view_sql
from .registry import register

S = sales_view_sql


@register("kpis", f"""
WITH s AS (SELECT count(*) AS n_rows, sum(amount) AS s_amount, sum(quantity) AS s_qty,
                  count(DISTINCT order_id) AS n_orders
           FROM {S(['order_id', 'amount', 'quantity'])})
SELECT 0::BIGINT AS pos, 'total_revenue' AS id, 'Total Revenue' AS label, round(s_amount, 2) AS value FROM s
UNION ALL SELECT 1, 'avg_order_value', 'Avg Order Value', round(coalesce(s_amount / nullif(n_orders, 0), 0), 2) FROM s
UNION ALL SELECT 2, 'total_units', 'Total Units Sold', round(s_qty, 2) FROM s
UNION ALL SELECT 3, 'total_orders', 'Total Orders', round(n_orders::DOUBLE, 2) FROM s
UNION ALL SELECT 4, 'total_records', 'Total Records', round(n_rows::DOUBLE, 2) FROM s
""")
def q_kpis(spark, sf):
    df = sales_view(spark, sf, ["order_id", "amount", "quantity"])
    return K.kpis(df, amount="amount", order_id="order_id", quantity="quantity")


@register("orders_over_time", f"""
WITH m AS (SELECT strftime(order_date, '%Y-%m') AS x, count(*) AS y
           FROM {S(['order_date'])} WHERE order_date IS NOT NULL GROUP BY 1)
SELECT x, y FROM m WHERE (SELECT count(*) FROM m) >= 2 AND (SELECT sum(y) FROM m) >= 3
""")
def q_orders_over_time(spark, sf):
    return K.orders_over_time(order_sales(spark, sf, ["order_date"]), "order_date", weight="lines")


@register("revenue_over_time", f"""
WITH m AS (SELECT strftime(order_date, '%Y-%m') AS x, round(sum(amount), 2) AS y
           FROM {S(['order_date', 'amount'])} WHERE order_date IS NOT NULL GROUP BY 1)
SELECT x, y FROM m WHERE (SELECT count(*) FROM m) >= 2
""")
def q_revenue_over_time(spark, sf):
    return K.revenue_over_time(order_sales(spark, sf, ["order_date"]), "order_date", "amount")


@register("sales_by_category", f"""
WITH g AS (SELECT CAST(category AS VARCHAR) AS id, round(sum(amount), 2) AS value
           FROM {S(['category', 'amount'])} GROUP BY 1)
SELECT id, value, CASE WHEN (SELECT count(*) FROM g) <= 12 THEN 'pie_chart' ELSE 'bar_chart' END AS chart
FROM g ORDER BY value DESC, id LIMIT 9
""")
def q_sales_by_category(spark, sf):
    return K.sales_by_category(part_sales(spark, sf, ["category"]), "category", "amount")


@register("count_by_category", f"""
WITH g AS (SELECT CAST(category AS VARCHAR) AS id, count(*) AS value FROM {S(['category'])} GROUP BY 1)
SELECT id, value FROM g WHERE (SELECT count(*) FROM g) <= 12 ORDER BY value DESC, id LIMIT 9
""")
def q_count_by_category(spark, sf):
    return K.count_by_category(part_sales(spark, sf, ["category"]), "category", weight="lines")


@register("sales_by_region", f"""
SELECT CAST(country AS VARCHAR) AS id, round(sum(amount), 2) AS value
FROM {S(['country', 'amount'])} GROUP BY 1 ORDER BY value DESC, id LIMIT 10
""")
def q_sales_by_region(spark, sf):
    return K.sales_by_region(customer_sales(spark, sf), "country", "amount")


@register("orders_by_status", f"""
SELECT CAST(status AS VARCHAR) AS id, count(*) AS value FROM {S(['status'])} GROUP BY 1
""")
def q_orders_by_status(spark, sf):
    return K.orders_by_status(order_sales(spark, sf, ["status"]), "status", weight="lines")


@register("qty_by_category", f"""
SELECT CAST(category AS VARCHAR) AS id, round(sum(quantity), 2) AS value
FROM {S(['category', 'quantity'])} GROUP BY 1 ORDER BY value DESC, id LIMIT 8
""")
def q_qty_by_category(spark, sf):
    return K.qty_by_category(part_sales(spark, sf, ["category"]), "category", "quantity")


@register("industry_context", f"""
SELECT CAST(product AS VARCHAR) AS id, count(*) AS cnt FROM {S(['product'])}
GROUP BY 1 ORDER BY cnt DESC, id LIMIT 3
""")
def q_industry_context(spark, sf):
    return K.industry_context(part_sales(spark, sf, ["product"]), "product", weight="lines")


@register("period_total", f"""
SELECT round(coalesce(sum(amount), 0), 2) AS total FROM {S(['order_date', 'amount'])}
WHERE order_date >= TIMESTAMP '1996-01-01' AND order_date <= TIMESTAMP '1996-12-31'
""")
def q_period_total(spark, sf):
    period = ("1996-01-01", "1996-12-31")
    return K.period_total(period_sales(spark, sf, *period), "order_date", "amount", *period)


@register("slope_change", f"""
WITH m AS (SELECT strftime(order_date, '%Y-%m') AS x, sum(amount) AS y
           FROM {S(['order_date', 'amount'])} WHERE order_date IS NOT NULL GROUP BY 1),
     e AS (SELECT min(x) AS first_x, max(x) AS last_x, arg_min(y, x) AS fy, arg_max(y, x) AS ly FROM m)
SELECT first_x, last_x, round(fy, 2) AS first_y, round(ly, 2) AS last_y,
       round(coalesce((ly - fy) * 100.0 / nullif(fy, 0), 0), 2) AS pct_change FROM e
""")
def q_slope_change(spark, sf):
    df = order_sales(spark, sf, ["order_date"]).filter(F.col("order_date").isNotNull())
    monthly = df.groupBy(F.date_format("order_date", "yyyy-MM").alias("x")).agg(F.sum("amount").alias("y"))
    return K.slope_change(monthly)


@register("share_of_total", f"""
WITH g AS (SELECT CAST(category AS VARCHAR) AS id, round(sum(amount), 2) AS value
           FROM {S(['category', 'amount'])} GROUP BY 1),
t AS (SELECT id, value, CASE WHEN (SELECT count(*) FROM g) <= 12 THEN 'pie_chart' ELSE 'bar_chart' END AS chart
      FROM g ORDER BY value DESC, id LIMIT 9)
SELECT id, value, chart, round(coalesce(value * 100.0 / nullif((SELECT sum(value) FROM t), 0), 0), 1) AS share_pct FROM t
""")
def q_share_of_total(spark, sf):
    chart = K.sales_by_category(part_sales(spark, sf, ["category"]), "category", "amount")
    return K.share_of_total(chart)
