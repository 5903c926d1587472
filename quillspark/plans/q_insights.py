"""Insight-pass queries: forecasts, RFM, anomalies, risk, baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomalies as AN
from ..operators import basket as BK
from ..operators import forecast as FC
from ..operators import rfm as RFM
from ..operators import risk as RK
from ..sources.tables import order_sales, period_sales, sales_view, sales_view_sql, table
from .registry import register

S = sales_view_sql

_FIT = f"""
WITH m AS (SELECT strftime(order_date, '%Y-%m') AS month, {{yexpr}} AS y
           FROM {S(['order_date', 'amount'])} WHERE order_date IS NOT NULL GROUP BY 1),
s AS (SELECT month, y, row_number() OVER (ORDER BY month) - 1 AS x FROM m),
g AS (SELECT count(*) AS n, max(month) AS last_month, avg(x) AS xm FROM s),
f AS (SELECT n, last_month, xm, sum((x - xm) * (x - xm)) AS S2,
             sum((x - xm) * (x - xm) * (x - xm) * (x - xm)) AS S4, sum(y) AS T0,
             sum((x - xm) * y) AS T1, sum((x - xm) * (x - xm) * y) AS T2
      FROM s CROSS JOIN g GROUP BY n, last_month, xm),
c AS (SELECT n, last_month, xm, {{aexpr}} AS a, T1 / S2 AS b, (T0 - {{aexpr}} * S2) / n AS c FROM f),
p AS (SELECT step, strftime(CAST(last_month || '-01' AS DATE) + to_months(CAST(step AS INTEGER)), '%Y-%m') AS month,
             a * (n - 1 + step - xm) * (n - 1 + step - xm) + b * (n - 1 + step - xm) + c AS value
      FROM c CROSS JOIN range(1, {{steps}} + 1) AS r(step) WHERE n >= {{min_n}})
"""
_QUAD = "(n * T2 - S2 * T0) / (n * S4 - S2 * S2)"


@register("forecast_3m", _FIT.format(yexpr="sum(amount)", aexpr=_QUAD, steps=3, min_n=3) + """
SELECT 'Sales Forecast' AS series, 'Next 3 Months' AS period, step, round(value, 2) AS value FROM p
""")
def q_forecast_3m(spark, sf):
    return FC.forecast_3m(order_sales(spark, sf, ["order_date"]), "order_date", "amount")


@register("forecast_horizon", _FIT.format(yexpr="coalesce(sum(coalesce(amount, 0)), 0)", aexpr=_QUAD,
                                          steps=12, min_n=3) + """
SELECT month, round(value, 2) AS forecast_value,
       (SELECT round(sum(round(value, 2)), 2) FROM p) AS total_predicted FROM p
""")
def q_forecast_horizon(spark, sf):
    return FC.forecast_horizon(order_sales(spark, sf, ["order_date"]), "order_date", "amount", 12)


@register("forecast_too_few", f"""
SELECT CAST(NULL AS VARCHAR) AS month, CAST(NULL AS DOUBLE) AS forecast_value, CAST(NULL AS DOUBLE) AS total_predicted,
       printf('Not enough monthly data points for forecasting. Found %d months. Need at least 3.', n) AS error
FROM (SELECT count(DISTINCT strftime(order_date, '%Y-%m')) AS n FROM {S(['order_date', 'amount'])}
      WHERE order_date >= TIMESTAMP '1996-01-01' AND order_date <= TIMESTAMP '1996-02-28') WHERE n < 3""")
def q_forecast_too_few(spark, sf):
    return FC.forecast_answer(period_sales(spark, sf, "1996-01-01", "1996-02-28"), "order_date", "amount")


@register("forecast_linear", _FIT.format(yexpr="sum(amount)", aexpr="0.0", steps=3, min_n=2) + """
SELECT step, month, round(value, 2) AS value FROM p
""")
def q_forecast_linear(spark, sf):
    return FC.forecast_linear(order_sales(spark, sf, ["order_date"]), "order_date", "amount")


@register("forecast_rows", _FIT.format(yexpr="sum(amount)", aexpr=_QUAD, steps=3, min_n=3) + """
SELECT 'Month ' || CAST(step AS VARCHAR) AS x, round(round(value, 2), 2) AS y FROM p
""")
def q_forecast_rows(spark, sf):
    fc = FC.forecast_3m(order_sales(spark, sf, ["order_date"]), "order_date", "amount")
    return FC.forecast_rows(FC.forecast_values(fc))


_RFM = f"""
WITH base AS (SELECT order_date AS d, customer_id, coalesce(CAST(amount AS DOUBLE), 0) AS a
              FROM {S(['order_date', 'amount', 'customer_id'])} WHERE order_date IS NOT NULL),
nw AS (SELECT max(epoch_us(d)) AS now FROM base),
per AS (SELECT customer_id, CAST(floor(((SELECT now FROM nw) - max(epoch_us(d))) / 86400000000) AS BIGINT) AS recency,
               count(*) AS frequency, sum(a) AS monetary
        FROM base WHERE customer_id IS NOT NULL GROUP BY customer_id),
rk AS (SELECT *, count(*) OVER () AS n,
              row_number() OVER (ORDER BY recency, customer_id) AS rr,
              row_number() OVER (ORDER BY frequency, customer_id) AS rf,
              row_number() OVER (ORDER BY monetary, customer_id) AS rm FROM per),
sc AS (SELECT customer_id, recency, frequency, monetary,
              CAST(5 - greatest(1, ((rr - 1) * 4 + n - 2) // (n - 1)) AS BIGINT) AS r_score,
              CAST(greatest(1, ((rf - 1) * 4 + n - 2) // (n - 1)) AS BIGINT) AS f_score,
              CAST(greatest(1, ((rm - 1) * 4 + n - 2) // (n - 1)) AS BIGINT) AS m_score
       FROM rk WHERE n >= 2),
seg AS (SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'Champions'
                       WHEN r_score >= 3 AND f_score >= 3 THEN 'Loyal'
                       WHEN r_score >= 2 AND f_score <= 2 THEN 'At Risk'
                       WHEN r_score <= 1 THEN 'Hibernating' ELSE 'General' END AS segment FROM sc)
"""


@register("rfm_customers", _RFM + """
SELECT customer_id, recency, frequency, round(monetary, 2) AS monetary, r_score, f_score, m_score, segment FROM seg
""")
def q_rfm_customers(spark, sf):
    c = RFM.rfm_table(order_sales(spark, sf, ["order_date", "customer_id"]),
                      "order_date", "amount", "customer_id", weight="lines")
    return c.withColumn("monetary", F.round("monetary", 2))


@register("rfm_segments", _RFM + """
SELECT segment, count(*) AS count, round(avg(monetary), 2) AS avg_monetary,
       CASE segment WHEN 'Champions' THEN 'Best customers, buy often and recently.'
                    WHEN 'Loyal' THEN 'Steady spenders, good retention.'
                    WHEN 'At Risk' THEN 'Big spenders who haven''t visited lately.'
                    WHEN 'Hibernating' THEN 'Lost customers, low value.'
                    WHEN 'General' THEN 'Average customers.' ELSE '' END AS description
FROM seg GROUP BY segment
""")
def q_rfm_segments(spark, sf):
    c = RFM.rfm_table(order_sales(spark, sf, ["order_date", "customer_id"]),
                      "order_date", "amount", "customer_id", weight="lines")
    return RFM.rfm_segments(c)


_EVENT_NUM = ["event_id", "user_id", "value"]


def _anomaly_cells(tab, cols, rid):
    st = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(cols))
    parts = [f"SELECT {i}::BIGINT AS col_pos, '{c}' AS \"column\", {rid} AS row_id, CAST({c} AS DOUBLE) AS value, "
             f"({c} - m{i}) / s{i} AS z FROM {tab}, st WHERE s{i} IS NOT NULL AND s{i} <> 0 AND {c} IS NOT NULL"
             for i, c in enumerate(cols)]
    return f"WITH st AS (SELECT {st} FROM {tab}), cells AS ({' UNION ALL '.join(parts)})"


@register("anomalies", _anomaly_cells("events", _EVENT_NUM, "event_id") + """
SELECT col_pos, "column", row_id, round(value, 4) AS value, round(z, 4) AS z_score
FROM cells WHERE abs(z) > 2 ORDER BY col_pos, row_id LIMIT 6
""")
def q_anomalies(spark, sf):
    return AN.anomalies(table(spark, sf, "events"), _EVENT_NUM, "event_id")


@register("anomaly_severity", _anomaly_cells("events", ["user_id", "value"], "event_id") + """
SELECT "column", row_id, round(value, 4) AS value, round(z, 4) AS z_score,
       CASE WHEN abs(z) >= 3 THEN 'Critical' WHEN abs(z) >= 2 THEN 'Warning' ELSE 'Minor' END AS severity,
       CASE WHEN abs(z) > 3 THEN 'Critical' WHEN abs(z) > 2 THEN 'High' ELSE 'Low' END AS table_severity
FROM cells WHERE abs(z) > 2
""")
def q_anomaly_severity(spark, sf):
    hits = AN.anomaly_hits(table(spark, sf, "events"), ["user_id", "value"], "event_id")
    return AN.anomaly_severity(hits)


@register("risk_analysis", """
WITH c AS (SELECT CAST(o_orderstatus AS VARCHAR) AS status, count(*) AS cnt FROM orders
           WHERE o_orderstatus IS NOT NULL GROUP BY 1),
t AS (SELECT sum(cnt) AS total FROM c),
kw AS (SELECT * FROM (VALUES (0, 'P')) k(kpos, keyword)),
m AS (SELECT kpos, status, cnt, cnt / total AS share FROM c JOIN kw ON contains(lower(status), lower(keyword)) CROSS JOIN t),
a AS (SELECT sum(share * 100) AS score,
             string_agg(printf('%s: %.1f%%', status, share * 100), ', ' ORDER BY kpos, cnt DESC, status) AS reason FROM m)
SELECT round(score, 4) AS risk_score,
       CASE WHEN score > 10 THEN 'High' WHEN score > 5 THEN 'Medium' ELSE 'Low' END AS risk_level, reason
FROM a WHERE score > 0
""")
def q_risk_analysis(spark, sf):
    return RK.risk_analysis(table(spark, sf, "orders"), "o_orderstatus", ["P"])


def _basket_sql(item: str) -> str:
    return f"""
WITH t AS (SELECT order_id AS o, CAST({item} AS VARCHAR) AS i FROM {S(['order_id', item])}
           WHERE order_id IS NOT NULL AND {item} IS NOT NULL),
q AS (SELECT o FROM t GROUP BY o HAVING count(*) >= 2),
bi AS (SELECT DISTINCT o, i FROM t WHERE o IN (SELECT o FROM q)),
nb AS (SELECT count(*) AS n FROM q),
it AS (SELECT i, count(*) AS supp FROM bi GROUP BY i),
p AS (SELECT a.i AS A, b.i AS B, count(*) AS support FROM bi a JOIN bi b ON a.o = b.o AND a.i < b.i GROUP BY 1, 2),
tp AS (SELECT p.*, ia.supp AS sa, ib.supp AS sb FROM p JOIN it ia ON ia.i = p.A JOIN it ib ON ib.i = p.B
       ORDER BY support DESC, A, B LIMIT 15),
rules AS (SELECT A AS antecedent, B AS consequent, support, round(support / sa, 2) AS confidence,
                 round((support / sa) / (sb / n), 2) AS lift
          FROM tp CROSS JOIN nb WHERE (support / sa) / (sb / n) > 1 AND n >= 10)
"""


_BASKET = _basket_sql("product")


@register("basket_rules", _BASKET + "SELECT * FROM rules")
def q_basket_rules(spark, sf):
    return BK.basket_rules(sales_view(spark, sf, ["order_id", "product"]), "order_id", "product")


@register("basket_rules_by_name", _basket_sql("product_name") + "SELECT * FROM rules")
def q_basket_rules_by_name(spark, sf):
    return BK.basket_rules(sales_view(spark, sf, ["order_id", "product_name"]), "order_id", "product_name")


@register("basket_bands", _BASKET + """
SELECT antecedent, consequent,
       CASE WHEN lift >= 2.5 THEN 'strong' WHEN lift >= 1.5 THEN 'moderate' ELSE 'weak' END AS lift_band,
       CAST(round(confidence * 100) AS BIGINT) AS confidence_pct,
       antecedent || ', ' || consequent AS items_text, printf('%.2f', lift) AS lift_text
FROM rules
""")
def q_basket_bands(spark, sf):
    rules = BK.basket_rules(sales_view(spark, sf, ["order_id", "product"]), "order_id", "product")
    return BK.basket_bands(rules)
