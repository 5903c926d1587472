"""Assistant-tool queries: diagnose, elasticity, what-if, guarded SQL, chart rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnose as DG
from ..operators import kpis as K
from ..operators import shape as SH
from ..operators import sqltool as SQ
from ..operators import tools as TOOLS
from ..operators import whatif as WI
from ..roles import diagnostic_columns
from ..sources.tables import sales_view, sales_view_sql, table
from . import q_insights as _q_insights  # noqa: F401  (its forecast SQL counts the tool's rows)
from .registry import ORACLE, register

S = sales_view_sql
_DIAG_ROLES = ["order_date", "amount", "country", "category", "status", "product"]
CUR = ("1996-01-01", "1996-12-31")
PREV = ("1995-01-01", "1995-12-31")


def _diag_sql():
    date_col, dims = diagnostic_columns(_DIAG_ROLES)
    cur = f"(order_date >= TIMESTAMP '{CUR[0]}' AND order_date <= TIMESTAMP '{CUR[1]}')"
    prv = f"(order_date >= TIMESTAMP '{PREV[0]}' AND order_date <= TIMESTAMP '{PREV[1]}')"
    per = " UNION ALL ".join(
        f"SELECT {i} AS dim_pos, '{d}' AS dimension, CAST({d} AS VARCHAR) AS segment, "
        f"sum(CASE WHEN {cur} THEN amount ELSE 0 END) AS current, sum(CASE WHEN {prv} THEN amount ELSE 0 END) AS previous "
        f"FROM b GROUP BY 3" for i, d in enumerate(dims))
    return f"""
WITH b AS (SELECT * FROM {S(_DIAG_ROLES)} WHERE {cur} OR {prv}),
tot AS (SELECT coalesce(sum(amount) FILTER (WHERE {cur}), 0) AS tc, coalesce(sum(amount) FILTER (WHERE {prv}), 0) AS tp FROM b),
per AS ({per}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim_pos ORDER BY abs(current - previous) DESC, segment) AS r
                        FROM per WHERE previous > 0 OR current > 0) WHERE r = 1),
d AS (SELECT best.*, current - previous AS delta,
             CASE WHEN abs(tc - tp) > 0 THEN abs((current - previous) / (tc - tp)) * 100 ELSE 0 END AS contribution_pct,
             tc, tp FROM best CROSS JOIN tot WHERE tp <> 0)
SELECT dimension, segment, round(current, 2) AS current, round(previous, 2) AS previous, round(delta, 2) AS delta,
       round(contribution_pct, 2) AS contribution_pct, CASE WHEN delta < 0 THEN 'dropped' ELSE 'grew' END AS impact,
       round(tc, 2) AS total_current, round(tp, 2) AS total_previous, round((tc - tp) / tp * 100, 2) AS pct_change,
       CASE WHEN tc - tp < 0 THEN 'dropped' ELSE 'increased' END AS direction
FROM d ORDER BY contribution_pct DESC, dim_pos LIMIT 3"""


@register("diagnose", _diag_sql())
def q_diagnose(spark, sf):
    df = sales_view(spark, sf, _DIAG_ROLES)
    date_col, dims = diagnostic_columns(df.columns)
    return DG.diagnose(df, date_col, "amount", dims, CUR[0], CUR[1], PREV[0], PREV[1])


@register("diagnose_no_previous", f"""
SELECT CAST(NULL AS VARCHAR) AS dimension, round(coalesce(sum(amount), 0), 2) AS total_current,
       'Previous period (1970-01-01 to 1970-12-31) has 0 value. Cannot calculate change.' AS analysis
FROM {S(_DIAG_ROLES)} WHERE order_date >= TIMESTAMP '{CUR[0]}' AND order_date <= TIMESTAMP '{CUR[1]}'""")
def q_diagnose_no_previous(spark, sf):
    df = sales_view(spark, sf, _DIAG_ROLES)
    _, dims = diagnostic_columns(df.columns)
    return DG.diagnose_answer(df, "order_date", "amount", dims, CUR[0], CUR[1], "1970-01-01", "1970-12-31").select(
        "dimension", "total_current", "analysis")


def _items(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
                     F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("sales"),
                     F.col("l_returnflag").alias("returnflag"))


_ITEMS_SQL = ("SELECT l_extendedprice / l_quantity AS unit_price, l_quantity AS quantity, "
              "l_extendedprice AS sales, l_returnflag AS returnflag FROM lineitem")
_EL_SQL = f"""
WITH d AS ({_ITEMS_SQL}),
v AS (SELECT unit_price AS p, quantity AS q FROM d WHERE returnflag = 'R' AND unit_price > 0 AND quantity > 0),
a AS (SELECT count(*) AS n, min(p) AS pmin, max(p) AS pmax, regr_slope(ln(q), ln(p)) AS slope, regr_r2(ln(q), ln(p)) AS r2 FROM v),
e AS (SELECT CASE WHEN n < 5 OR pmin = pmax THEN -0.5 ELSE greatest(least(slope, 0.0), -5.0) END AS el, r2, n,
             (n < 5 OR pmin = pmax) AS dflt FROM a),
ed AS (SELECT el, CASE WHEN NOT dflt THEN r2 END AS r_squared, n,
              CASE WHEN n < 5 THEN 'Default (-0.5) - Insufficient data points for regression'
                   WHEN dflt THEN 'Default (-0.5) - No price variance in historical data'
                   ELSE printf('Calculated %.2f (%s Confidence, R2=%.2f)', el, CASE WHEN r2 > 0.5 THEN 'High' ELSE 'Low' END, r2)
              END AS description FROM e)"""


@register("elasticity", _EL_SQL + """
SELECT round(el, 4) AS elasticity, round(r_squared, 4) AS r_squared, n, description FROM ed""")
def q_elasticity(spark, sf):
    e = WI.elasticity(_items(spark, sf).filter(F.col("returnflag") == "R"), "unit_price", "quantity")
    return e.select(F.round("elasticity", 4).alias("elasticity"), F.round("r_squared", 4).alias("r_squared"),
                    "n", "description")


@register("what_if", _EL_SQL + """,
agg AS (SELECT sum(sales) AS before,
               sum(CASE WHEN returnflag = 'R' THEN (quantity * (1 + 0.1 * el)) * (unit_price * 1.1) ELSE sales END) AS after,
               count(*) FILTER (WHERE returnflag = 'R') AS rows_affected FROM d CROSS JOIN ed)
SELECT 'increase unit_price by 10.0' AS scenario, 'returnflag = ''R''' AS filter, 'Total Sales' AS impact_metric,
       round(before, 2) AS before, round(after, 2) AS after, round(after - before, 2) AS difference,
       round(CASE WHEN before <> 0 THEN (after - before) / before * 100 ELSE 0 END, 4) AS percent_change,
       rows_affected, round(el, 4) AS elasticity,
       'Price Elasticity Model: ' || description || '; ' || printf('Quantity Adjustment: %.1f%%', el * 0.1 * 100) AS assumptions
FROM agg CROSS JOIN ed WHERE rows_affected > 0""")
def q_what_if(spark, sf):
    return WI.what_if(_items(spark, sf), "unit_price", "increase", 10.0, "returnflag = 'R'",
                      price="unit_price", qty="quantity", sales="sales")


def _scenario_sql(hit: str, name: str, label: str, new: str, note: str) -> str:
    return f"""
WITH d AS ({_ITEMS_SQL}),
agg AS (SELECT sum(sales) AS before, sum(CASE WHEN {hit} THEN {new} ELSE sales END) AS after, count(*) FILTER (WHERE {hit}) AS rows_affected FROM d)
SELECT '{name}' AS scenario, '{label}' AS filter, 'Total Sales' AS impact_metric,
       round(before, 2) AS before, round(after, 2) AS after, round(after - before, 2) AS difference,
       round(CASE WHEN before <> 0 THEN (after - before) / before * 100 ELSE 0 END, 4) AS percent_change,
       rows_affected, CAST(NULL AS DOUBLE) AS elasticity, '{note}' AS assumptions
FROM agg WHERE rows_affected > 0"""


@register("what_if_sales", _scenario_sql("returnflag = 'A'", "increase sales by 10.0", "returnflag = ''A''", "sales * 1.1", ""))
def q_what_if_sales(spark, sf):
    return WI.what_if_by_name(_items(spark, sf), "SALES", "increase", 10.0, "returnflag = 'A'")


@register("what_if_set", _scenario_sql("TRUE", "set unit_price by 1000.0", "All Data", "quantity * 1000.0", ""))
def q_what_if_set(spark, sf):
    return WI.what_if_by_name(_items(spark, sf), "unit_price", "set", 1000.0)


# Filters of a scenario: one that is computed, and ones that are refused, with the reason.
FILTERS = [("returnflag = (SELECT max(value) FROM text.`/etc/hostname`)", "Invalid filter condition: a subquery is not allowed here"),
           ("java_method('java.lang.System', 'getProperty', 'user.home') IS NOT NULL", "Invalid filter condition: function not allowed: java_method"),
           ("returnflag = 'Q'", "No rows matched the filter condition."), ("returnflag ===== 'R'", "Invalid filter condition: PARSE_SYNTAX_ERROR")]


@register("what_if_filters", f"""
WITH d AS ({_ITEMS_SQL})
SELECT 'increase sales by 10.0' AS scenario, CAST(NULL AS VARCHAR) AS error, count(*) AS rows_affected FROM d WHERE returnflag = 'R'
""" + "\n".join(f"UNION ALL SELECT 'increase sales by 10.0', '{why}', NULL" for _, why in FILTERS))
def q_what_if_filters(spark, sf):
    items = _items(spark, sf)
    out = WI.what_if_by_name(items, "sales", "increase", 10.0, "returnflag = 'R'").select(
        "scenario", F.lit(None).cast("string").alias("error"), "rows_affected")
    for condition, _ in FILTERS:
        refused = WI.what_if_by_name(items, "sales", "increase", 10.0, condition)
        out = out.unionByName(refused.select("scenario", "error", F.lit(None).cast("long").alias("rows_affected")))
    return out


GUARDED = ("SELECT status, COUNT(*) AS n, ROUND(SUM(amount), 2) AS revenue FROM data "
           "GROUP BY status ORDER BY n DESC LIMIT 10")


@register("guarded_sql", GUARDED.replace("FROM data", "FROM " + S(["status", "amount"])))
def q_guarded_sql(spark, sf):
    return SQ.run_guarded(spark, sales_view(spark, sf, ["status", "amount"]), GUARDED)


JOINED = ("SELECT a.status, COUNT(*) AS n FROM (SELECT DISTINCT status, category FROM data) a "
          "JOIN (SELECT DISTINCT category, country FROM data) b ON a.category = b.category GROUP BY a.status ORDER BY n DESC, a.status LIMIT 10")


@register("guarded_sql_join", JOINED.replace("FROM data", "FROM " + S(["status", "category", "country"])))
def q_guarded_sql_join(spark, sf):
    return SQ.run_guarded(spark, sales_view(spark, sf, ["status", "category", "country"]), JOINED)


COMMA = "SELECT a.status, COUNT(*) AS n FROM (SELECT DISTINCT status, category FROM data) a, (SELECT DISTINCT category FROM dataset) b WHERE a.category = b.category GROUP BY a.status ORDER BY n DESC, a.status LIMIT 10"
# Statements that must be refused, and why.
REFUSED = [("DROP TABLE data", "only a query is allowed, not DropTable"), ("SELECT * FROM orders LIMIT 5", "relation not allowed: orders"),
           ("SELECT java_method('java.lang.System', 'getProperty', 'user.home') AS v FROM data LIMIT 1", "function not allowed: java_method"),
           ("SELECT status FROM data WHERE reflect('java.lang.System', 'getProperty', 'user.home') IS NOT NULL LIMIT 1", "function not allowed: reflect"),
           ("SELECT (SELECT max(value) FROM text.`/etc/hostname`) AS v FROM data LIMIT 1", "relation not allowed: text./etc/hostname"),
           ("SELECT * FROM data LIMIT 500", "LIMIT 500 is over 100")]


@register("guarded_sql_answer", f"""
WITH r AS ({GUARDED.replace("FROM data", "FROM " + S(["status", "amount", "category"]))}),
c AS ({COMMA.replace("FROM dataset", "FROM " + S(["category"])).replace("FROM data", "FROM " + S(["status", "category"]))})
SELECT true AS ok, CAST(NULL AS VARCHAR) AS error, 'status,n,revenue' AS columns, count(*) AS row_count FROM r
UNION ALL SELECT true, NULL, 'status,n', count(*) FROM c
""" + "\n".join(f"UNION ALL SELECT false, '{why}', NULL, 0" for _, why in REFUSED))
def q_guarded_sql_answer(spark, sf):
    df = sales_view(spark, sf, ["status", "amount", "category"])
    answers = [SQ.answer(spark, df, q).select("ok", "error", "columns", "row_count") for q in (GUARDED, COMMA, *(q for q, _ in REFUSED))]
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


DATASET_SQL = "SELECT strftime('%Y-%m', order_date) as x, COUNT(*) as y FROM dataset GROUP BY x ORDER BY x"


@register("sql_dataset", DATASET_SQL.replace("FROM dataset", "FROM " + S(["order_date"])))
def q_sql_dataset(spark, sf):
    return SQ.run_guarded(spark, sales_view(spark, sf, ["order_date"]), DATASET_SQL, bypass=True)


@register("chart_rows", f"""
SELECT CAST(status AS VARCHAR) AS name, CAST(count(*) AS DOUBLE) AS value FROM {S(['status'])} GROUP BY 1""")
def q_chart_rows(spark, sf):
    return SH.chart_rows(K.orders_by_status(sales_view(spark, sf, ["status"]), "status"))


# Calls of the data tools that must fail, and their errors.
TOOL_FAULTS = [("simulate_scenario", {"target": "nothing", "operation": "increase", "value": 5.0}, "no column matches 'nothing'"),
               ("execute_sql_query", {"query": "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM data LIMIT 1"}, "function not allowed: reflect"),
               ("generate_forecast", {"horizon": 0}, "the horizon must be 1 to 100 months"), ("search_internet", {"query": "x"}, "unknown tool 'search_internet'")]
_TOOL_ROLES = ["order_date", "amount", "country", "category", "status", "product"]


@register("tool_calls", f"""
SELECT 'execute_sql_query' AS tool, true AS ok, CAST(NULL AS VARCHAR) AS error, 'status,n,revenue' AS columns, count(*) AS row_count
FROM ({GUARDED.replace("FROM data", "FROM " + S(_TOOL_ROLES))})
UNION ALL SELECT 'generate_forecast', true, NULL, 'month,forecast_value,total_predicted', count(*) FROM ({ORACLE["forecast_horizon"]})
UNION ALL SELECT 'diagnose_change', true, NULL, 'dimension,segment,current,previous,delta,contribution_pct,impact,total_current,total_previous,pct_change,direction,analysis',
  count(*) FROM ({ORACLE["diagnose"]})
UNION ALL SELECT 'simulate_scenario', true, NULL,
  'scenario,filter,impact_metric,before,after,difference,percent_change,rows_affected,elasticity,assumptions', 1
""" + "\n".join("UNION ALL SELECT '{}', false, '{}', NULL, 0".format(tool, error.replace("'", "''")) for tool, _, error in TOOL_FAULTS))
def q_tool_calls(spark, sf):
    df = sales_view(spark, sf, _TOOL_ROLES)
    calls = [("execute_sql_query", {"query": GUARDED}), ("generate_forecast", {"horizon": 12}),
             ("diagnose_change", {"metric": "amount", "start": CUR[0], "end": CUR[1], "compare_start": PREV[0], "compare_end": PREV[1]}),
             ("simulate_scenario", {"target": "amount", "operation": "increase", "value": 10.0, "condition": "status = 'F'"})]
    out = None
    for tool, arguments in [*calls, *((t, a) for t, a, _ in TOOL_FAULTS)]:
        row = TOOLS.call(df, tool, **arguments).drop("rows")
        out = row if out is None else out.unionByName(row)
    return out
