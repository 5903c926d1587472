"""Price elasticity and what-if scenarios.

The elasticity is a log-log least-squares slope over the rows the scenario
touches (``regr_slope`` / ``regr_r2``, one aggregate); the scenario's before
and after totals are one more aggregate with the elasticity joined in as a
1-row broadcast frame.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..roles import whatif_columns
from .guard import Guard, NotAllowed

PRICE_WORDS = ["price", "msrp", "cost"]


def elasticity(df: DataFrame, price: str, qty: str) -> DataFrame:
    """One row ``(elasticity, r_squared, n, description)``; -0.5 default with < 5 rows or one price."""
    p, q = F.col(price).cast("double"), F.col(qty).cast("double")
    v = df.select(p.alias("p"), q.alias("q")).filter((F.col("p") > 0) & (F.col("q") > 0))
    a = v.agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("pmin"), F.max("p").alias("pmax"),
              F.regr_slope(F.ln("q"), F.ln("p")).alias("slope"), F.regr_r2(F.ln("q"), F.ln("p")).alias("r2"))
    few, flat = F.col("n") < 5, F.col("pmin") == F.col("pmax")
    e = F.when(few | flat, F.lit(-0.5)).otherwise(F.greatest(F.least(F.col("slope"), F.lit(0.0)), F.lit(-5.0)))
    conf = F.when(F.col("r2") > 0.5, "High").otherwise("Low")
    desc = (F.when(few, F.lit("Default (-0.5) - Insufficient data points for regression"))
             .when(flat, F.lit("Default (-0.5) - No price variance in historical data"))
             .otherwise(F.format_string("Calculated %.2f (%s Confidence, R2=%.2f)", e, conf, F.col("r2"))))
    return a.select(e.alias("elasticity"), F.when(~(few | flat), F.col("r2")).alias("r_squared"),
                    F.col("n").cast("long").alias("n"), desc.alias("description"))


ERROR_COLUMNS = "scenario string, error string"


def what_if_by_name(df: DataFrame, target: str, operation: str, value: float, condition: str | None = None) -> DataFrame:
    """``what_if`` with the columns taken from their names; an error row where the scenario cannot be computed."""
    found = whatif_columns(df.columns, target)
    scenario = f"{operation} {target} by {value}"

    def error(text: str) -> DataFrame:
        return df.sparkSession.createDataFrame([(scenario, text)], ERROR_COLUMNS)

    if found["target"] is None:
        return error(f"no column matches '{target}'")
    if operation not in ("increase", "decrease", "set"):
        return error(f"unknown operation '{operation}'")
    try:
        out = what_if(df, found["target"], operation, value, condition, found["price"], found["quantity"], found["sales"])
    except NotAllowed as e:
        return error(f"Invalid filter condition: {e}")
    except (AnalysisException, ParseException) as e:
        return error(f"Invalid filter condition: {e.getCondition()}")
    if out.isEmpty():
        return error("No rows matched the filter condition.")  # fixed value: the tool's message
    return out


def what_if(df: DataFrame, target: str, operation: str, value: float, condition: str | None,
            price: str | None, qty: str | None, sales: str | None) -> DataFrame:
    """One summary row: before, after, difference, percent_change, rows_affected, assumptions.

    The condition is an expression of allowed functions over the columns (operators.guard); others raise ``NotAllowed``.
    """
    if operation not in ("increase", "decrease", "set"):
        raise ValueError(f"Unknown operation '{operation}'")
    if condition:
        Guard(df.sparkSession).check_filter(condition, df.columns)
    hit = F.expr(condition) if condition else F.lit(True)
    pct = value / 100.0 if operation == "increase" else -(value / 100.0) if operation == "decrease" else 0.0
    is_price = (price is not None and target == price) or any(w in target.lower() for w in PRICE_WORDS)
    use_el = is_price and qty is not None and pct != 0 and operation != "set"
    if use_el:
        el = elasticity(df.filter(hit), target, qty)
    else:
        el = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("elasticity"),
                                             F.lit(None).cast("double").alias("r_squared"),
                                             F.lit(0).cast("long").alias("n"),
                                             F.lit(None).cast("string").alias("description"))
    t = F.col(target).cast("double")
    new_t = F.lit(float(value)) if operation == "set" else t * (1 + pct)
    cols = {target: new_t}
    if use_el:
        cols[qty] = F.col(qty).cast("double") * (1 + pct * F.col("elasticity"))
    if sales and sales in cols:  # the scenario changes the measure itself
        new_sales = cols[sales]
    elif sales and price and qty:
        p_new = cols.get(price, F.col(price).cast("double"))
        q_new = cols.get(qty, F.col(qty).cast("double"))
        new_sales = q_new * p_new
    else:
        new_sales = F.col(sales).cast("double") if sales else F.lit(0.0)
    s_old = F.col(sales).cast("double") if sales else F.lit(0.0)
    agg = (df.crossJoin(F.broadcast(el)).select(hit.alias("_hit"), s_old.alias("_old"),
                                                F.when(hit, new_sales).otherwise(s_old).alias("_new"))
             .agg(F.sum("_old").alias("before"), F.sum("_new").alias("after"), F.count_if("_hit").alias("rows_affected")))
    assumptions = (F.array(F.concat(F.lit("Price Elasticity Model: "), F.col("description")),
                           F.format_string("Quantity Adjustment: %.1f%%", F.col("elasticity") * pct * 100))
                   if use_el else
                   (F.array(F.lit("Could not calculate elasticity (Quantity column not found).")) if qty is None
                    else F.array().cast("array<string>")))
    diff = F.col("after") - F.col("before")
    return (agg.crossJoin(F.broadcast(el)).filter(F.col("rows_affected") > 0)
               .select(F.lit(f"{operation} {target} by {value}").alias("scenario"),
                       F.lit(condition or "All Data").alias("filter"),
                       F.lit("Total Sales" if sales else "Unknown Metric").alias("impact_metric"),
                       F.round("before", 2).alias("before"), F.round("after", 2).alias("after"),
                       F.round(diff, 2).alias("difference"),
                       F.round(F.when(F.col("before") != 0, diff / F.col("before") * 100).otherwise(0.0), 4)
                        .alias("percent_change"),
                       F.col("rows_affected").cast("long").alias("rows_affected"),
                       F.round("elasticity", 4).alias("elasticity"),
                       F.array_join(assumptions, "; ").alias("assumptions")))
