"""Monthly polynomial forecasts.

Months are the months present in the data (gaps are not filled), indexed
0..n-1.  The least-squares fit uses the centred index u = x - (n-1)/2, for
which odd power sums vanish, so the normal equations have a closed form:

    a = (S0*T2 - S2*T0) / (S0*S4 - S2^2)    b = T1 / S2    c = (T0 - a*S2) / S0

with Sk = sum u^k and Tk = sum u^k y.  All sums come from one aggregate over
the (small) monthly frame; predictions are built from a ``range`` frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monthly_series(df: DataFrame, date: str, value: str, null_as_zero: bool = False) -> DataFrame:
    """``(month, y, x, n, last_month)`` with x = 0..n-1 over the months present.

    One row per month, so the unpartitioned windows see a few hundred rows;
    n and the last month ride along instead of a second aggregate (which
    would evaluate the whole upstream plan again).
    """
    v = F.col(value).cast("double")
    if null_as_zero:
        v = F.coalesce(v, F.lit(0.0))
    monthly = (df.select(F.col(date).alias("_d"), v.alias("_y")).filter(F.col("_d").isNotNull())
                 .groupBy(F.date_format("_d", "yyyy-MM").alias("month"))
                 .agg(F.coalesce(F.sum("_y"), F.lit(0.0)).alias("y")))
    everything = Window.partitionBy()
    return (monthly.withColumn("x", (F.row_number().over(Window.orderBy("month")) - 1).cast("long"))
                   .withColumn("n", F.count(F.lit(1)).over(everything))
                   .withColumn("last_month", F.max("month").over(everything)))


def fit(series: DataFrame, degree: int = 2) -> DataFrame:
    """One row: n, last month and the coefficients in the centred index u = x - (n-1)/2."""
    xm = (F.col("n") - 1) / 2.0
    u = F.col("x") - xm
    s = (series.groupBy("n", "last_month")
               .agg(F.sum(u * u).alias("S2"), F.sum(u * u * u * u).alias("S4"), F.sum("y").alias("T0"),
                    F.sum(u * F.col("y")).alias("T1"), F.sum(u * u * F.col("y")).alias("T2"))
               .withColumn("xm", xm))
    S0, S2, S4, T0, T1, T2 = (F.col(c) for c in ("n", "S2", "S4", "T0", "T1", "T2"))
    if degree == 2:
        a = F.try_divide(S0 * T2 - S2 * T0, S0 * S4 - S2 * S2)
    else:
        a = F.lit(0.0)
    return s.select("n", "last_month", "xm", a.alias("a"), F.try_divide(T1, S2).alias("b"),
                    ((T0 - F.coalesce(a, F.lit(0.0)) * S2) / S0).alias("c"))


def predict(model: DataFrame, steps: int, min_months: int = 3) -> DataFrame:
    """``(step, month, value)`` for the next ``steps`` months after the last one."""
    spark = model.sparkSession
    st = spark.range(1, steps + 1).select(F.col("id").alias("step"))
    u = F.col("n") - 1 + F.col("step") - F.col("xm")
    return (model.filter(F.col("n") >= min_months).crossJoin(st)
                 .select("step",
                         F.date_format(F.add_months(F.to_date(F.concat(F.col("last_month"), F.lit("-01"))),
                                                    F.col("step").cast("int")), "yyyy-MM").alias("month"),
                         (F.col("a") * u * u + F.col("b") * u + F.col("c")).alias("value")))


def forecast_3m(df: DataFrame, date: str, amount: str) -> DataFrame:
    """Next 3 monthly totals from a quadratic fit (the insight pass)."""
    p = predict(fit(monthly_series(df, date, amount), 2), 3)
    return p.select(F.lit("Sales Forecast").alias("series"), F.lit("Next 3 Months").alias("period"),
                    "step", F.round("value", 2).alias("value"))


def forecast_horizon(df: DataFrame, date: str, value: str, horizon: int = 12) -> DataFrame:
    """Forecast tool: ``(month, forecast_value, total_predicted)``; needs >= 3 months."""
    p = predict(fit(monthly_series(df, date, value, null_as_zero=True), 2), horizon)
    p = p.select("month", F.round("value", 2).alias("forecast_value"))
    # ``horizon`` rows: a window total instead of a second pass over the data
    return p.withColumn("total_predicted", F.round(F.sum("forecast_value").over(Window.partitionBy()), 2))


def forecast_answer(df: DataFrame, date: str, value: str, horizon: int = 12) -> DataFrame:
    """The forecast tool's rows ``(month, forecast_value, total_predicted, error)``: the forecast, or
    one row that says why there is none."""
    rows = forecast_horizon(df, date, value, horizon).withColumn("error", F.lit(None).cast("string"))
    months = monthly_series(df, date, value, null_as_zero=True).agg(F.count(F.lit(1)).alias("n"))
    # Fixed value: the tool's message.
    text = F.format_string("Not enough monthly data points for forecasting. Found %d months. Need at least 3.", F.col("n"))
    none = months.filter("n < 3").select(F.lit(None).cast("string").alias("month"), F.lit(None).cast("double").alias("forecast_value"),
                                         F.lit(None).cast("double").alias("total_predicted"), text.alias("error"))
    return rows.unionByName(none)


def forecast_linear(df: DataFrame, date: str, amount: str, steps: int = 3) -> DataFrame:
    """Older degree-1 variant: ``(step, month, value)``."""
    p = predict(fit(monthly_series(df, date, amount), 1), steps, min_months=2)
    return p.select("step", "month", F.round("value", 2).alias("value"))


def forecast_values(forecast: DataFrame) -> DataFrame:
    """The insight record: one row with the ``forecast_values`` array (ordered by step)."""
    return forecast.groupBy("series", "period").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "value"))), lambda s: s["value"])
         .alias("forecast_values"))


def forecast_rows(record: DataFrame) -> DataFrame:
    """Unroll ``forecast_values`` to ``(x = 'Month i', y)`` chart rows."""
    return record.select(F.posexplode("forecast_values").alias("i", "y")).select(
        F.concat(F.lit("Month "), (F.col("i") + 1).cast("string")).alias("x"), F.round("y", 2).alias("y"))
