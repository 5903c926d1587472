"""Readers for the driver's parquet tables and the bound sales view.

The driver's schema is normalised (TPC-H style); the reference works on one
wide sales table.  ``sales_view`` binds the reference's column roles to the
normalised tables and joins only what the requested roles need, so a query
on (order_date, amount) never pays for the customer or part joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Role -> (source table, expression).  Fixed binding of the reference's
# sales roles onto the driver tables.
SALES_ROLES = {
    "order_id": ("lineitem", "l_orderkey"),
    "line_no": ("lineitem", "l_linenumber"),
    "amount": ("lineitem", "l_extendedprice"),
    "quantity": ("lineitem", "l_quantity"),
    "customer_id": ("orders", "o_custkey"),
    "order_date": ("orders", "o_orderdate"),
    "status": ("orders", "o_orderstatus"),
    "priority": ("orders", "o_orderpriority"),
    "product": ("part", "p_brand"),
    "product_name": ("part", "p_name"),
    "category": ("part", "p_type"),
    "country": ("nation", "n_name"),
}


def sales_view(spark: SparkSession, sf_dir: str, roles: list[str]) -> DataFrame:
    """lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ part, pruned to ``roles``.

    Joins are equi-joins on keys; AQE picks broadcast for the sides that are
    measured small at runtime and sort-merge (with skew splitting) otherwise.
    ``nation`` is a fixed 25-row dimension and is always broadcast.
    """
    need = {SALES_ROLES[r][0] for r in roles}
    li_cols = {"l_orderkey"}
    if "part" in need:
        li_cols.add("l_partkey")
    for r in roles:
        t, c = SALES_ROLES[r]
        if t == "lineitem":
            li_cols.add(c)
    df = table(spark, sf_dir, "lineitem").select(*sorted(li_cols))
    if need & {"orders", "nation"}:
        o_cols = {"o_orderkey"} | {SALES_ROLES[r][1] for r in roles if SALES_ROLES[r][0] == "orders"}
        if "nation" in need:
            o_cols.add("o_custkey")
        orders = table(spark, sf_dir, "orders").select(*sorted(o_cols))
        df = df.join(orders, df.l_orderkey == orders.o_orderkey, "inner")
    if "nation" in need:
        cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        df = (df.join(cust, df.o_custkey == cust.c_custkey, "inner")
                .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "inner"))
    if "part" in need:
        p_cols = {SALES_ROLES[r][1] for r in roles if SALES_ROLES[r][0] == "part"}
        part = table(spark, sf_dir, "part").select("p_partkey", *sorted(p_cols))
        df = df.join(part, df.l_partkey == part.p_partkey, "inner")
    return df.select(*[F.col(SALES_ROLES[r][1]).alias(r) for r in roles])


def sales_view_sql(roles: list[str]) -> str:
    """The same view as a DuckDB/ANSI SQL subquery (for the oracle)."""
    need = {SALES_ROLES[r][0] for r in roles}
    sel = ", ".join(f"{SALES_ROLES[r][1]} AS {r}" for r in roles)
    sql = f"SELECT {sel} FROM lineitem"
    if need & {"orders", "nation"}:
        sql += " JOIN orders ON l_orderkey = o_orderkey"
    if "nation" in need:
        sql += " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    if "part" in need:
        sql += " JOIN part ON l_partkey = p_partkey"
    return f"({sql})"


def order_sales(spark: SparkSession, sf_dir: str, roles: list[str]) -> DataFrame:
    """The sales view pre-aggregated to one row per order.

    For roll-ups whose keys are order attributes (date, customer, status),
    summing lineitem per order *before* the join shrinks the shuffle to one
    row per order and collapses a hot order map-side; the join then reuses
    the aggregate's hash partitioning on the order key.  Columns: the order
    roles requested plus ``amount`` (sum), ``quantity`` (sum) and ``lines``
    (row count), which downstream sums/counts combine exactly as on the
    line-level view (``count(*)`` becomes ``sum(lines)``).
    """
    lines = (table(spark, sf_dir, "lineitem")
             .groupBy("l_orderkey")
             .agg(F.sum("l_extendedprice").alias("amount"), F.sum("l_quantity").alias("quantity"),
                  F.count(F.lit(1)).alias("lines")))
    o_roles = [r for r in roles if SALES_ROLES[r][0] == "orders"]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", *[SALES_ROLES[r][1] for r in o_roles])
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "inner")
    return joined.select(F.col("l_orderkey").alias("order_id"), *[F.col(SALES_ROLES[r][1]).alias(r) for r in o_roles],
                         "amount", "quantity", "lines")


def period_sales(spark: SparkSession, sf_dir: str, start: str, end: str) -> DataFrame:
    """``(order_date, amount)`` of the lines of one period's orders.

    The orders are filtered first (pushed to their scan), so only their lines
    survive the join and are summed.
    """
    day = F.col("o_orderdate")
    orders = (table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
              .filter((day >= F.lit(start).cast("timestamp_ntz")) & (day <= F.lit(end).cast("timestamp_ntz"))))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    return (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
                 .select(F.col("o_orderdate").alias("order_date"), F.col("l_extendedprice").alias("amount")))


def part_sales(spark: SparkSession, sf_dir: str, roles: list[str]) -> DataFrame:
    """Line sums per part joined to ``part``: roll-ups by product / category.

    The join then sees one row per part instead of one per line.  Columns:
    the part roles requested plus ``amount``, ``quantity`` and ``lines``.
    """
    lines = (table(spark, sf_dir, "lineitem").groupBy("l_partkey")
             .agg(F.sum("l_extendedprice").alias("amount"), F.sum("l_quantity").alias("quantity"),
                  F.count(F.lit(1)).alias("lines")))
    p_roles = [r for r in roles if SALES_ROLES[r][0] == "part"]
    part = table(spark, sf_dir, "part").select("p_partkey", *[SALES_ROLES[r][1] for r in p_roles])
    return (lines.join(part, lines.l_partkey == part.p_partkey, "inner")
                 .select(*[F.col(SALES_ROLES[r][1]).alias(r) for r in p_roles], "amount", "quantity", "lines"))


def customer_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order sums rolled up per customer, joined to customer and nation:
    roll-ups by country.  Columns: ``country``, ``amount``, ``quantity``, ``lines``."""
    per_order = order_sales(spark, sf_dir, ["customer_id"])
    per_cust = (per_order.groupBy("customer_id")
                .agg(F.sum("amount").alias("amount"), F.sum("quantity").alias("quantity"),
                     F.sum("lines").alias("lines")))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (per_cust.join(cust, per_cust.customer_id == cust.c_custkey, "inner")
                    .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "inner")
                    .select(F.col("n_name").alias("country"), "amount", "quantity", "lines"))
