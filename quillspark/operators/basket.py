"""Market-basket pair rules.

A basket qualifies when it has >= 2 raw rows; its items are then made
unique.  Pair support = number of qualifying baskets holding both items.

Items and pairs stay DataFrames.  A pair's support is at most that of its
rarer item, so with t the top-k-th support among the pairs of the most frequent
items, every top-k pair consists of items with support >= t.  That head of items
grows until it has k pairs, so items that never meet do not lead to all pairs.  Pairs come from an equi-join on (basket, block); the blocks
of a basket's items are as many as its size asks for, so that one basket with
all items is spread over many tasks, and counts are summed map-side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Items whose pairs give the first bound t, and items per block of a basket.
FIRST_ITEMS, BLOCK_ITEMS = 64, 256
#: Most items of a head that are broadcast.
BROADCAST_ITEMS = 100_000


def basket_items(df: DataFrame, order: str, item: str) -> DataFrame:
    """``(o, i)``: the distinct items of every qualifying basket (>= 2 raw rows)."""
    t = (df.select(F.col(order).alias("o"), F.col(item).cast("string").alias("i"))
           .filter(F.col("o").isNotNull() & F.col("i").isNotNull()))
    counted = t.groupBy("o", "i").agg(F.count(F.lit(1)).alias("c"))  # repeats collapse map-side
    large = counted.groupBy("o").agg(F.sum("c").alias("raw")).filter("raw >= 2").select("o")
    return counted.select("o", "i").join(large, "o", "left_semi")


def pair_supports(posts: DataFrame) -> DataFrame:
    """``(A, B, support)`` with A < B for the pairs that share a basket of ``posts`` (o, i)."""
    sizes = posts.groupBy("o").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ITEMS).alias("blocks")).filter("blocks > 0")
    sized = posts.join(sizes, "o")
    left = sized.select("o", F.col("i").alias("A"), F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
    right = sized.select("o", F.col("i").alias("B"), F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int").alias("block"))
    return left.join(right, ["o", "block"]).filter("A < B").groupBy("A", "B").agg(F.count(F.lit(1)).alias("support"))


def basket_rules(df: DataFrame, order: str, item: str, top: int = 15, min_baskets: int = 10,
                 first_items: int = FIRST_ITEMS) -> DataFrame:
    """``(antecedent, consequent, support, confidence, lift)`` for the top pairs with lift > 1."""
    spark = df.sparkSession
    posts = written(basket_items(df, order, item), "basket-items")  # scanned several times
    n_baskets = posts.select("o").distinct().count()
    if n_baskets < min_baskets:
        return spark.createDataFrame([], "antecedent string, consequent string, support long, confidence double, lift double")
    items = posts.groupBy("i").agg(F.count(F.lit(1)).alias("supp"))
    # Heads of falling support, each four times the last, until one holds enough pairs to bound the rest.
    n_items, size, bound = items.count(), first_items, None
    while bound is None and size < n_items:
        head = items.orderBy(F.col("supp").desc(), "i").limit(size).select("i")
        head = F.broadcast(head) if size <= BROADCAST_ITEMS else head
        first = pair_supports(posts.join(head, "i", "left_semi")).orderBy(F.col("support").desc()).limit(top)
        found = first.agg(F.count(F.lit(1)).alias("n"), F.min("support").alias("t")).first()
        if found["n"] == top:
            bound = found["t"]
        size *= 4
    # Without a bound the next head would hold all items: their pairs are counted at once.
    frequent = posts if bound is None else posts.join(items.filter(F.col("supp") >= bound).select("i"), "i", "left_semi")
    best = pair_supports(frequent).orderBy(F.col("support").desc(), "A", "B").limit(top)
    best = F.broadcast(best)  # at most ``top`` rows
    named = items.join(best, items["i"] == best["A"]).select("A", "B", "support", F.col("supp").alias("supp_a"))
    named = items.join(F.broadcast(named), items["i"] == named["B"]).select("A", "B", "support", "supp_a", F.col("supp").alias("supp_b"))
    conf = F.col("support") / F.col("supp_a")
    lift = conf / (F.col("supp_b") / F.lit(float(n_baskets)))
    return (named.filter(lift > 1.0)
                 .select(F.col("A").alias("antecedent"), F.col("B").alias("consequent"),
                         F.col("support").cast("long").alias("support"),
                         F.round(conf, 2).alias("confidence"), F.round(lift, 2).alias("lift")))


def basket_bands(rules: DataFrame) -> DataFrame:
    """Display fields of the basket widget and table: lift band, confidence %, list text."""
    return rules.select(
        "antecedent", "consequent",
        F.when(F.col("lift") >= 2.5, "strong").when(F.col("lift") >= 1.5, "moderate").otherwise("weak")
         .alias("lift_band"),
        F.round(F.col("confidence") * 100).cast("long").alias("confidence_pct"),
        F.array_join(F.array("antecedent", "consequent"), ", ").alias("items_text"),
        F.format_string("%.2f", F.col("lift")).alias("lift_text"))
