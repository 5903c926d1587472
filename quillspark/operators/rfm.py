"""RFM segmentation.

Per customer: recency (whole days since the customer's last purchase, as of
the latest date in the data), frequency (row count), monetary (sum).  Scores
are quartiles of first-come ranks; the ranks are never materialised, see
``functions.ranking``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import epoch_micros
from ..session import ensure_checkpoint_dir
from ..functions.ranking import bucket_of, rank_cuts_many

# Fixed values that must equal the reference: segment descriptions.
SEGMENT_DESCRIPTIONS = {
    "Champions": "Best customers, buy often and recently.",
    "Loyal": "Steady spenders, good retention.",
    "At Risk": "Big spenders who haven't visited lately.",
    "Hibernating": "Lost customers, low value.",
    "General": "Average customers.",
}

_DAY_MICROS = 86_400_000_000


def _micros(c: str):
    return epoch_micros(c)


def rfm_table(df: DataFrame, date: str, amount: str, customer: str, weight: str | None = None) -> DataFrame:
    """One row per customer with R/F/M values, scores and segment.

    ``weight`` names a row-multiplicity column when the input is already
    aggregated (e.g. one row per order carrying its line count).
    """
    base = (df.select(F.col(date).alias("_d"), F.col(customer).alias("customer_id"),
                      F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias("_a"),
                      (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("_w"))
              .filter(F.col("_d").isNotNull()))
    now = base.agg(F.max(_micros("_d")).alias("_now"))          # one row
    per = (base.filter(F.col("customer_id").isNotNull())
               .groupBy("customer_id")
               .agg(F.max(_micros("_d")).alias("_last"), F.sum("_w").alias("frequency"),
                    F.sum("_a").alias("monetary"))
               .crossJoin(F.broadcast(now))
               .select("customer_id",
                       F.floor((F.col("_now") - F.col("_last")) / _DAY_MICROS).cast("long").alias("recency"),
                       "frequency", "monetary"))
    # The per-customer table is scanned once per selection pass: write it to
    # the shared checkpoint folder so passes (and lost executors) reuse it.
    ensure_checkpoint_dir(per.sparkSession)
    per = per.checkpoint(eager=True)
    n = per.count()
    if n < 2:  # pandas qcut cannot build 4 bins from one rank
        return per.limit(0).select("customer_id", "recency", "frequency", "monetary",
                                   F.lit(0).alias("r_score"), F.lit(0).alias("f_score"),
                                   F.lit(0).alias("m_score"), F.lit("").alias("segment"))
    cuts = rank_cuts_many(per, ["recency", "frequency", "monetary"], "customer_id", n)
    rq = bucket_of("recency", "customer_id", cuts["recency"])
    fq = bucket_of("frequency", "customer_id", cuts["frequency"])
    mq = bucket_of("monetary", "customer_id", cuts["monetary"])
    scored = per.select("customer_id", "recency", "frequency", "monetary",
                        (5 - rq).alias("r_score"), fq.alias("f_score"), mq.alias("m_score"))
    r, f = F.col("r_score"), F.col("f_score")
    seg = (F.when((r >= 4) & (f >= 4), "Champions").when((r >= 3) & (f >= 3), "Loyal")
            .when((r >= 2) & (f <= 2), "At Risk").when(r <= 1, "Hibernating").otherwise("General"))
    return scored.withColumn("segment", seg)


def rfm_segments(customers: DataFrame) -> DataFrame:
    """Count and mean monetary value per segment, with the description."""
    desc = F.create_map(*[F.lit(x) for kv in SEGMENT_DESCRIPTIONS.items() for x in kv])
    return (customers.groupBy("segment")
                     .agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("monetary"), 2).alias("avg_monetary"))
                     .withColumn("description", F.coalesce(desc[F.col("segment")], F.lit(""))))
