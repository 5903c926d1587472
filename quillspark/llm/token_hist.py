"""Exact token-length histogram with suffix sums (operator 6).

Documents are aggregated by encoded length (end id included), and prefix and
suffix sums over the histogram answer totals, quantiles and truncated totals for
every context limit without another look at the texts.

The sums run in two levels (blocks of consecutive lengths, then inside a block),
so that no task needs the whole histogram however long documents get.

Null and empty texts count as length 1 (the end id).  An empty table gives an
empty histogram.  Extra columns are ignored; repeated rows count each time.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stored, text_or_empty
from .registry import register
from .tokens import BYTE_VOCABULARY, encoder, vocabulary_path

#: Lengths per block of the two-level sums.
BLOCK = 256


def token_lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """n_tokens (int) of every row's whole text, end id included."""

    def lengths(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(encode(t)) // 4 + 1 for t in batch.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(lengths, "n_tokens long")


def length_histogram(docs: DataFrame, vocabulary: str) -> DataFrame:
    """n_tokens, n_docs, and for each length taken as a context limit the sums on both sides.

    docs_le and tokens_le cover documents up to the limit; docs_gt and tokens_gt
    those beyond it; truncated_tokens is the corpus total if every document is
    cut at the limit; quantile is the share of documents up to the limit.
    """
    hist = (token_lengths(docs, vocabulary).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
            .withColumn("block", F.floor(F.col("n_tokens") / BLOCK)))
    hist = stored(hist, "histogram")  # read for the block sums and again beside them
    sums = [F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens")]
    blocks = hist.groupBy("block").agg(*sums)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block of lengths
    whole = Window.partitionBy()
    blocks = blocks.select("block",
                           F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before"),
                           F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens_before"),
                           F.sum("docs").over(whole).alias("docs_all"), F.sum("tokens").over(whole).alias("tokens_all"))
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    le = hist.join(blocks, "block").select(
        "n_tokens", "n_docs", "docs_all", "tokens_all",
        (F.col("docs_before") + F.sum("n_docs").over(inside)).alias("docs_le"),
        (F.col("tokens_before") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)).alias("tokens_le"))
    gt = le.select("*", (F.col("docs_all") - F.col("docs_le")).alias("docs_gt"),
                   (F.col("tokens_all") - F.col("tokens_le")).alias("tokens_gt"))
    return gt.select("n_tokens", "n_docs", "docs_le", "tokens_le", "docs_gt", "tokens_gt",
                     (F.col("tokens_le") + F.col("n_tokens") * F.col("docs_gt")).alias("truncated_tokens"),
                     (F.col("docs_le") / F.col("docs_all")).alias("quantile"))


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: tokens kept, documents cut and tokens lost if documents are cut at ``limit``."""
    le, gt = F.col("n_tokens") <= limit, F.col("n_tokens") > limit
    kept = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")
    zero = F.lit(0)
    return hist.agg(F.coalesce(F.sum(kept), zero).alias("tokens_kept"),
                    F.coalesce(F.sum(F.when(gt, F.col("n_docs"))), zero).alias("docs_cut"),
                    F.coalesce(F.sum(F.when(gt, (F.col("n_tokens") - limit) * F.col("n_docs"))), zero).alias("tokens_lost"),
                    F.coalesce(F.sum(F.when(le, F.col("n_docs"))), zero).alias("docs_whole"))


def length_quantile(hist: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least the share ``q`` of documents does not exceed."""
    return hist.filter(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


@register("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(read_table(spark, sf_dir, "documents"), vocabulary_path(BYTE_VOCABULARY))
