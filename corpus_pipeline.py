"""The corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of ``documents``; what a stage drops or masks is gone for the
next one.  ``run`` writes every stage's result as Parquet in the shared folder
and rereads it, so a lost executor costs at most one stage.  Every stage first bounds
the session's buffers of whole texts (Arrow batches, Parquet row groups).

* quality: documents that the classifier predicts as label 0 go.
* near duplicates: of every component of linked or equal rows one row stays, the
  first by id and text hash.  Rows that share an id are told apart by their texts.
  Documents without id stay.
* decontamination: documents with any benchmark window go.
* secrets: documents stay, found spans are masked and n_chars follows.
* packing: the places of all documents' pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import bound_buffers, read_table, scratch, stored
from quillspark.llm.decontam import contamination
from quillspark.llm.jaccard import similar_documents
from quillspark.llm.packing import pack_documents
from quillspark.llm.quality import train_quality, with_score
from quillspark.llm.secret_scan import redact_documents
from quillspark.llm.tokens import WORD_VOCABULARY, vocabulary_path

#: Most row keys (8 bytes each) of documents to drop that are broadcast; beyond, documents are shuffled to them.
BROADCAST_IDS = 500_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_buffers(spark)
    model = train_quality(docs, read_table(spark, sf_dir, "labels"))
    return with_score(docs, model, score="__quality").filter(F.col("__quality") >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_buffers(spark)
    # Rows, not ids, are compared: an id may be shared by unrelated texts.  Writing the row key fixes it.
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "dedup-rows")
    named = rows.filter(F.col("doc_id").isNotNull())
    found = similar_documents(named.select(F.col("__row").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("__row"), "n_shingles", "component_id")
    text = F.xxhash64("text")
    order = F.struct("doc_id", text.alias("text"), F.xxhash64(*docs.columns).alias("all"), "__row").alias("order")
    # Texts without words link with nothing: of those only rows equal in id and text are one.
    wordless = F.col("n_shingles") == 0
    sized = stored(found.join(named.select("__row", order), "__row").select(
        "__row", "order", F.when(~wordless, F.col("component_id")).alias("component"),
        F.when(wordless, F.struct(F.col("order.doc_id").alias("doc_id"), F.col("order.text").alias("text"))).alias("same")),
        "dedup-components")
    first = sized.groupBy("component", "same").agg(F.min("order").alias("order")).select("order.__row")
    dropped = stored(sized.select("__row").join(first, "__row", "left_anti"), "dedup-dropped")
    side = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped.hint("shuffle_hash")
    return rows.join(side, "__row", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_buffers(spark)
    found = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("found.spans") == 0).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_buffers(spark)
    return redact_documents(docs, scratch(spark, "pipeline-ledger"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_buffers(spark)
    return pack_documents(docs, vocabulary_path(WORD_VOCABULARY))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: A trained model and a tokenizer decide the rows; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
