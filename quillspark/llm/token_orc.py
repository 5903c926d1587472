"""Token-ID output as ORC (operator 8).

Documents are dealt into ranges of doc_id, sorted, encoded after the sort (the
shuffle carries texts once and ids never), and written as ORC: one file per
range, integer run-length encoded ids, a row index every ``ROW_INDEX`` rows and
a Bloom filter on doc_id.  Stripes are read in parallel, and a doc_id predicate
skips files, stripes and row groups by their metadata alone.

``start`` (ids of all documents before) is a document's position in its range
plus the totals of the ranges before, from the files' own narrow columns.

Null texts are empty (only the end id).  Null ids sort first.  Rows that share
an id follow one another in the order of a text hash; repeated rows are kept.
An empty table gives empty files.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, scratch, text_or_empty
from .registry import register
from .tokens import BYTE_VOCABULARY, END_ID, encoder, vocabulary_path

ROW_INDEX = 1000
STRIPE_BYTES = 16 << 20
SCHEMA = "block int, doc_id long, block_start long, n_tokens long, ids array<int>"


def write_token_orc(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Write the ids of ``docs`` (doc_id, text) to ``path`` in ascending doc_id order."""
    tie = F.xxhash64("text")
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
               .repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie))

    def encode(batches):
        import numpy as np
        from pyspark import TaskContext
        block, at, enc, end = TaskContext.get().partitionId(), 0, encoder(vocabulary).encode, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = [enc(t) + end for t in batch.column(1).to_pylist()]
            sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            ends = np.cumsum(sizes)
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), block, np.int32)), batch.column(0), pa.array(at + ends - sizes),
                 pa.array(sizes), pa.ListArray.from_arrays(offsets, values)],
                ["block", "doc_id", "block_start", "n_tokens", "ids"])
            at += int(sizes.sum())

    (ordered.mapInArrow(encode, SCHEMA).write
     .option("orc.compress", "ZSTD").option("orc.stripe.size", STRIPE_BYTES)
     .option("orc.create.index", "true").option("orc.row.index.stride", ROW_INDEX)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .orc(path))


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document; filters on doc_id reach the stripe metadata."""
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("block").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per written range: the table is as small as the file list of the folder.
    offsets = totals.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("block_offset"))
    return rows.join(F.broadcast(offsets), "block").select(
        "doc_id", (F.col("block_offset") + F.col("block_start")).alias("start"), "n_tokens", "ids")


def ids_digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each row's ids as little-endian unsigned 32-bit integers."""

    def digest(batches):
        import numpy as np
        for batch in batches:
            ids = batch.column(3)
            values = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(np.concatenate([[0], ids.value_lengths().to_numpy(zero_copy_only=False)])).astype(np.int64)
            data = memoryview(values.tobytes())
            crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


@register("op8_token_orc")
def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-orc")
    write_token_orc(read_table(spark, sf_dir, "documents"), path, vocabulary_path(BYTE_VOCABULARY))
    return ids_digest(read_token_orc(spark, path))
