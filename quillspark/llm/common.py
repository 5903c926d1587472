"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder for one written table, under the shared checkpoint folder."""
    return f"{scratch_path(spark, 'llm')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


#: Rows of an Arrow batch that are taken apart into words at once (memory bound per Python worker).
SLICE_ROWS = 512


def slices(batches):
    """The batches cut to at most ``SLICE_ROWS`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


#: Rows of one Arrow batch to Python, and bytes of a Parquet row group, of stages that carry whole texts.
BATCH_ROWS, ROW_GROUP_BYTES = 1000, 16 << 20


def bound_buffers(spark: SparkSession) -> None:
    """Lower the session's buffers of whole texts (per task: batches on their way to Python, open row groups); never raise them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("parquet.block.size", ROW_GROUP_BYTES)):
        now = int(spark.conf.get(key, "0"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


_HELD: dict = {}


def release() -> None:
    """Let go of the large table that this Python worker kept from earlier tasks (workers are reused between stages)."""
    if _HELD:
        _HELD.clear()
        gc.collect()


def held(key: str, make):
    """The one large table that a Python worker keeps between tasks; asking for another one releases it."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]
