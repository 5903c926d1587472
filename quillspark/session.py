"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every quillspark job relies on.  AQE re-plans joins and shuffle
# partition counts from runtime statistics; broadcast joins are only chosen
# by AQE when the measured side is under the threshold (a checked size).
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "quillspark",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not shuffle_partitions and "spark.sql.shuffle.partitions" not in (extra or {}):
        # Start shuffles wide (4 per core of the cluster) and let AQE coalesce
        # them to the advisory size: the static default of 200 cannot grow.
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                       str(max(200, 4 * spark.sparkContext.defaultParallelism)))
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared folder and is respected as is.
    Only in local mode (tests) a fresh scratch folder is created when it is unset;
    on a cluster a missing setting is an error.
    """
    current = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if spark.sparkContext.master.partition("[")[0] != "local":  # local-cluster has executors of its own
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="quill-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # a core setting may be read-only at runtime
            pass
    spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared checkpoint folder: later scans read only their columns."""
    spark = df.sparkSession
    path = scratch_path(spark, f"written/{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_path(spark: SparkSession, name: str) -> str:
    """A path for a lasting table: under the warehouse folder, as the checkpoint folder may be emptied between runs."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quillspark/{name}"
