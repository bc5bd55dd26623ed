"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Skewed joins are split at run time even when the split costs one more shuffle. Partitions after
# a shuffle are merged up to the advisory size, but never split: see shuffle_partitions.
PARTITION_BYTES = 128 << 20
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def shuffle_partitions(input_bytes: int) -> int:
    """Partitions a shuffle starts with, so that one of ``input_bytes`` has 128 MB in each."""
    return max(200, -(-input_bytes // PARTITION_BYTES))


def build_session(
    app: str = "tidemark", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """Session with the settings the jobs are written for; ``conf`` overrides.

    ``input_bytes`` is what the largest job reads; without it Spark's own partition count holds.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    sized = {}
    if input_bytes is not None:
        sized["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(shuffle_partitions(input_bytes))
    for key, value in {**DEFAULTS, **sized, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where the setting is missing (local tests) a temporary folder is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"tidemark-{os.getpid()}")
    os.makedirs(folder, exist_ok=True)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """New, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there.

    One pass, and what follows survives the loss of executors without a recount.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

