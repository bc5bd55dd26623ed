"""Views kept up to date by a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# (batch frame, batch id) -> nothing
BatchWriter = Callable[[DataFrame, int], None]


def run(stream: DataFrame, write: BatchWriter, checkpoint: str, mode: str = "append") -> None:
    """Feed every batch to ``write`` until the source is used up."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _store_version(df: DataFrame, out: str, batch: int) -> None:
    """Write a version into one of two slots; the version before stays readable.

    A repeated batch overwrites its own slot, and old versions do not pile up.
    """
    df.withColumn("_version", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(
        f"{out}/state/slot={batch % 2}"
    )


def keep_summary(summary: DataFrame, out: str) -> None:
    """Keep a streaming aggregate as a table; every batch writes the whole new state.

    The state of the aggregate is one row per group.
    """
    run(summary, lambda df, batch: _store_version(df, out, batch), f"{out}/checkpoint", "complete")


def newest(spark: SparkSession, out: str) -> DataFrame:
    """The last version written below ``out``."""
    versions = spark.read.parquet(f"{out}/state").drop("slot")
    last = versions.agg(F.max("_version").alias("v")).scalar()
    return versions.filter(F.col("_version") == last).drop("_version")


def keep_latest(stream: DataFrame, out: str, order: list[Column], most: int = 1000) -> None:
    """Keep the newest ``most`` rows: the last version and the batch give the next version.

    A repeated batch starts from the same last version, so it writes the same rows.
    """

    def write(df: DataFrame, batch: int) -> None:
        if batch > 0:
            before = df.sparkSession.read.parquet(f"{out}/state/slot={(batch - 1) % 2}")
            df = df.unionByName(before.drop("_version"))
        _store_version(df.orderBy(*order).limit(most), out, batch)

    run(stream, write, f"{out}/checkpoint")


def keep_upserted(changes: DataFrame, out: str, keys: list[str]) -> None:
    """Keep the last row of each key of a stream in update mode; null keys are equal.

    A batch and the last version give the next version in one grouping, which no key makes large.
    """

    def write(df: DataFrame, batch: int) -> None:
        rows = df.select(F.struct(*df.columns).alias("_row"), F.lit(1).alias("_new"))
        if batch > 0:
            before = df.sparkSession.read.parquet(f"{out}/state/slot={(batch - 1) % 2}").select(F.struct(*df.columns).alias("_row"), F.lit(0).alias("_new"))
            rows = rows.unionByName(before)
        last = rows.groupBy(*(F.col(f"_row.{k}").alias(k) for k in keys)).agg(F.max_by("_row", "_new").alias("_row"))
        _store_version(last.select("_row.*"), out, batch)

    run(changes, write, f"{out}/checkpoint", "update")


def append_table(stream: DataFrame, out: str, format: str = "parquet") -> None:
    """Append a stream to a table folder, exactly once."""
    query = (
        stream.writeStream.format(format)
        .option("path", f"{out}/table")
        .option("checkpointLocation", f"{out}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
