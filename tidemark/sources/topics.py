"""Message topics: folders of JSON lines, or Kafka topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_topic(spark: SparkSession, topic: str, format: str = "text", **options: str) -> DataFrame:
    """Everything a topic holds now, as ``value`` text."""
    if format == "kafka":
        reader = spark.read.format("kafka").option("subscribe", topic)
        raw = reader.options(startingOffsets="earliest", endingOffsets="latest", **options).load()
        return raw.select(F.col("value").cast("string"), "key", "partition", "offset", "timestamp")
    return spark.read.format(format).options(**options).load(topic)


def stream_topic(
    spark: SparkSession, topic: str, format: str = "text", per_batch: int | None = None, **options: str
) -> DataFrame:
    """A topic as a stream of ``value`` texts; ``per_batch`` bounds files or offsets per batch."""
    reader = spark.readStream.format(format).options(**options)
    if format == "kafka":
        reader = reader.option("subscribe", topic).option("startingOffsets", "earliest")
        if per_batch:
            reader = reader.option("maxOffsetsPerTrigger", per_batch)
        return reader.load().select(
            F.col("value").cast("string"), "key", "partition", "offset", "timestamp"
        )
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(topic)


def parse_values(messages: DataFrame, schema: str) -> DataFrame:
    """Columns of the JSON ``value`` in a declared schema."""
    return messages.select(F.from_json("value", schema).alias("v")).select("v.*")


def bounded(messages: DataFrame, position: str, most: int) -> DataFrame:
    """The first ``most`` messages by position."""
    return messages.orderBy(position).limit(most)
