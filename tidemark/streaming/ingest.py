"""Continuous ingest into the raw zone, with dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import blank_to_null
from tidemark.sinks.zones import dead_letters, file_id, file_rows
from tidemark.streaming.folders import BatchFolders

# The envelope fields of a message.
ENVELOPE = ["_file_sha256", "_batch_id", "_file_path", "_source", "_rows", "_row_num"]

STORED = """file_id STRING, path STRING, sha256 STRING, rows BIGINT, row_num BIGINT, payload STRING, error STRING,
value STRING, `partition` INT, `offset` BIGINT, loaded_at STRING"""


def parse_envelopes(messages: DataFrame) -> DataFrame:
    """Envelope fields, payload and an ``error`` text for values that cannot be stored.

    The payload is the JSON text of the fields that do not start with an
    underscore, with their types. Only a faulty value is kept as it came.
    """
    parsed = messages.select(
        "value",
        "partition",
        "offset",
        F.from_json("value", ", ".join(f"{n} STRING" for n in ENVELOPE)).alias("_e"),
        F.from_json("value", "map<string, variant>").alias("_fields"),
    )

    def field(name: str) -> Column:
        return F.col(f"_e.{name}")

    def number(name: str) -> Column:
        # a JSON number loses its fraction, a text has to be a whole number
        value = F.col("_fields")[name]
        fraction = F.schema_of_variant(value).rlike("^(DECIMAL|DOUBLE|FLOAT)")
        return F.when(fraction, F.try_variant_get(value, "$", "double").try_cast("bigint")).otherwise(
            field(name).try_cast("bigint")
        )

    # a row number that is given has to be one; no, empty or null _rows count as 0
    rows = F.when(F.coalesce(field("_rows"), F.lit("")) == "", F.lit(0)).otherwise(number("_rows"))
    given = F.coalesce(F.map_contains_key("_fields", F.lit("_row_num")), F.lit(False))
    row_num = F.when(given, number("_row_num")).otherwise(F.lit(0))

    error = F.when(F.col("_fields").isNull(), "invalid json").otherwise(
        F.when(row_num.isNull(), "invalid _row_num").when(rows.isNull(), "invalid _rows")
    )
    payload = F.to_json(F.map_filter("_fields", lambda k, v: ~k.startswith("_")))
    # an empty path counts as not set, an empty source does not
    path = F.coalesce(blank_to_null(field("_file_path")), field("_source"), F.lit("api"))
    sha = F.coalesce(
        blank_to_null(field("_file_sha256")), blank_to_null(field("_batch_id")), F.lit("")
    )
    return parsed.select(
        file_id(path, sha).alias("file_id"),
        path.alias("path"),
        sha.alias("sha256"),
        F.coalesce(rows, F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(row_num, F.lit(0)).cast("bigint").alias("row_num"),
        payload.alias("payload"),
        error.alias("error"),
        F.when(error.isNotNull(), F.col("value")).alias("value"),
        F.col("partition").cast("int").alias("partition"),
        F.col("offset").cast("bigint").alias("offset"),
    )


FILES = "file_id STRING, path STRING, sha256 STRING, rows BIGINT, ingested_at STRING, `partition` INT, `offset` BIGINT"


def _last_of_files(log: DataFrame) -> DataFrame:
    return file_rows(log.drop("file_id"))


def message_log(spark: SparkSession, out: str) -> BatchFolders:
    return BatchFolders(spark, f"{out}/messages", f"{STORED}, ok INT", partition_by=("ok",))


def file_log(spark: SparkSession, out: str) -> BatchFolders:
    """A merged folder holds the last row of each file only."""
    return BatchFolders(spark, f"{out}/files", FILES, _last_of_files)


def write_batch(messages: DataFrame, batch: int, out: str, at: Column) -> None:
    """One micro-batch: its messages in one pass (good and faulty apart), then its files.

    Every batch owns folders that it overwrites, so a repeated batch changes
    nothing. ``files`` is a log; readers take the last row per file.
    """
    spark = messages.sparkSession
    stored, files = message_log(spark, out), file_log(spark, out)
    rows = parse_envelopes(messages).withColumn("loaded_at", at.cast("string"))
    folder = stored.write(rows.withColumn("ok", F.col("error").isNull().cast("int")), batch)
    good = spark.read.schema(f"{STORED}, ok INT").parquet(folder).filter("ok = 1")
    stamped = good.select("path", "sha256", "rows", F.col("loaded_at").alias("ingested_at"), "partition", "offset")
    files.write(file_rows(stamped), batch)
    files.add(batch)
    stored.add(batch)


def start_ingest(messages: DataFrame, out: str, at: Column) -> StreamingQuery:
    """Run until the source is used up. ``messages`` has value, partition, offset."""
    return (
        messages.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, out, at))
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def raw_files(spark: SparkSession, out: str) -> DataFrame:
    """Current files table: the last row of each file over all batches."""
    return _last_of_files(file_log(spark, out).read()).drop("partition", "offset")


def _messages(spark: SparkSession, out: str, ok: int) -> DataFrame:
    return message_log(spark, out).read().filter(F.col("ok") == ok)


def raw_zone(spark: SparkSession, out: str) -> DataFrame:
    """Stored records of all batches."""
    return _messages(spark, out, 1).select(
        "file_id", "row_num", "payload", "loaded_at", "partition", "offset"
    )


def dead_zone(spark: SparkSession, out: str, topic: str) -> DataFrame:
    """Faulty messages of all batches with where they came from."""
    return dead_letters(_messages(spark, out, 0).drop("payload"), F.col("error"), topic, F.col("loaded_at"))
