"""Table loads and incremental reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sinks.messages import format_of


def load_table(spark: SparkSession, path: str, schema: str | None = None, format: str = "auto") -> DataFrame:
    """Read csv, json or parquet by the ending of the path; csv and json take a schema."""
    kind = format_of(path) if format == "auto" else format
    reader = spark.read
    if kind == "csv":
        reader = reader.options(header=True, escape='"')
    if kind != "parquet" and schema:
        reader = reader.schema(schema)
    return reader.format(kind).load(path)


# The columns an incremental read of each goal table takes.
GOAL_COLUMNS = [
    "objective_id", "title", "description", "owner_id", "department", "quarter", "year",
    "status", "priority", "created_date", "updated_date", "target_completion_date",
]
KEY_RESULT_COLUMNS = [
    "key_result_id", "objective_id", "title", "description", "metric_type", "target_value",
    "current_value", "unit", "status", "progress_percentage", "created_date", "updated_date",
    "due_date",
]
UPDATE_COLUMNS = [
    "update_id", "key_result_id", "objective_id", "update_value", "progress_percentage",
    "notes", "updated_by", "update_date", "created_date",
]


def incremental_scan(
    table: DataFrame, columns: list[str], changed: str, as_of: Column, days: int = 1
) -> DataFrame:
    """Rows changed within ``days`` before ``as_of``, newest first.

    Filter and columns reach the scan of the table.
    """
    kept = [c for c in columns if c in table.columns]
    since = as_of - F.make_dt_interval(F.lit(days))
    return table.select(*kept).filter(F.col(changed) >= since).orderBy(F.col(changed).desc())


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Database table. Give ``partitionColumn``, bounds and ``numPartitions`` for large ones."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def newest_files(files: DataFrame) -> DataFrame:
    """The files zone, newest first."""
    return files.select("file_id", "path", "sha256", "rows", "ingested_at").orderBy(
        F.col("ingested_at").desc(), "file_id"
    )


def raw_records(records: DataFrame, payload: str, file: str | None = None) -> DataFrame:
    """Raw records with the payload expanded, ordered by row number within each file.

    ``file`` limits the read to one file; the payload schema is declared.
    """
    wanted = records if file is None else records.filter(F.col("file_id") == file)
    expanded = wanted.select(
        F.from_json("payload", payload).alias("p"),
        F.col("record_id").cast("string").alias("_record_id"),
        F.col("file_id").alias("_file_id"),
        F.col("row_num").alias("_row_num"),
        F.col("loaded_at").alias("_loaded_at"),
    ).select("p.*", "_record_id", "_file_id", "_row_num", "_loaded_at")
    return expanded.orderBy("_file_id", "_row_num")
