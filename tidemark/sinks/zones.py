"""The three zones (raw, processed, curated) and the rows written to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.jsons import EXACT
from tidemark.functions.text import base_name
from tidemark.operators.rules import payload_columns, row_column

# The processed zone's columns and types.
PROCESSED = {
    "source_file_id": "string", "source_row_num": "int", "department": "string",
    "objective": "string", "objective_type": "string", "priority": "string",
    "quarter": "string", "team_size": "int", "budget": "decimal(12,2)",
    "timeline_days": "int", "progress": "decimal(5,2)", "status": "string",
    "valid": "boolean", "rejected_reason": "string", "original_payload": "string",
    "processed_at": "string",
}


def file_id(path: Column, sha256: Column) -> Column:
    """Stable id of a file version: the same for every run."""
    return F.sha2(F.concat_ws("|", path, sha256), 256)


def upsert_latest(rows: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """Last version of each key. One maximum per key, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(*newest, *[c for c in rest if c not in newest])
    return rows.groupBy(*keys).agg(F.max(order).alias("_last")).select(
        *keys, *[F.col(f"_last.{c}").alias(c) for c in rest]
    )


def file_rows(rows: DataFrame) -> DataFrame:
    """``files`` zone table: the last row count and time of each (path, sha256), with its id.

    Of equal times the last message wins, where rows carry their partition and offset.
    """
    newest = [c for c in ("ingested_at", "partition", "offset") if c in rows.columns]
    latest = upsert_latest(rows, ["path", "sha256"], newest)
    return latest.withColumn("file_id", file_id(F.col("path"), F.col("sha256")))


def payload_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """JSON text of the data columns, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns or payload_columns(df)]), EXACT)


def raw_records(df: DataFrame, file: Column, row_num: Column, loaded_at: Column) -> DataFrame:
    """Raw zone record: file id, row number, payload JSON, load time."""
    return df.select(
        file.alias("file_id"),
        row_num.cast("bigint").alias("row_num"),
        payload_json(df).alias("payload"),
        loaded_at.alias("loaded_at"),
    )


def processed_records(validated: DataFrame, processed_at: Column) -> DataFrame:
    """The 16 processed columns; absent fields are null, rejection reasons are joined.

    A value that its column cannot hold is null there, and the row is not valid: it gets a reason.
    """
    have = set(validated.columns)
    id_column, number = row_column(validated, "file_id"), row_column(validated, "row_num")
    found = F.col("_validation_errors") if "_validation_errors" in have else F.array().cast("array<string>")
    misfits = [
        F.when(F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull(), F.lit(f"{name} does not fit {kind}"))
        for name, kind in PROCESSED.items()
        if kind != "string" and name in have
    ]
    lost = F.filter(F.array(*misfits), lambda x: x.isNotNull()) if misfits else F.array().cast("array<string>")
    errors = F.array_join(F.concat(F.coalesce(found, F.array().cast("array<string>")), lost), "; ")
    known = {
        "source_file_id": F.col(id_column) if id_column in have else F.lit(None),
        "source_row_num": F.col(number) if number in have else F.lit(None),
        "valid": (F.coalesce("_is_valid", F.lit(True)) if "_is_valid" in have else F.lit(True)) & (F.size(lost) == 0),
        "rejected_reason": F.nullif(errors, F.lit("")),
        "original_payload": payload_json(validated),
        "processed_at": processed_at,
    }
    out = []
    for name, kind in PROCESSED.items():
        c = known.get(name, F.col(name) if name in have else F.lit(None))
        out.append(c.try_cast(kind).alias(name))
    return validated.select(*out)


def curated_records(docs: DataFrame, created_at: Column, extra: list[str] = ()) -> DataFrame:
    """Curated zone document: source ``file#row``, text, meta JSON, empty embedding.

    ``extra`` names columns (chunk position) that are put into the meta as well.
    """
    fields = docs.schema["meta"].dataType.fieldNames()

    def meta(name: str, default: str) -> Column:
        if name not in fields:
            return F.lit(default)
        return F.coalesce(F.col(f"meta.{name}").cast("string"), F.lit(default))

    body = F.struct(*[F.col(f"meta.`{f}`").alias(f) for f in fields], *extra)
    return docs.select(
        F.concat(meta("source_file", "unknown"), F.lit("#"), meta("row_num", "0")).alias("source"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.to_json(body, {**EXACT, "ignoreNullFields": "true"}).alias("meta"),
        F.lit(None).cast("binary").alias("embedding"),
        created_at.alias("created_at"),
    )


def zone_stats(files: DataFrame, records: DataFrame, processed: DataFrame, documents: DataFrame) -> DataFrame:
    """One long table (zone, metric, value) of the sizes of all zones."""

    def long(df: DataFrame, zone: str, metrics: dict[str, Column]) -> DataFrame:
        one = df.agg(*[c.cast("bigint").alias(n) for n, c in metrics.items()])
        return one.unpivot([], list(metrics), "metric", "value").select(
            F.lit(zone).alias("zone"), "metric", "value"
        )

    rows = F.count(F.lit(1))
    return (
        long(files, "raw", {"files": rows})
        .unionByName(long(records, "raw", {"records": rows}))
        .unionByName(
            long(
                processed,
                "processed",
                {
                    "total_records": rows,
                    "valid_records": F.count_if("valid"),
                    "invalid_records": rows - F.count_if("valid"),
                },
            )
        )
        .unionByName(
            long(
                documents,
                "curated",
                {"documents": rows, "with_embeddings": F.count("embedding")},
            )
        )
    )


def run_totals(stats: DataFrame) -> DataFrame:
    """What a run returns: files, records, loaded, curated, and the processed sum."""

    def value(zone: str, metric: str) -> Column:
        return F.coalesce(
            F.max(F.when((F.col("zone") == zone) & (F.col("metric") == metric), F.col("value"))), F.lit(0)
        )

    loaded, curated = value("processed", "total_records"), value("curated", "documents")
    return stats.agg(
        value("raw", "files").alias("files"),
        value("raw", "records").alias("records"),
        loaded.alias("loaded"),
        curated.alias("curated"),
        (loaded + curated).alias("processed_total"),
    )


def ingest_events(counts: DataFrame, at: Column) -> DataFrame:
    """Message per ingested file (path, rows): key is the base name."""
    return counts.select(
        base_name(F.col("path")).alias("key"),
        F.struct(
            F.lit("raw_ingest").alias("event_type"),
            F.col("path").alias("file_path"),
            F.col("rows").alias("rows_ingested"),
            at.alias("timestamp"),
            F.lit("completed").alias("status"),
        ).alias("value"),
    )


def processed_event(processed: DataFrame, epoch: Column, at: Column) -> DataFrame:
    """One message with the number of processed rows."""
    return processed.agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("batch_"), epoch.cast("string")).alias("key"),
        F.struct(
            F.lit("processed_update").alias("event_type"),
            F.col("n").alias("records_processed"),
            at.alias("timestamp"),
            F.lit("completed").alias("status"),
        ).alias("value"),
    )


def done_events(events: DataFrame, at: Column) -> DataFrame:
    """Completed-ingest notice; a count of 0 gives way to rows."""
    return events.select(
        "file_id",
        "batch_id",
        "source",
        F.coalesce(F.nullif(F.col("count"), F.lit(0)), F.col("rows")).alias("count"),
        at.alias("ts"),
    )


def dead_letters(messages: DataFrame, error: Column, topic: str, at: Column) -> DataFrame:
    """Rows whose ``error`` text is set, with where they came from."""
    return (
        messages.withColumn("error", error)
        .filter(F.col("error").isNotNull())
        .select(
            "error",
            F.lit(topic).alias("source_topic"),
            "partition",
            "offset",
            F.col("value").alias("payload"),
            at.alias("ts"),
        )
    )


def metric_history(scores: DataFrame, model: str, at: Column) -> DataFrame:
    """Row for the metric history of a model; an absent AUC is null."""
    auc = F.col("roc_auc") if "roc_auc" in scores.columns else F.lit(None)
    return scores.select(
        at.alias("timestamp"),
        F.lit(model).alias("model_name"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")],
        auc.cast("double").alias("roc_auc"),
    )
