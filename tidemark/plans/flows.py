"""End-to-end runs: landed files in, zone tables and messages out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.nulls import normalize_nulls
from tidemark.operators import documents as D
from tidemark.operators import goals as G
from tidemark.operators import nested as N
from tidemark.operators import rules as R
from tidemark.operators import stock as S
from tidemark.session import saved, scratch
from tidemark.sinks import messages as M
from tidemark.sinks import zones as Z
from tidemark.sources import csv_files as C
from tidemark.sources.json_docs import scan_envelopes, search_roots


def _store(df: DataFrame, path: str) -> DataFrame:
    # the zones hold the text of a row several times over; zstd packs it tighter than the default
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_zones(spark: SparkSession, path: str, out: str, as_of: Column, multi_line: bool | None = None) -> DataFrame:
    """CSV files to raw, processed and curated zone below ``out``; returns the run's totals.

    One job per zone over all files. The next zone starts from the stored one.
    """
    found = C.file_catalog(spark, path).select("path", "sha256", F.col("estimated_rows").alias("rows"))
    files = _store(Z.file_rows(found.withColumn("ingested_at", as_of)), f"{out}/raw/files")

    rows = C.scan_csv(spark, path, multi_line)
    ids = files.select(F.col("path").alias("_source_file"), F.col("file_id").alias("_file_id"))
    raw = Z.raw_records(rows.join(ids, "_source_file"), F.col("_file_id"), F.col("_row_num"), as_of)
    fields = [c for c in rows.columns if not c.startswith("_")]
    records = _store(raw, f"{out}/raw/records")

    payload = ", ".join(f"`{c}` STRING" for c in fields)
    expanded = records.select(
        F.col("file_id").alias("_file_id"), F.col("row_num").alias("_row_num"), F.from_json("payload", payload).alias("_p")
    ).select("_file_id", "_row_num", "_p.*")
    named = expanded.join(ids, "_file_id")
    # two zones are made of it
    validated = _store(R.validate_goals(R.rename_aliases(named)), scratch(spark, "validated"))
    processed = _store(Z.processed_records(validated, as_of), f"{out}/processed/records_clean")

    chunks = D.curated_chunks(D.goal_documents(validated, as_of))
    curated = Z.curated_records(chunks, as_of, ["chunk_index", "total_chunks", "is_chunked"])
    documents = _store(curated, f"{out}/curated/documents")

    counts = records.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows")).join(files.drop("rows"), "file_id")
    publish_table(Z.ingest_events(counts, as_of).select("key", "value.*"), f"{out}/events/raw_ingest", "key")
    stats = Z.zone_stats(files, records, processed, documents)
    return Z.run_totals(stats)


def publish_table(df: DataFrame, target: str, key: str | None = None, packed: dict[str, str] = M.PACKED) -> None:
    """JSON messages of a table in a folder; pass a Kafka target to ``messages.publish`` instead."""
    M.write_table(M.to_messages(df, key), target, "json", **packed)


def run_stock(
    items: dict[str, DataFrame], requests: dict[str, DataFrame], approvals: DataFrame | None, out: str, as_of: Column
) -> DataFrame:
    """Landed items (asset, tools, inventory), requests and approvals to the stock tables.

    Items may carry nested objects. Returns the stored items with their current stock.
    """
    flat = {"asset": N.flatten_assets, "tools": N.flatten_tools, "inventory": N.flatten_inventory}
    cleaned = {n: normalize_nulls(S.clean_items(flat[n](df), as_of)) for n, df in items.items()}
    tools = normalize_nulls(S.requested_tools(requests["tools"]))
    inventory = normalize_nulls(S.requested_inventory(requests["inventory"]))
    asked = _store(S.combined_requests(tools, inventory, as_of), f"{out}/processed/requests")
    whole = S.combined_items(cleaned)
    if approvals is None:
        stock = S.current_stock(whole, None, None)
        joined = S.with_approvals(asked, None)
    else:
        decided = _store(normalize_nulls(S.approved_only(approvals)), f"{out}/processed/approved")
        stock = S.current_stock(whole, S.fulfilled_from(asked, decided), S.returned(decided))
        joined = S.with_approvals(asked, decided)
    joined = _store(joined, f"{out}/processed/combined_requested")
    stored = _store(stock.withColumn("last_updated", as_of), f"{out}/processed/combined_all")
    publish_table(joined, f"{out}/topics/requests", "id")
    publish_table(stored, f"{out}/topics/inventory", "id")
    return stored


def run_goals(goals: DataFrame, key_results: DataFrame, updates: DataFrame, out: str, as_of: Column) -> None:
    """Goals, key results and updates to their analytics topics below ``out``."""
    stamp = {"timestamp": as_of}
    risked = G.with_risk(goals, as_of)
    progressed = _store(G.with_progress(key_results, as_of), f"{out}/tables/key_results")
    parts = saved(G.velocity_parts(updates), "velocity-parts")
    trends = _store(G.trends_of(parts), f"{out}/tables/trends")
    publish_table(risked, f"{out}/topics/objectives_transformed", "objective_id")
    publish_table(G.department_stats(goals).withColumns(stamp), f"{out}/topics/department_stats", "department")
    publish_table(progressed, f"{out}/topics/key_results_transformed", "key_result_id")
    publish_table(G.key_result_metrics(progressed).withColumns(stamp), f"{out}/topics/aggregate_metrics")
    publish_table(trends.withColumns(stamp), f"{out}/topics/trends", "key_result_id")
    publish_table(G.insights_of(parts).withColumns(stamp), f"{out}/topics/insights")


# The fields of a nested plan document.
PLAN_ITEM = (
    "id: BIGINT, description: STRING, createdAt: STRING, updatedAt: STRING, "
    "tasks: array<struct<id: BIGINT, task: STRING, weight: DOUBLE, priority: STRING, status: STRING, "
    "planTask: array<struct<id: BIGINT, task: STRING, weight: DOUBLE, priority: STRING, status: STRING, "
    "createdAt: STRING, updatedAt: STRING>>>>"
)


def run_plans(
    spark: SparkSession, path: str, out: str, as_of: Column, run_id: str = "unknown", per_line: bool = False
) -> DataFrame:
    """Landed plan documents to the flat table (csv and json) and keyed messages.

    A document is an envelope, a list of plans, or one plan.
    """
    plans = scan_envelopes(spark, path, PLAN_ITEM, per_line, bare_object=True)
    flat = _store(N.flatten_plans_outer(plans, as_of), f"{out}/flattened_tasks.parquet")
    M.write_table(flat, f"{out}/flattened_tasks.csv", **M.PACKED)
    M.write_table(flat, f"{out}/flattened_tasks.json", **M.PACKED)
    sent = M.to_messages(flat, "weekly_plan_id", kafka_sent_timestamp=as_of, dag_run_id=F.lit(run_id))
    M.write_table(sent, f"{out}/topics/plan_tasks", "json", **M.PACKED)
    return flat


def run_plan_search(spark: SparkSession, path: str, out: str, per_line: bool = False, record: str = PLAN_ITEM) -> DataFrame:
    """Landed plan documents with their list under any known root key to the flat table of daily tasks."""
    docs = spark.read.text(path, wholetext=not per_line)
    flat = _store(N.flatten_plans_inner(search_roots(docs, "value", record)), f"{out}/flattened_plan.parquet")
    M.write_table(flat, f"{out}/flattened_plan.csv", **M.QUICK)
    publish_table(flat, f"{out}/topics/weekly_plans", "weekly_plan_id", M.QUICK)
    return flat
