"""End-to-end runs over landed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.goals import RISK_CTE, TREND_CTE, now
from tidemark.catalog.nested import OUTER, plans
from tidemark.catalog.registry import query
from tidemark.catalog.sources import land_envelopes
from tidemark.catalog.stock import ALL, STOCK
from tidemark.catalog.zones import CLEAN, DOCUMENT, GOALS
from tidemark.plans import flows as W
from tidemark.plans.fixtures import AS_OF
from tidemark.session import scratch
from tidemark.sinks.messages import PACKED, QUICK, write_table
from tidemark.sources import csv_files as C
from tidemark.sources.json_docs import scan_envelopes

def land_goal_csv(t, name):
    """Goal rows as CSV with short column names and a ``row_num`` of their own; texts keep their line ends."""
    path = scratch(t.spark, name)
    rows = t.goal_rows.select(
        "row_num",
        F.col("department").alias("dept"),
        F.col("objective").alias("obj"),
        "priority", "quarter", "team_size", "budget", "progress", "status",
    )
    write_table(rows, path, "csv")
    return path


@query(
    "zone_run",
    f"""WITH {CLEAN} SELECT CAST(row_num AS VARCHAR) AS row_num, department, objective, priority, quarter,
    CAST(team_size AS INTEGER) AS team_size, budget, progress, status, valid, nullif(errors, '') AS rejected_reason FROM v""",
    GOALS,
)
def zone_run(t):
    """CSV to processed zone, read from the stored table."""
    out = scratch(t.spark, "zone_run")
    W.run_zones(t.spark, land_goal_csv(t, "zone_run_in"), out, F.lit(AS_OF))
    stored = t.spark.read.parquet(f"{out}/processed/records_clean")
    return stored.select(
        F.get_json_object("original_payload", "$.row_num").alias("row_num"),
        "department", "objective", "priority", "quarter", "team_size",
        F.col("budget").cast("double").alias("budget"), F.col("progress").cast("double").alias("progress"),
        "status", "valid", "rejected_reason",
    )


@query(
    "zone_run_totals",
    rf"""WITH {CLEAN}, w AS (SELECT len(string_split(trim(regexp_replace({DOCUMENT}, '\s+', ' ', 'g')), ' ')) AS n FROM v),
    cuts AS (SELECT CAST(CASE WHEN n > 384 THEN ceil(n / 448.0) ELSE 1 END AS BIGINT) AS chunks FROM w)
    SELECT count(*) AS records, count(*) AS loaded, CAST(sum(chunks) AS BIGINT) AS curated,
    CAST(count(*) + sum(chunks) AS BIGINT) AS processed_total FROM cuts""",
    GOALS,
)
def zone_run_totals(t):
    out = scratch(t.spark, "zone_run_totals")
    return W.run_zones(t.spark, land_goal_csv(t, "zone_run_totals_in"), out, F.lit(AS_OF)).drop("files")


ITEM = "id: STRING, item_name: STRING, price: DOUBLE, quantity: INT, department_id: STRING, store: struct<id: BIGINT, store_name: STRING>"


@query("stock_run", f"WITH {STOCK} SELECT id, source, quantity, current_stock FROM s", ALL)
def stock_run(t):
    """Landed item envelopes, requests and approvals to the stored stock table."""
    folder = scratch(t.spark, "stock_run_in")
    items = {}
    for name in ("asset", "tools", "inventory"):
        rows = t.items.filter(F.col("source") == name).select(
            "id", "item_name", "price", "quantity", "department_id",
            F.struct(F.col("id").cast("bigint").alias("id"), F.col("item_name").alias("store_name")).alias("store"),
        )
        land_envelopes(rows, f"{folder}/{name}", "id")
        items[name] = scan_envelopes(t.spark, f"{folder}/{name}/*.txt", ITEM)
    requests = {n: t.requests.filter(F.col("source") == n).drop("source") for n in ("tools", "inventory")}
    requests["inventory"] = requests["inventory"].withColumnRenamed("tool_id", "inventory_id")
    out = scratch(t.spark, "stock_run")
    stored = W.run_stock(items, requests, t.approved, out, F.lit(AS_OF))
    return stored.select("id", "source", "quantity", F.col("current_stock").cast("double").alias("current_stock"))


def goal_topics(t, name):
    out = scratch(t.spark, name)
    W.run_goals(t.objectives, t.key_results, t.progress_updates, out, now())
    return out


def messages(t, folder, schema):
    topic = t.spark.read.schema("key STRING, value STRING").json(folder)
    return topic.select(F.from_json("value", schema).alias("v")).select("v.*")


@query(
    "goal_run_objectives",
    f"WITH {RISK_CTE} SELECT objective_id, department, days_remaining, risk_level FROM k",
    ("v_objectives",),
)
def goal_run_objectives(t):
    """The goals topic of a run."""
    schema = "objective_id BIGINT, department STRING, days_remaining BIGINT, risk_level STRING"
    return messages(t, f"{goal_topics(t, 'goal_run_objectives')}/topics/objectives_transformed", schema)


@query(
    "goal_run_trends",
    f"WITH {TREND_CTE} SELECT key_result_id, round(velocity, 6) AS velocity, trend_direction, update_frequency FROM t",
    ("v_progress_updates",),
)
def goal_run_trends(t):
    """The trends topic of a run."""
    schema = "key_result_id BIGINT, velocity DOUBLE, trend_direction STRING, update_frequency BIGINT"
    rows = messages(t, f"{goal_topics(t, 'goal_run_trends')}/topics/trends", schema)
    return rows.withColumn("velocity", F.round("velocity", 6))


@query("plan_run", f"WITH {OUTER} SELECT * FROM o")
def plan_run(t):
    """Nested plan documents landed as JSON, one per line, then flattened and stored."""
    folder = scratch(t.spark, "plan_run_in")
    docs = plans(t).select(F.to_json(F.struct(F.array(F.struct("*")).alias("data"))).alias("value"))
    docs.write.options(**PACKED).text(folder)
    out = scratch(t.spark, "plan_run")
    return W.run_plans(t.spark, folder, out, F.lit(AS_OF), per_line=True)


def _plan_lines(t, name, doc, packed=PACKED):
    """Plan documents as JSON, one per line."""
    folder = scratch(t.spark, name)
    plans(t).select(F.to_json(doc).alias("value")).write.options(**packed).text(folder)
    return folder


@query("plan_run_bare", f"WITH {OUTER} SELECT * FROM o")
def plan_run_bare(t):
    """Documents that are one plan each."""
    folder = _plan_lines(t, "plan_run_bare_in", F.struct("*"))
    return W.run_plans(t.spark, folder, scratch(t.spark, "plan_run_bare"), F.lit(AS_OF), per_line=True)


@query(
    "plan_run_search",
    f"""WITH {OUTER} SELECT nullif(weekly_plan_id, 0) AS weekly_plan_id, weekly_plan_desc, weekly_task_id, weekly_task_name, weekly_task_weight, weekly_task_priority,
    daily_task_id, daily_task_name, daily_task_weight, daily_task_priority FROM o WHERE daily_task_id IS NOT NULL""",
)
def plan_run_search(t):
    """Documents with their plans under another root key."""
    folder = _plan_lines(t, "plan_run_search_in", F.struct(F.array(F.struct("*")).alias("weeklyPlans")), QUICK)
    return W.run_plan_search(t.spark, folder, scratch(t.spark, "plan_run_search"), per_line=True)


@query("file_catalog", "SELECT count(*) AS rows FROM customer")
def file_catalog(t):
    """Row counts of the catalogued files of one table add up to the table."""
    path = scratch(t.spark, "file_catalog")
    write_table(t.customer, path, "csv")
    return C.file_catalog(t.spark, f"{path}/*.csv").agg(F.sum("estimated_rows").alias("rows"))


@query("zone_inventory")
def zone_inventory(t):
    """Three zone folders, one of them missing."""
    root = scratch(t.spark, "zone_inventory")
    write_table(t.customer, f"{root}/raw", "csv")
    write_table(t.orders, f"{root}/processed", "parquet")
    found = C.zone_inventory(t.spark, root, ["raw", "processed", "final"])
    return found.withColumn("files", F.array_join("files", ", "))
