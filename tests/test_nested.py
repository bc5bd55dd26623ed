import json

from pyspark.sql import functions as F

from tidemark.operators import nested as N
from tidemark.plans.fixtures import Tables
from tidemark.plans.nesting import nested_plans


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents_follow_from_the_keys(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    hot = t.lineitem.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 3 == 0, 3).otherwise(F.col("l_orderkey")))
    heavy = t.orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(F.col("o_custkey")))
    plans = nested_plans(t.customer, heavy, hot)
    known = hot.join(heavy, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    months = known.select("l_orderkey", F.trunc("l_shipdate", "month")).distinct().count()
    bare_orders = heavy.join(hot, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    bare_orders = bare_orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).count()
    bare = t.customer.join(heavy, F.col("o_custkey") == F.col("c_custkey"), "left_anti").count()
    assert plans.count() == months + bare_orders + bare
    # one row per daily task, and one for a task without any
    assert N.flatten_plans_outer(plans, F.lit("now")).count() == known.count() + bare_orders


PLANS = [
    {"id": 1, "description": "p1", "tasks": [
        {"id": 10, "task": "w", "planTask": [{"id": 100, "task": "d", "weight": 1.0}, {"id": 101, "task": "e"}]},
        {"id": 11, "task": "", "name": "n", "planTask": []}]},
    {"id": 0, "weeklyPlanId": 5, "desc": "p2", "weeklyTasks": [{"id": 12, "name": "x", "dailyTasks": [{"id": 102, "name": "f"}]}]},
    {"id": 3, "description": "none"},
]
SCHEMA = """id bigint, weeklyPlanId bigint, description string, desc string, createdAt string, updatedAt string,
tasks array<struct<id: bigint, task: string, name: string, weight: double, priority: string, status: string,
  planTask: array<struct<id: bigint, task: string, name: string, weight: double, priority: string, status: string, createdAt: string, updatedAt: string>>,
  dailyTasks: array<struct<id: bigint, task: string, name: string, weight: double, priority: string, status: string, createdAt: string, updatedAt: string>>>>,
weeklyTasks array<struct<id: bigint, task: string, name: string, weight: double, priority: string, status: string,
  planTask: array<struct<id: bigint, task: string, name: string, weight: double, priority: string, status: string, createdAt: string, updatedAt: string>>,
  dailyTasks: array<struct<id: bigint, task: string, name: string, weight: double, priority: string, status: string, createdAt: string, updatedAt: string>>>>"""


def plans(spark):
    text = spark.createDataFrame([(json.dumps(p),) for p in PLANS], "v string")
    return text.select(F.from_json("v", SCHEMA).alias("p")).select("p.*")


def test_alternate_keys(spark):
    got = rows(
        N.flatten_plans_inner(plans(spark)).select(
            "weekly_plan_id", "weekly_plan_desc", "weekly_task_name", "daily_task_id", "daily_task_name"
        )
    )
    assert got == [(1, "p1", "w", 100, "d"), (1, "p1", "w", 101, "e"), (5, "p2", "x", 102, "f")]


def test_outer_keeps_tasks_without_daily_tasks(spark):
    flat = N.flatten_plans_outer(plans(spark), F.lit("t"))
    assert len(flat.columns) == 17
    assert rows(flat.select("weekly_plan_id", "weekly_task_id", "daily_task_id")) == [(1, 10, 100), (1, 10, 101), (1, 11, None)]


def test_null_object_gives_null_fields(spark):
    df = spark.createDataFrame([(1, None), (2, ("s",))], "id int, store struct<store_name: string>")
    flat = N.flatten_assets(df)
    assert "department" not in flat.columns and flat.columns[:3] == ["id", "is_fixed_asset", "store_id"]
    assert rows(flat.select("id", "store_store_name")) == [(1, None), (2, "s")]


def test_plan_files_of_all_shapes(spark, tmp_path):
    """A list, an envelope, one plan, and what is none of them."""
    from tidemark.plans.flows import run_plan_search, run_plans

    (tmp_path / "in").mkdir()
    plan = '{"id": %d, "description": "p", "tasks": [{"id": 1, "task": "t", "planTask": [{"id": 5, "task": "d"}]}]}'
    texts = [f"[{plan % 1}]", '{"data": [%s]}' % (plan % 2), plan % 3, '{"data": []}', '{"id": 4, "tas', '"x"', ""]
    for i, text in enumerate(texts):
        (tmp_path / "in" / f"{i}.json").write_text(text)
    rows = run_plans(spark, str(tmp_path / "in"), str(tmp_path / "out"), F.lit("now")).collect()
    assert sorted((r["weekly_plan_id"], r["daily_task_id"]) for r in rows) == [(1, 5), (2, 5), (3, 5)]
    (tmp_path / "in" / "8.json").write_text('{"results": [%s]}' % (plan % 9))
    rows = run_plan_search(spark, str(tmp_path / "in"), str(tmp_path / "found")).collect()
    # the tasks of a bare plan are found under a root key and so are its records
    assert sorted((r["weekly_plan_id"], r["daily_task_id"]) for r in rows) == [(1, 5), (2, 5), (9, 5)]
