"""Text that a run leaves is packed, is cut into several files, and reads back as it was."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.plans import flows as W
from tidemark.sinks import messages as M

PLAN = """id bigint, description string, createdAt string, updatedAt string, tasks array<struct<id: bigint, task: string,
weight: double, priority: string, status: string, planTask: array<struct<id: bigint, task: string, weight: double,
priority: string, status: string, createdAt: string, updatedAt: string>>>>"""


def plain_and_stored(spark, path):
    """Bytes of the texts below ``path``, and bytes of its files."""
    names = [f for f in os.listdir(path) if f.startswith("part-")]
    stored = sum(os.path.getsize(os.path.join(path, f)) for f in names)
    return spark.read.text(path).agg(F.sum(F.octet_length("value") + 1)).first()[0], stored


def land(spark, root, doc):
    plans = [(k, f"plan {k}, \"so\"", "c", "u", [(k, "t\né", 1.5, "high", None, [(k * 10 + j, f"d{j}", None, "low", "open", "a", "b") for j in range(5)])]) for k in range(200)]
    spark.createDataFrame(plans, PLAN).coalesce(1).select(F.to_json(doc)).write.text(f"{root}/in")
    return f"{root}/in"


@pytest.mark.parametrize("bare", [True, False])
def test_plan_outputs(spark, tmp_path, bare):
    doc = F.struct("*") if bare else F.struct(F.array(F.struct("*")).alias("data"))
    out = f"{tmp_path}/out"
    flat = W.run_plans(spark, land(spark, tmp_path, doc), out, F.lit("now"), per_line=True)
    assert flat.count() == 1000
    for name in ("flattened_tasks.csv", "flattened_tasks.json", "topics/plan_tasks"):
        plain, stored = plain_and_stored(spark, f"{out}/{name}")
        assert stored < plain / 4, name
    again = spark.read.schema(flat.schema).json(f"{out}/flattened_tasks.json")
    assert again.exceptAll(flat).isEmpty() and flat.exceptAll(again).isEmpty()
    sent = spark.read.schema("key STRING, value STRING").json(f"{out}/topics/plan_tasks")
    back = sent.select(F.from_json("value", flat.schema.simpleString()).alias("v")).select("v.*")
    assert back.exceptAll(flat).isEmpty() and flat.exceptAll(back).isEmpty()


def test_plan_search_outputs(spark, tmp_path):
    out = f"{tmp_path}/out"
    folder = land(spark, tmp_path, F.struct(F.array(F.struct("*")).alias("weeklyPlans")))
    assert W.run_plan_search(spark, folder, out, per_line=True).count() == 1000
    for name in ("flattened_plan.csv", "topics/weekly_plans"):
        plain, stored = plain_and_stored(spark, f"{out}/{name}")
        assert stored < plain / 4, name


def test_published_tables(spark, tmp_path):
    rows = spark.range(3000).select("id", F.concat(F.lit("text "), F.col("id")).alias("t"), F.lit(None).cast("double").alias("x"))
    W.publish_table(rows, f"{tmp_path}/topic", "id")
    plain, stored = plain_and_stored(spark, f"{tmp_path}/topic")
    assert stored < plain / 4
    sent = spark.read.schema("key STRING, value STRING").json(f"{tmp_path}/topic")
    assert sent.exceptAll(M.to_messages(rows, "id")).isEmpty() and sent.count() == 3000


def test_files_of_a_task_are_cut(spark, tmp_path):
    """A packed file is one task, so a large partition leaves several."""
    rows = spark.range(0, 1200, 1, 1).select(F.col("id").cast("string"))
    M.write_table(rows, f"{tmp_path}/t", "csv", **M.PACKED | {"maxRecordsPerFile": "500"})
    assert len([f for f in os.listdir(f"{tmp_path}/t") if f.startswith("part-")]) == 3
    assert int(M.PACKED["maxRecordsPerFile"]) > 0
