"""Nested plan documents from the flat test tables.

A plan is a customer, a weekly task an order, a daily task a line. A document holds the lines that
one order of a customer ships in one month. That rule follows from the keys alone, so the documents
of a row do not depend on how many others there are, and no counting pass is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import iso_text


def nested_plans(customer: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """id, description, createdAt, updatedAt, tasks[id, task, weight, priority, status, planTask[...]].

    One document per customer, order and ship month; one without lines for an order that has none, and
    one without tasks for a customer that has no order.
    """
    shipped = iso_text(F.col("l_shipdate"))
    # a column of its own: inside the list it would be evaluated without generated code
    lines = lineitem.select(
        "l_orderkey",
        F.trunc("l_shipdate", "month").alias("_month"),
        F.struct(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.concat(F.lit("part "), F.col("l_partkey")).alias("task"),
            F.col("l_quantity").alias("weight"),
            F.col("l_returnflag").alias("priority"),
            F.col("l_linestatus").alias("status"),
            shipped.alias("createdAt"),
            shipped.alias("updatedAt"),
        ).alias("_line"),
    )
    pages = lines.groupBy("l_orderkey", "_month").agg(F.collect_list("_line").alias("planTask"))
    # orders meet their customers first, so that the many pages are dealt out for one join only
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_custkey", "c_name", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"
    )
    held = pages.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).select(*placed.columns, "planTask")
    tasks = held.unionByName(_without(placed, "o_orderkey", lineitem, "l_orderkey", held, "planTask")).select(
        "c_custkey",
        "c_name",
        F.array(
            F.struct(
                F.col("o_orderkey").alias("id"),
                F.concat(F.lit("order "), F.col("o_orderkey")).alias("task"),
                F.col("o_totalprice").alias("weight"),
                F.col("o_orderpriority").alias("priority"),
                F.col("o_orderstatus").alias("status"),
                "planTask",
            )
        ).alias("tasks"),
    )
    owners = customer.select("c_custkey", "c_name")
    return tasks.unionByName(_without(owners, "c_custkey", orders, "o_custkey", tasks, "tasks")).select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("description"),
        F.lit("2001-01-01T00:00:00").alias("createdAt"),
        F.lit("2001-06-01T12:00:00").alias("updatedAt"),
        "tasks",
    )


def _without(
    parents: DataFrame, key: str, children: DataFrame, child_key: str, held: DataFrame, items: str
) -> DataFrame:
    """Each parent without children, with an empty list of the type that ``held`` has.

    Those with children are an inner join whose left side is the many pages of a large parent, which
    AQE can split; an outer join from the parent would keep them in one task.
    """
    keys = children.select(F.col(child_key).alias("_child")).distinct()
    bare = parents.join(keys, F.col(key) == F.col("_child"), "left_anti")
    return bare.withColumn(items, F.array().cast(held.schema[items].dataType))


def nested_items(items: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Items with a store (supplier) and a unit (nation) as nested objects; some have none."""
    stores = supplier.select(
        F.col("s_suppkey").alias("_s"),
        F.struct(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("store_name"),
            F.col("s_nationkey").alias("project_id"),
        ).alias("store"),
    )
    units = nation.select(
        F.col("n_nationkey").alias("_n"),
        F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("uom"),
    )
    keyed = items.withColumn("_id", F.col("id").cast("bigint"))
    return (
        keyed.join(stores, F.when(F.col("_id") % 5 != 0, F.col("_id") % 10) == F.col("_s"), "left")
        .join(units, F.col("_id") % 25 == F.col("_n"), "left")
        .withColumn("category", F.struct(F.col("source").alias("name")))
        .drop("_id", "_s", "_n")
    )
