"""Queries over nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.operators import goals as G
from tidemark.operators import nested as N
from tidemark.plans.fixtures import AS_OF
from tidemark.plans.nesting import nested_items, nested_plans

NESTED_ITEMS = """n AS (SELECT i.*, s.s_suppkey, s.s_name, s.s_nationkey, u.n_nationkey, u.n_name
  FROM v_items i LEFT JOIN supplier s ON CASE WHEN CAST(i.id AS BIGINT) % 5 <> 0 THEN CAST(i.id AS BIGINT) % 10 END = s.s_suppkey
  LEFT JOIN nation u ON CAST(i.id AS BIGINT) % 25 = u.n_nationkey)"""
_KNOWN = {
    "store_id": "s_suppkey", "store_store_name": "s_name", "store_project_id": "s_nationkey",
    "uom_id": "n_nationkey", "uom_name": "n_name",
}


def _flat_sql(layout, extra=""):
    names = [f"{o}_{f}" for o, fields in layout.items() for f in fields]
    cols = [f"{_KNOWN[n]} AS {n}" if n in _KNOWN else f"CAST(NULL AS VARCHAR) AS {n}" for n in names]
    cols = [f'{c[: c.rindex(" ")]} "{c[c.rindex(" ") + 1 :]}"' for c in cols]
    return f"WITH {NESTED_ITEMS} SELECT id, item_name, price, quantity, department_id, source{extra}, {', '.join(cols)} FROM n"


def items(t):
    return nested_items(t.items, t.supplier, t.nation)


@query("flatten_asset", _flat_sql(N.ASSET_LAYOUT, ", 1 AS is_fixed_asset"), ("v_items",))
def flatten_asset(t):
    return N.flatten_assets(items(t))


@query("flatten_tool", _flat_sql(N.TOOL_LAYOUT), ("v_items",))
def flatten_tool(t):
    return N.flatten_tools(items(t).withColumn("inventory_user", F.lit("x")))


@query("flatten_inventory", _flat_sql(N.INVENTORY_LAYOUT), ("v_items",))
def flatten_inventory(t):
    return N.flatten_inventory(items(t).withColumn("inventory_user", F.lit("x")))


def _null(names):
    return ", ".join(f"CAST(NULL AS VARCHAR) AS {n}" for n in names)


def _nulld(names):
    return ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in names)


@query(
    "endpoint_flatten",
    f"""WITH {NESTED_ITEMS}
SELECT 'fixed_assets' AS endpoint_type, id, item_name, price, CAST(quantity AS DOUBLE) AS quantity, department_id, '' AS date_of_purchased,
  '' AS description, s_name AS store_name, CAST(NULL AS VARCHAR) AS store_location, n_name AS uom_name, CAST(NULL AS VARCHAR) AS status_name,
  CAST(NULL AS VARCHAR) AS project_name, CAST(NULL AS VARCHAR) AS inventory_type, {_null(['requested_date', 'requested_project_name'])},
  CAST(NULL AS DOUBLE) AS requested_quantity, {_null(['requester_id', 'requester_name', 'tool_id', 'approved_date', '"table"'])},
  {_nulld(['is_approved', 'is_requester_received', 'is_returned', 'returned_quantity'])} FROM n
UNION ALL
SELECT 'requested_tools', id, '', 0.0::DOUBLE, 0.0::DOUBLE, '', '', '', NULL, NULL, NULL, NULL, NULL, NULL,
  strftime(requested_date, '%Y-%m-%d %H:%M:%S'), requested_project_name, requested_quantity, '', '', tool_id, NULL, NULL, NULL, NULL, NULL, NULL
  FROM v_requests
UNION ALL
SELECT 'approved', id, '', 0.0::DOUBLE, 0.0::DOUBLE, '', '', '', NULL, NULL, NULL, NULL, NULL, NULL,
  NULL, NULL, NULL, NULL, NULL, tool_id, approved_date, '', is_approved, is_requester_received, is_returned, returned_quantity
  FROM v_approved""",
    ("v_items", "v_requests", "v_approved"),
)
def endpoint_flatten(t):
    return N.endpoint_flatten(
        {"fixed_assets": items(t), "requested_tools": t.requests, "approved": t.approved}
    )


def plans(t):
    return nested_plans(t.customer, t.orders, t.lineitem)


OUTER = f"""o AS (SELECT c_custkey AS weekly_plan_id, c_name AS weekly_plan_desc, '2001-01-01T00:00:00' AS weekly_plan_created,
  '2001-06-01T12:00:00' AS weekly_plan_updated, o_orderkey AS weekly_task_id, concat('order ', o_orderkey) AS weekly_task_name,
  o_totalprice AS weekly_task_weight, o_orderpriority AS weekly_task_priority, o_orderstatus AS weekly_task_status,
  l_orderkey * 10 + l_linenumber AS daily_task_id, CASE WHEN l_partkey IS NOT NULL THEN concat('part ', l_partkey) END AS daily_task_name,
  l_quantity AS daily_task_weight, l_returnflag AS daily_task_priority, l_linestatus AS daily_task_status,
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS daily_task_created, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS daily_task_updated,
  '{AS_OF}' AS extraction_timestamp
  FROM customer JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey)"""


def outer_rows(t):
    return N.flatten_plans_outer(plans(t), F.lit(AS_OF))


@query(
    "plan_flatten_inner",
    """SELECT CASE WHEN c_custkey <> 0 THEN c_custkey END AS weekly_plan_id, c_name AS weekly_plan_desc, o_orderkey AS weekly_task_id,
    concat('order ', o_orderkey) AS weekly_task_name, o_totalprice AS weekly_task_weight, o_orderpriority AS weekly_task_priority,
    l_orderkey * 10 + l_linenumber AS daily_task_id, concat('part ', l_partkey) AS daily_task_name,
    l_quantity AS daily_task_weight, l_returnflag AS daily_task_priority
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey""",
)
def plan_flatten_inner(t):
    return N.flatten_plans_inner(plans(t))


@query("plan_flatten_outer", f"WITH {OUTER} SELECT * FROM o")
def plan_flatten_outer(t):
    return outer_rows(t)


@query(
    "plan_counts",
    f"""WITH {OUTER} SELECT count(DISTINCT weekly_plan_id) AS total_plans, count(DISTINCT weekly_task_id) AS total_weekly_tasks,
    count(DISTINCT daily_task_id) AS total_daily_tasks, count(*) AS total_records FROM o""",
)
def plan_counts(t):
    return N.plan_counts(outer_rows(t))


_DIMS = ["weekly_task_priority", "weekly_task_status", "daily_task_priority", "daily_task_status"]


@query(
    "plan_task_counts",
    f"WITH {OUTER}, u AS ("
    + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value FROM o" for d in _DIMS)
    + ") SELECT dimension, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY dimension, value",
)
def plan_task_counts(t):
    return G.value_counts(outer_rows(t), _DIMS)


_SHOWN = [
    "weekly_plan_desc", "weekly_task_name", "daily_task_name", "weekly_task_priority",
    "weekly_task_weight", "weekly_task_status",
]


@query(
    "recent_tasks",
    f"""WITH {OUTER} SELECT {', '.join(_SHOWN)} FROM o
    ORDER BY extraction_timestamp DESC, weekly_task_id NULLS LAST, daily_task_id NULLS LAST, daily_task_name NULLS LAST LIMIT 20""",
)
def recent_tasks(t):
    return N.recent(
        outer_rows(t), "extraction_timestamp", ["weekly_task_id", "daily_task_id", "daily_task_name"], _SHOWN
    )


@query(
    "weight_histogram",
    f"""WITH {OUTER}, s AS (SELECT min(daily_task_weight) AS lo, max(daily_task_weight) AS hi FROM o)
SELECT CAST(least(floor((daily_task_weight - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n
FROM o, s WHERE daily_task_weight IS NOT NULL GROUP BY 1""",
)
def weight_histogram(t):
    return G.equal_width_histogram(outer_rows(t), "daily_task_weight", 20)


@query(
    "weekly_weight_histogram",
    f"""WITH {OUTER}, s AS (SELECT min(weekly_task_weight) AS lo, max(weekly_task_weight) AS hi FROM o)
SELECT CAST(least(floor((weekly_task_weight - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n
FROM o, s WHERE weekly_task_weight IS NOT NULL GROUP BY 1""",
)
def weekly_weight_histogram(t):
    return G.equal_width_histogram(outer_rows(t), "weekly_task_weight", 20)


@query(
    "json_normalize",
    """SELECT o_orderkey AS id, c_name AS "owner.name", c_nationkey AS "owner.place.nation", c_mktsegment AS "owner.place.segment",
    concat('["', replace(o_orderpriority, '-', '","'), '"]') AS tags FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def json_normalize(t):
    nested = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"),
        F.struct(
            F.col("c_name").alias("name"),
            F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("place"),
        ).alias("owner"),
        F.split("o_orderpriority", "-").alias("tags"),
    )
    return N.json_normalize(nested)
