"""Stock queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.operators import stock as S
from tidemark.plans.fixtures import AS_OF

def stamp():
    return F.lit(AS_OF)


def requests(t):
    """Complete, distinct requests of both sources."""
    return S.drop_incomplete(t.requests, ["requested_project_name", "requested_quantity"]).dropDuplicates()


def approvals(t):
    return S.approved_only(t.approved)


def items(t):
    """Complete, distinct items of the three sources."""
    return S.drop_incomplete(t.items, ["quantity", "department_id"]).dropDuplicates()


def joined(t):
    return S.with_approvals(requests(t), approvals(t))


def stock(t):
    return S.current_stock(
        items(t), S.fulfilled_from(requests(t), approvals(t)), S.returned(approvals(t))
    )



REQ = """q AS (SELECT DISTINCT * FROM v_requests WHERE requested_project_name IS NOT NULL AND requested_quantity IS NOT NULL)"""
APP = """ap AS (SELECT * FROM v_approved WHERE approved_date IS NOT NULL AND approved_date <> '')"""
JOINED = f"""{REQ}, {APP},
j AS (SELECT q.*, ap.approved_date, ap.is_approved, ap.is_requester_received, ap.is_returned, ap.returned_quantity
      FROM q LEFT JOIN ap ON q.id = ap.id AND q.tool_id = ap.tool_id)"""
SUMS = f"""{JOINED},
f AS (SELECT tool_id, id, sum(requested_quantity) AS rq FROM j WHERE is_requester_received = 1 GROUP BY tool_id, id),
b AS (SELECT tool_id, id, sum(returned_quantity) AS tq FROM ap WHERE is_returned = 1 GROUP BY tool_id, id)"""
STOCK = f"""{SUMS},
s AS (SELECT i.*, CAST(i.quantity AS DOUBLE) - coalesce(f.rq, 0) + coalesce(b.tq, 0) AS current_stock
      FROM (SELECT DISTINCT * FROM v_items WHERE quantity IS NOT NULL AND department_id IS NOT NULL) i
      LEFT JOIN f ON i.id = f.id LEFT JOIN b ON i.id = b.id)"""
VIEWS = ("v_requests", "v_approved")
ALL = ("v_requests", "v_approved", "v_items")


@query(
    "clean_items",
    f"""SELECT id, item_name, price, CAST(NULL AS VARCHAR) AS amount, CAST(NULL AS VARCHAR) AS is_consumable,
    CAST(NULL AS VARCHAR) AS is_fixed_asset, department_id, CAST(NULL AS VARCHAR) AS date_of_purchased,
    CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS po_id, CAST(NULL AS VARCHAR) AS store_store_name,
    CAST(NULL AS VARCHAR) AS uom_name, quantity, '{AS_OF}' AS last_updated
    FROM v_items WHERE NOT (department_id IS NULL AND quantity IS NULL)""",
    ("v_items",),
)
def clean_items(t):
    return S.clean_items(t.items, stamp())


@query(
    "requested_tools",
    """SELECT id, '' AS item_name, requested_date, requested_project_name, requested_quantity, '' AS requester_id,
    '' AS requester_name, '' AS requester_received_date, '' AS status_name, '' AS store_name, tool_id, '' AS uom_name
    FROM v_requests""",
    ("v_requests",),
)
def requested_tools(t):
    return S.requested_tools(t.requests)


@query(
    "requested_inventory",
    """SELECT id, '' AS item_name, requested_date, requested_project_name, requested_quantity, '' AS requester_id,
    source AS requester_name, '' AS store_name, tool_id, '' AS uom_name FROM v_requests""",
    ("v_requests",),
)
def requested_inventory(t):
    raw = t.requests.withColumnsRenamed({"tool_id": "inventory_id", "source": "name"})
    return S.requested_inventory(raw)


@query(
    "approved_filter",
    f"""WITH {APP} SELECT id, tool_id, approved_date, '' AS "table", is_approved, is_requester_received, is_returned,
    CAST(returned_quantity AS BIGINT) AS returned_quantity FROM ap""",
    ("v_approved",),
)
def approved_filter(t):
    return approvals(t)


@query(
    "drop_incomplete",
    "SELECT * FROM v_requests WHERE requested_project_name IS NOT NULL AND requested_quantity IS NOT NULL",
    ("v_requests",),
)
def drop_incomplete(t):
    return S.drop_incomplete(t.requests, ["requested_project_name", "requested_quantity"])


@query(
    "union_sources",
    """SELECT id, tool_id, requested_date, requested_quantity, requested_project_name, source FROM v_requests
    WHERE source IN ('tools', 'inventory')""",
    ("v_requests",),
)
def union_sources(t):
    r = t.requests
    tools = r.filter(F.col("source") == "tools").drop("source").withColumn("tool_type", F.lit("x"))
    return S.union_sources(
        {"tools": tools, "inventory": r.filter(F.col("source") == "inventory").drop("source")}
    )


@query("dedup_rows", "SELECT DISTINCT * FROM v_requests", ("v_requests",))
def dedup_rows(t):
    return t.requests.dropDuplicates()


@query(
    "combined_requests",
    f"""WITH {REQ} SELECT id, tool_id, requested_date, requested_quantity, requested_project_name, source,
    '{AS_OF}' AS last_updated FROM q""",
    ("v_requests",),
)
def combined_requests(t):
    r = t.requests
    parts = [r.filter(F.col("source") == s).drop("source") for s in ("tools", "inventory")]
    return S.combined_requests(*parts, stamp())


@query(
    "requests_with_approvals",
    f"WITH {JOINED} SELECT * REPLACE (CAST(returned_quantity AS BIGINT) AS returned_quantity) FROM j",
    VIEWS,
)
def requests_with_approvals(t):
    return joined(t)


@query(
    "requests_without_approvals",
    f"""WITH {REQ} SELECT *, CAST(NULL AS VARCHAR) AS approved_date, CAST(NULL AS INTEGER) AS is_approved,
    CAST(NULL AS INTEGER) AS is_requester_received, CAST(NULL AS INTEGER) AS is_returned,
    CAST(NULL AS DOUBLE) AS returned_quantity FROM q""",
    ("v_requests",),
)
def requests_without_approvals(t):
    return S.with_approvals(requests(t), None)


@query(
    "fulfilled_requests",
    f"WITH {SUMS} SELECT tool_id, id, rq AS requested_quantity FROM f",
    VIEWS,
)
def fulfilled_requests(t):
    """Both sides are summed per key before they meet."""
    return S.fulfilled_from(requests(t), approvals(t))


@query(
    "returned_items",
    f"WITH {SUMS} SELECT tool_id, id, CAST(tq AS BIGINT) AS returned_quantity FROM b",
    VIEWS,
)
def returned_items(t):
    return S.returned(approvals(t)).withColumn(
        "returned_quantity", F.col("returned_quantity").cast("bigint")
    )


@query(
    "current_stock",
    f"WITH {STOCK} SELECT id, source, quantity, current_stock FROM s",
    ALL,
)
def current_stock(t):
    """The defined result: sums per (tool, request) joined on the request id alone."""
    return stock(t).select("id", "source", "quantity", F.col("current_stock").cast("double").alias("current_stock"))


@query(
    "current_stock_by_item",
    f"""WITH {SUMS},
ft AS (SELECT tool_id, sum(rq) AS rq FROM f GROUP BY tool_id),
bt AS (SELECT tool_id, sum(tq) AS tq FROM b GROUP BY tool_id)
SELECT i.id, i.source, i.quantity, CAST(i.quantity AS DOUBLE) - coalesce(ft.rq, 0) + coalesce(bt.tq, 0) AS current_stock
FROM v_items i LEFT JOIN ft ON i.id = ft.tool_id LEFT JOIN bt ON i.id = bt.tool_id
WHERE i.quantity IS NOT NULL AND i.department_id IS NOT NULL""",
    ALL,
)
def current_stock_by_item(t):
    """One row per item."""
    s = S.current_stock_by_item(
        items(t), S.fulfilled_from(requests(t), approvals(t)), S.returned(approvals(t))
    )
    return s.select("id", "source", "quantity", F.col("current_stock").cast("double").alias("current_stock"))


@query(
    "orphan_check",
    """SELECT key_result_id, objective_id FROM v_key_results k
    WHERE objective_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_objectives o WHERE o.objective_id = k.objective_id AND o.status IS NOT NULL)""",
    ("v_key_results", "v_objectives"),
)
def orphan_check(t):
    """Key results without a goal among the goals whose status is known."""
    goals = t.objectives.filter(F.col("status").isNotNull())
    return S.orphans(t.key_results, goals, "objective_id").select("key_result_id", "objective_id")


@query(
    "orphan_updates",
    """SELECT key_result_id, count(*) AS n FROM v_progress_updates u
    WHERE key_result_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_key_results k WHERE k.key_result_id = u.key_result_id) GROUP BY key_result_id""",
    ("v_progress_updates", "v_key_results"),
)
def orphan_updates(t):
    """Updates per key result that is not there, over both whole tables."""
    return S.orphans(t.progress_updates, t.key_results, "key_result_id").groupBy("key_result_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "request_kpis",
    f"""WITH {JOINED} SELECT count(*) AS total_requests,
    count(CASE WHEN is_approved IS NULL OR is_approved = 0 THEN 1 END) AS pending_requests,
    count(CASE WHEN is_approved = 1 THEN 1 END) AS approved_requests,
    count(CASE WHEN is_requester_received = 1 THEN 1 END) AS fulfilled_requests FROM j""",
    VIEWS,
)
def request_kpis(t):
    return S.request_kpis(S.approval_counts(requests(t), approvals(t)))


@query(
    "inventory_kpis",
    f"""WITH {STOCK} SELECT count(*) AS total_items, round(sum(current_stock), 4) AS total_stock,
    count(CASE WHEN current_stock < 10 THEN 1 END) AS low_stock_items, round(sum(price * quantity), 4) AS total_value FROM s""",
    ALL,
)
def inventory_kpis(t):
    return S.inventory_kpis(stock(t)).withColumns(
        {"total_stock": F.round(F.col("total_stock").cast("double"), 4), "total_value": F.round("total_value", 4)}
    )


@query(
    "stock_by_source",
    f"WITH {STOCK} SELECT source, round(sum(current_stock), 4) AS stock FROM s GROUP BY source",
    ALL,
)
def stock_by_source(t):
    return S.stock_by_source(stock(t)).withColumn("stock", F.round(F.col("stock").cast("double"), 4))


@query(
    "top_departments",
    """SELECT department_id, count(*) AS n FROM v_items WHERE department_id IS NOT NULL
    GROUP BY department_id ORDER BY n DESC, department_id LIMIT 10""",
    ("v_items",),
)
def top_departments(t):
    return S.top_departments(t.items)


@query(
    "request_status",
    f"""WITH {JOINED} SELECT CASE WHEN is_approved IS NULL OR is_approved = 0 THEN 'Pending' WHEN is_approved = 1 THEN 'Approved' END AS status,
    count(*) AS n FROM j GROUP BY 1""",
    VIEWS,
)
def request_status(t):
    return S.request_status(S.approval_counts(requests(t), approvals(t)))


@query(
    "daily_requests",
    """SELECT CAST(CAST(requested_date AS DATE) AS VARCHAR) AS day, count(*) AS n FROM v_requests
    WHERE requested_date IS NOT NULL GROUP BY 1""",
    ("v_requests",),
)
def daily_requests(t):
    return S.daily_requests(t.requests).withColumn("day", F.col("day").cast("string"))


@query(
    "last_rows",
    f"""SELECT id, item_name, price, department_id, quantity FROM v_items WHERE NOT (department_id IS NULL AND quantity IS NULL)
    ORDER BY id DESC LIMIT 20""",
    ("v_items",),
)
def last_rows(t):
    from tidemark.operators.nested import recent

    cleaned = S.clean_items(t.items, stamp()).withColumn("_rank", F.col("id"))
    return recent(
        cleaned, "_rank", ["id"], ["id", "item_name", "price", "department_id", "quantity", "current_stock"]
    )
