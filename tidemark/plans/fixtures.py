"""Binding of the job inputs to the test tables.

The views are plain SQL that runs unchanged on Spark and on an ANSI engine, so
the oracle of a query starts from the same rows as the query.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-06-01 12:00:00"

VIEWS: dict[str, str] = {
    "v_objectives": """
SELECT o.o_orderkey AS objective_id, c.c_mktsegment AS department,
       CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE NULL END AS status,
       CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high'
            WHEN '3' THEN 'medium' ELSE 'low' END AS priority,
       o.o_orderdate AS created_date, o.o_orderdate AS updated_date,
       CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE o.o_orderdate + INTERVAL 90 DAY END AS target_completion_date
FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "v_key_results": """
SELECT l_orderkey AS objective_id, l_orderkey * 10 + l_linenumber AS key_result_id,
       CASE WHEN l_partkey % 19 = 0 THEN 0.0 ELSE l_quantity END AS target_value,
       l_quantity * (1.0 - l_discount) AS current_value,
       CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_suppkey % 9 = 0 THEN NULL ELSE 'active' END AS status,
       CASE WHEN l_returnflag = 'N' AND l_suppkey % 2 = 0 THEN NULL ELSE round(l_discount * 1000, 2) END AS progress_percentage,
       l_shipdate AS due_date
FROM {lineitem}""",
    "v_progress_updates": """
SELECT event_id AS update_id, user_id * 20 + event_id % 20 AS key_result_id,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE 100.0 * value / (100.0 + value) END AS progress_percentage,
       ts AS update_date, ts AS created_date
FROM {events}""",
    "v_items": """
SELECT CAST(p_partkey AS VARCHAR(20)) AS id, p_name AS item_name, p_retailprice AS price,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size END AS quantity,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS department_id,
       CASE p_partkey % 3 WHEN 0 THEN 'asset' WHEN 1 THEN 'tools' ELSE 'inventory' END AS source
FROM {part}""",
    "v_requests": """
SELECT CAST(l_orderkey AS VARCHAR(20)) AS id, CAST(l_partkey AS VARCHAR(20)) AS tool_id,
       l_shipdate AS requested_date, l_quantity AS requested_quantity,
       CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE concat('P', CAST(l_suppkey AS VARCHAR(20))) END AS requested_project_name,
       CASE WHEN l_linenumber % 2 = 0 THEN 'tools' ELSE 'inventory' END AS source
FROM {lineitem}""",
    "v_approved": """
SELECT CAST(l_orderkey AS VARCHAR(20)) AS id, CAST(l_partkey AS VARCHAR(20)) AS tool_id,
       CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20)) END AS approved_date,
       CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS is_approved,
       CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS is_requester_received,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_returned,
       floor(l_quantity / 2) AS returned_quantity
FROM {lineitem} WHERE l_linestatus = 'F'""",
    "v_goal_rows": """
SELECT doc_id AS row_num, concat('src/', source, '.csv') AS source_file,
       concat('  ', lang, ' ops ') AS department,
       CASE WHEN doc_id % 10 = 0 THEN 'ab' WHEN doc_id % 10 = 1 THEN '' ELSE text END AS objective,
       CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'hIGH' END AS priority,
       concat('q', CAST(doc_id % 4 + 1 AS VARCHAR(5))) AS quarter,
       CASE WHEN doc_id % 6 = 0 THEN 'n/a' ELSE CAST(doc_id % 6 - 1 AS VARCHAR(5)) END AS team_size,
       CASE WHEN doc_id % 9 = 0 THEN '' ELSE CAST(n_chars AS VARCHAR(20)) END AS budget,
       CAST(n_chars % 150 - 20 AS VARCHAR(10)) AS progress,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'on track' END AS status
FROM {documents}""",
    "v_binary_labels": """
SELECT l.doc_id AS doc_id, l.quality AS y_true, l.toxic AS y_pred, d.n_chars AS score
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
}

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def oracle(body: str, *views: str) -> str:
    """ANSI SQL with the named fixture views in front as common table expressions."""
    names = {t: t for t in BASE_TABLES}
    parts = [f"{v} AS ({VIEWS[v].format(**names).strip()})" for v in views]
    body = body.strip()
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


class Tables:
    """Lazy access to the test tables and fixture views below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        used = {t: self.table(t) for t in BASE_TABLES if "{" + t + "}" in sql}
        return self.spark.sql(sql, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.table(name)
        if "v_" + name in VIEWS:
            return self.view("v_" + name)
        raise AttributeError(name)
