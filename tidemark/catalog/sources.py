"""Scan and sink queries. Input files are written from the test tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.functions.times import iso_text, moment
from tidemark.operators.ordered import numbered
from tidemark.plans.fixtures import AS_OF
from tidemark.session import scratch
from tidemark.sinks import messages as M
from tidemark.sinks import zones as Z
from tidemark.sources import csv_files as C
from tidemark.sources import json_docs as J
from tidemark.sources import tables as TB
from tidemark.sources import topics as TP


@query(
    "csv_scan",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || chr(10) || '"x"; y' ELSE c_name END AS c_name,
    CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment,
    CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS c_nationkey,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row_num,
    CASE WHEN c_nationkey % 2 = 0 THEN 'a/nation=' ELSE 'b/nation=' END || c_nationkey AS folder FROM customer""",
)
def csv_scan(t):
    """Two layouts: semicolons with padded cells, line ends in quotes and an extra column; and plain commas.

    One file per nation, in the order of the keys, so that row numbers and files are known.
    """
    folder = scratch(t.spark, "csv_scan")
    odd_name = F.concat("c_name", F.lit('\n"x"; y'))
    c = t.customer.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 5 == 0, odd_name).otherwise(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("c_name"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("c_nationkey"),
        "c_mktsegment",
        F.col("c_nationkey").alias("nation"),
    )
    c = c.repartition("nation").sortWithinPartitions("nation", "c_custkey")
    plain = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
    c.filter("nation % 2 = 0").write.partitionBy("nation").options(sep=";", **plain).csv(f"{folder}/a")
    c.filter("nation % 2 = 1").drop("c_mktsegment").write.partitionBy("nation").options(**plain).csv(f"{folder}/b")
    rows = C.scan_csv(t.spark, f"{folder}/*/*/*.csv").withColumnRenamed("_row_num", "row_num")
    return rows.withColumn("folder", F.regexp_extract("_source_file", "([ab]/nation=[0-9]+)/[^/]*$", 1)).drop("_source_file")


@query(
    "csv_typed_scan",
    """SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, p_retailprice,
    CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS mixed,
    CASE WHEN p_partkey % 2 = 0 THEN p_size + 0.5 ELSE p_size END::DOUBLE AS half FROM part""",
)
def csv_typed_scan(t):
    path = scratch(t.spark, "csv_typed_scan")
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    rows = t.part.select(
        "p_partkey",
        "p_name",
        "p_size",
        "p_retailprice",
        F.when(key % 4 == 1, "n/a").when(key % 4 != 0, size).alias("mixed"),
        F.when(key % 2 == 0, F.concat(size, F.lit(".5"))).otherwise(size).alias("half"),
    )
    M.write_table(rows, path, "csv")
    return C.scan_typed_csv(t.spark, path, rows.columns)


CUSTOMER = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
_THREE = "SELECT 'csv' AS format, {t}.* FROM {t} UNION ALL SELECT 'json', {t}.* FROM {t} UNION ALL SELECT 'parquet', {t}.* FROM {t}"


def _formats(t, df, name, schema):
    out = None
    for kind in ("csv", "json", "parquet"):
        path = f"{scratch(t.spark, name)}.{kind}"
        M.write_table(df, path)
        part = TB.load_table(t.spark, path, schema).select(F.lit(kind).alias("format"), *df.columns)
        out = part if out is None else out.unionByName(part)
    return out


@query("load_formats", _THREE.format(t="customer"))
def load_formats(t):
    return _formats(t, t.customer, "load_formats", CUSTOMER)


PART = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"


@query("write_formats", _THREE.format(t="part"))
def write_formats(t):
    return _formats(t, t.part, "write_formats", PART)


def land_envelopes(df, path, key, per_file=10_000, bare=False):
    """Write ``{"data": [...]}`` documents of at most ``per_file`` items, one per file."""
    page = F.floor(F.col(key) / per_file)
    item = F.struct(*df.columns)
    docs = df.groupBy(page.alias("_page")).agg(F.collect_list(item).alias("data"))
    body = F.to_json("data") if bare else F.to_json(F.struct("data"))
    docs.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


ORDER_ITEM = "o_orderkey: BIGINT, o_custkey: BIGINT, o_orderstatus: STRING, o_totalprice: DOUBLE, o_orderpriority: STRING"
_ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("json_envelope_scan", f"SELECT {', '.join(_ORDER)} FROM orders")
def json_envelope_scan(t):
    """Half of the documents are envelopes, half bare lists."""
    folder = scratch(t.spark, "json_envelope_scan")
    o = t.orders.select(*_ORDER)
    land_envelopes(o.filter("o_custkey % 2 = 0"), f"{folder}/a", "o_orderkey")
    land_envelopes(o.filter("o_custkey % 2 = 1"), f"{folder}/b", "o_orderkey", bare=True)
    return J.scan_envelopes(t.spark, f"{folder}/*/*.txt", ORDER_ITEM)


@query(
    "endpoint_union",
    """SELECT 'parts' AS endpoint_type, p_partkey AS id, p_name AS name, p_retailprice AS price FROM part
    UNION ALL SELECT 'customers', c_custkey, c_name, c_acctbal FROM customer""",
)
def endpoint_union(t):
    folder = scratch(t.spark, "endpoint_union")
    names = ["id", "name", "price"]
    land_envelopes(t.part.select("p_partkey", "p_name", "p_retailprice").toDF(*names), f"{folder}/parts", "id")
    land_envelopes(
        t.customer.select("c_custkey", "c_name", "c_acctbal").toDF(*names), f"{folder}/customers", "id"
    )
    paths = {n: f"{folder}/{n}/*.txt" for n in ("parts", "customers")}
    return J.scan_endpoints(t.spark, paths, "id: BIGINT, name: STRING, price: DOUBLE")


@query(
    "json_root_search",
    "SELECT o_orderkey AS id, o_orderpriority AS description FROM orders WHERE o_orderkey % 10 <> 9",
)
def json_root_search(t):
    """Documents of ten shapes; the last one is a bare string and gives no rows."""
    shape = F.col("o_orderkey") % 10
    record = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("description")))
    value = F.when(shape == 8, F.concat(F.lit("["), record, F.lit("]"))).when(
        shape == 9, F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))
    )
    for i, key in enumerate(J.ROOT_KEYS):
        value = value.when(shape == i, F.concat(F.lit('{"n": 1, "' + key + '": ['), record, F.lit("]}")))
    docs = t.orders.select(value.otherwise(record).alias("value"))
    return J.search_roots(docs, "value", "id: BIGINT, description: STRING")


@query(
    "incremental_scan",
    f"""SELECT objective_id, department, status, priority, created_date, updated_date, target_completion_date FROM v_objectives
    WHERE updated_date >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY""",
    ("v_objectives",),
)
def incremental_scan(t):
    return TB.incremental_scan(t.objectives, TB.GOAL_COLUMNS, "updated_date", moment(AS_OF))


@query(
    "incremental_key_results",
    f"""SELECT key_result_id, objective_id, target_value, current_value, status, progress_percentage, due_date AS updated_date, due_date
    FROM v_key_results WHERE due_date >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY""",
    ("v_key_results",),
)
def incremental_key_results(t):
    """Key results changed since the day before; the fixture's change date is the due date."""
    rows = t.key_results.withColumn("updated_date", F.col("due_date"))
    return TB.incremental_scan(rows, TB.KEY_RESULT_COLUMNS, "updated_date", moment(AS_OF))


@query(
    "incremental_updates",
    """SELECT update_id, key_result_id, progress_percentage, update_date, created_date FROM v_progress_updates
    WHERE update_date >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY""",
    ("v_progress_updates",),
)
def incremental_updates(t):
    """Updates of the week before a moment, and since."""
    return TB.incremental_scan(t.progress_updates, TB.UPDATE_COLUMNS, "update_date", moment("2024-01-20 12:00:00"), 7)


EVENT = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def land_events(t, name):
    """Events as JSON lines in a new folder."""
    path = scratch(t.spark, name)
    M.write_table(t.events, path, "json")
    return path


@query("topic_snapshot", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def topic_snapshot(t):
    topic = TP.read_topic(t.spark, land_events(t, "topic_snapshot"))
    return TP.parse_values(topic, EVENT)


@query(
    "bounded_consume",
    "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 1000",
)
def bounded_consume(t):
    topic = TP.read_topic(t.spark, land_events(t, "bounded_consume"))
    first = TP.bounded(TP.parse_values(topic, EVENT), "event_id", 1000)
    return first.select("event_id", "user_id", "event_type", "value")


@query(
    "raw_read_by_file",
    f"""SELECT doc_id, text, lang, n_chars, sha256(concat('src/', source, '.csv|', source)) AS _file_id, doc_id AS _row_num,
    CAST(doc_id AS VARCHAR) AS _record_id, '{AS_OF}' AS _loaded_at FROM documents""",
)
def raw_read_by_file(t):
    """Raw records of every file, payload expanded, in row order within the file."""
    path = F.concat(F.lit("src/"), F.col("source"), F.lit(".csv"))
    raw = Z.raw_records(
        t.documents, Z.file_id(path, F.col("source")), F.col("doc_id"), F.lit(AS_OF)
    ).withColumn("record_id", F.col("row_num"))
    return TB.raw_records(raw, "doc_id BIGINT, text STRING, lang STRING, n_chars BIGINT")


@query(
    "files_newest_first",
    """SELECT sha256(concat('src/', source, '.csv|', source)) AS file_id, concat('src/', source, '.csv') AS path, source AS sha256,
    count(*) AS rows, CAST(max(doc_id) AS VARCHAR) AS ingested_at FROM documents GROUP BY source""",
)
def files_newest_first(t):
    files = t.documents.groupBy(
        F.concat(F.lit("src/"), "source", F.lit(".csv")).alias("path"), F.col("source").alias("sha256")
    ).agg(F.count(F.lit(1)).alias("rows"), F.max("doc_id").cast("string").alias("ingested_at"))
    return TB.newest_files(Z.file_rows(files))


@query(
    "row_numbers",
    "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS row_num FROM documents",
)
def row_numbers(t):
    """Row number within each source; a large source is numbered slice by slice."""
    return numbered(t.documents.select("doc_id", "source"), "source", "doc_id")


@query(
    "latest_n",
    "SELECT event_id, ts, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000",
)
def latest_n(t):
    return (
        t.events.select("event_id", "ts", "user_id", "event_type", "value")
        .orderBy(F.col("ts").desc(), F.col("event_id").desc())
        .limit(1000)
    )


@query(
    "sample_rows",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5(concat(o_orderkey, '-42')), o_orderkey LIMIT 1000",
)
def sample_rows(t):
    from tidemark.operators.quality import sample_rows as sample

    return sample(t.orders, ["o_orderkey"], 1000, 42).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "event_times",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts FROM events",
)
def event_times(t):
    """Times of events as ISO text."""
    return t.events.select("event_id", iso_text(F.col("ts")).alias("ts"))
