"""Cleaning, validation, zone and document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.functions.fingerprint import row_fingerprint
from tidemark.functions.nulls import normalize_nulls
from tidemark.operators import documents as D
from tidemark.operators import rules as R
from tidemark.plans.fixtures import AS_OF
from tidemark.sinks import messages as M
from tidemark.sinks import zones as Z


def _title(expr: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({expr}), '[a-z]+|[^a-z]+'), "
        "lambda w: upper(w[1]) || w[2:]), '')"
    )


def _strip(expr: str) -> str:
    """Python's strip drops line ends too, SQL's trim only blanks."""
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def _number(c: str) -> str:
    return f"TRY_CAST(nullif({c}, '') AS DOUBLE)"


_TEXTS = [
    "source_file", "department", "objective", "priority", "quarter",
    "team_size", "budget", "progress", "status",
]

CLEAN = f"""c AS (SELECT row_num, source_file, {_title(_strip('department'))} AS department,
  CASE WHEN objective <> '' THEN {_strip('objective')} END AS objective,
  coalesce({_title(_strip('priority'))}, 'Medium') AS priority, upper({_strip('quarter')}) AS quarter,
  CAST(trunc({_number('team_size')}) AS BIGINT) AS team_size, {_number('budget')} AS budget,
  least(greatest({_number('progress')}, 0.0), 100.0) AS progress,
  coalesce({_title(_strip('status'))}, 'Unknown') AS status FROM v_goal_rows),
v AS (SELECT *, array_to_string(list_filter([
    CASE WHEN objective IS NULL OR length(trim(objective)) < 3 THEN 'Invalid or too short objective' END,
    CASE WHEN team_size < 1 THEN 'Team size must be positive' END], lambda x: x IS NOT NULL), '; ') AS errors,
  NOT (objective IS NULL OR length(trim(objective)) < 3 OR coalesce(team_size < 1, false)) AS valid FROM c)"""

GOALS = ("v_goal_rows",)


def validated(t):
    return R.validate_goals(t.goal_rows)


@query("clean_goals", f"WITH {CLEAN} SELECT * FROM c", GOALS)
def clean_goals(t):
    return R.clean_goals(t.goal_rows)


@query("validate_goals", f"WITH {CLEAN} SELECT row_num, errors, valid FROM v", GOALS)
def validate_goals(t):
    return validated(t).select(
        "row_num",
        F.array_join("_validation_errors", "; ").alias("errors"),
        F.col("_is_valid").alias("valid"),
    )


@query(
    "validate_generic",
    f"SELECT row_num, {', '.join(_strip(c) + ' AS ' + c for c in _TEXTS)}, true AS _is_valid FROM v_goal_rows",
    GOALS,
)
def validate_generic(t):
    return R.validate_generic(t.goal_rows)


@query(
    "range_rules",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, array_to_string(list_filter([
    CASE WHEN l_returnflag IS NULL OR length(l_returnflag) < 1 THEN 'l_returnflag missing or too short' END,
    CASE WHEN NOT l_quantity BETWEEN 1 AND 45 THEN 'l_quantity out of range' END,
    CASE WHEN NOT l_discount BETWEEN 0 AND 0.08 THEN 'l_discount out of range' END,
    CASE WHEN l_linestatus NOT IN ('O') THEN 'l_linestatus not allowed' END], lambda x: x IS NOT NULL), '; ') AS violations
    FROM lineitem""",
)
def range_rules(t):
    checked = R.check_rules(
        t.lineitem,
        ranges={"l_quantity": (1, 45), "l_discount": (0, 0.08)},
        required=["l_returnflag"],
        domains={"l_linestatus": ["O"]},
    )
    return checked.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount",
        F.array_join("violations", "; ").alias("violations"),
    )


@query(
    "goal_rules",
    f"""WITH {CLEAN} SELECT row_num, array_to_string(list_filter([
    CASE WHEN objective IS NULL OR length(trim(objective)) < 3 THEN 'objective missing or too short' END,
    CASE WHEN NOT progress BETWEEN 0 AND 100 THEN 'progress out of range' END,
    CASE WHEN NOT team_size BETWEEN 1 AND 1000 THEN 'team_size out of range' END,
    CASE WHEN NOT budget BETWEEN 0 AND 10000000 THEN 'budget out of range' END], lambda x: x IS NOT NULL), '; ') AS violations FROM c""",
    GOALS,
)
def goal_rules(t):
    """The configured ranges, required fields and text length over cleaned rows."""
    checked = R.check_rules(R.clean_goals(t.goal_rows), R.GOAL_RANGES, R.REQUIRED, R.MIN_TEXT_LENGTH)
    return checked.select("row_num", F.array_join("violations", "; ").alias("violations"))


@query(
    "domain_checks",
    """SELECT objective_id, status, priority, array_to_string(list_filter([
    CASE WHEN status NOT IN ('active', 'cancelled', 'on_hold') THEN 'status not allowed' END,
    CASE WHEN priority NOT IN ('low', 'medium', 'high') THEN 'priority not allowed' END], lambda x: x IS NOT NULL), '; ') AS violations
    FROM v_objectives""",
    ("v_objectives",),
)
def domain_checks(t):
    """Value domains, with one allowed value of each left out so that rules fire."""
    domains = {c: R.GOAL_DOMAINS[c] for c in ("status", "priority")}
    domains = {c: [v for v in vs if v not in ("completed", "critical")] for c, vs in domains.items()}
    checked = R.check_rules(t.objectives, domains=domains)
    return checked.select(
        "objective_id", "status", "priority", F.array_join("violations", "; ").alias("violations")
    )


def _nulls(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ('', 'n/a', 'N/A', 'NA', 'null', 'NULL', 'None', 'nan', 'NaN') THEN {c} END AS {c}"



@query(
    "normalize_nulls",
    f"SELECT row_num, {', '.join(_nulls(c) for c in _TEXTS)} FROM v_goal_rows",
    GOALS,
)
def normalize(t):
    return normalize_nulls(t.goal_rows)


@query(
    "column_aliases",
    "SELECT row_num, department, objective, priority, quarter, team_size, budget, progress, status FROM v_goal_rows",
    GOALS,
)
def column_aliases(t):
    back = {long: short for short, long in R.ALIASES.items()}
    return R.rename_aliases(t.goal_rows.drop("source_file").withColumnsRenamed(back))


@query(
    "normalize_values",
    """SELECT key_result_id, CASE WHEN target_value <> 0 THEN target_value END AS target_value, status,
    strftime(due_date, '%Y-%m-%dT%H:%M:%S') AS due_date FROM v_key_results""",
    ("v_key_results",),
)
def normalize_values(t):
    k = t.key_results
    nan = F.when(F.col("target_value") == 0, F.lit(float("nan"))).otherwise(F.col("target_value"))
    return M.normalize_values(k.withColumn("target_value", nan)).select(
        "key_result_id", "target_value", "status", "due_date"
    )


DOCUMENT = """array_to_string(list_filter([
    CASE WHEN objective <> '' THEN concat('Objective: ', objective) END,
    CASE WHEN department <> '' THEN concat('Department: ', department) END,
    CASE WHEN priority <> '' THEN concat('Priority: ', priority) END,
    CASE WHEN status <> '' THEN concat('Status: ', status) END,
    CASE WHEN quarter <> '' THEN concat('Quarter: ', quarter) END,
    CASE WHEN progress IS NOT NULL THEN concat('Progress: ', CAST(progress AS VARCHAR), '%') END,
    CASE WHEN team_size <> 0 THEN concat('Team Size: ', team_size, ' people') END,
    CASE WHEN budget <> 0 THEN concat('Budget: $', format('{:,.2f}', budget)) END], lambda x: x IS NOT NULL), '. ')"""


@query(
    "goal_documents",
    f"""WITH {CLEAN} SELECT row_num, source_file, valid, errors, {DOCUMENT} AS text,
    department AS label_department, priority AS label_priority, status AS label_status FROM v""",
    GOALS,
)
def goal_documents(t):
    d = D.goal_documents(validated(t), F.lit(AS_OF))
    return d.select(
        "meta.row_num",
        "meta.source_file",
        F.col("meta.is_valid").alias("valid"),
        F.coalesce(F.array_join("meta.validation_errors", "; "), F.lit("")).alias("errors"),
        "text",
        F.col("labels")["department"].alias("label_department"),
        F.col("labels")["priority"].alias("label_priority"),
        F.col("labels")["status"].alias("label_status"),
    )


@query(
    "generic_documents",
    """SELECT c_custkey, concat_ws(chr(10), c_name, c_mktsegment, n_name, r_name) AS text
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def generic_documents(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    d = D.generic_documents(rows, F.lit(AS_OF))
    return d.select("meta.source_row.c_custkey", "text")


WORDS = r"""w AS (SELECT doc_id, text, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN []
  ELSE string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') END AS w FROM documents)"""


@query(
    "chunk_words",
    f"""WITH {WORDS} SELECT doc_id, unnest(range(len(ks))) AS chunk_index, unnest(cs) AS chunk
FROM (SELECT doc_id, ks, list_transform(ks, lambda k: array_to_string(w[k+1:k+512], ' ')) AS cs
      FROM (SELECT doc_id, w, range(0, len(w), 448) AS ks FROM w))""",
)
def chunk_words(t):
    return _indexed(D.word_chunks(t.documents, ["doc_id"]))


def _indexed(df):
    return df.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


# One fold per document: state and element share a struct type, as list_reduce asks.
SENTENCES = r"""e AS (SELECT doc_id, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'),
    lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''),
    lambda s: {'done': []::VARCHAR[], 'open': []::VARCHAR[], 'n': 0::BIGINT, 's': s, 'k': len(regexp_split_to_array(s, '\s+'))::BIGINT}) AS es
  FROM documents),
f AS (SELECT doc_id, list_reduce(es, lambda a, x: CASE WHEN a.n + x.k > 384 AND len(a.open) > 0 THEN
    {'done': list_append(a.done, array_to_string(a.open, ' ')),
     'open': list_append(regexp_split_to_array(array_to_string(CASE WHEN len(a.open) > 48 THEN a.open[-48:] ELSE a.open END, ' '), '\s+'), x.s),
     'n': len(regexp_split_to_array(array_to_string(CASE WHEN len(a.open) > 48 THEN a.open[-48:] ELSE a.open END, ' '), '\s+')) + x.k,
     's': '', 'k': 0::BIGINT}
   ELSE {'done': a.done, 'open': list_append(a.open, x.s), 'n': a.n + x.k, 's': '', 'k': 0::BIGINT} END,
   {'done': []::VARCHAR[], 'open': []::VARCHAR[], 'n': 0::BIGINT, 's': '', 'k': 0::BIGINT}) AS st FROM e WHERE len(es) > 0),
g AS (SELECT doc_id, CASE WHEN len(st.open) > 0 THEN list_append(st.done, array_to_string(st.open, ' ')) ELSE st.done END AS cs FROM f)"""


@query(
    "chunk_sentences",
    f"WITH {SENTENCES} SELECT doc_id, unnest(range(len(cs))) AS chunk_index, unnest(cs) AS chunk FROM g",
)
def chunk_sentences(t):
    return _indexed(D.sentence_chunks(t.documents, ["doc_id"]))


@query(
    "curated_chunks",
    f"""WITH {WORDS},
p AS (SELECT doc_id, len(w) > 384 AS is_chunked, CASE WHEN len(w) > 384 THEN
  list_transform(range(0, len(w), 448), lambda k: array_to_string(w[k+1:k+512], ' ')) ELSE [text] END AS parts FROM w)
SELECT doc_id, is_chunked, CASE WHEN is_chunked THEN i END AS chunk_index, CASE WHEN is_chunked THEN len(parts) END AS total_chunks, parts[i + 1] AS text
FROM (SELECT *, unnest(range(len(parts))) AS i FROM p)""",
)
def curated_chunks(t):
    d = D.curated_chunks(t.documents.select("doc_id", "text"))
    return d.withColumns({c: F.col(c).cast("bigint") for c in ("chunk_index", "total_chunks")})


@query(
    "raw_payload",
    f"""SELECT sha256(concat('src/', source, '.csv|', source)) AS file_id, doc_id AS row_num,
    CAST(to_json({{'doc_id': doc_id, 'text': text, 'lang': lang, 'source': source, 'n_chars': n_chars}}) AS VARCHAR) AS payload,
    '{AS_OF}' AS loaded_at FROM documents""",
)
def raw_payload(t):
    path = F.concat(F.lit("src/"), F.col("source"), F.lit(".csv"))
    d = t.documents.withColumn("_meta", F.lit("left out"))
    return Z.raw_records(d, Z.file_id(path, F.col("source")), F.col("doc_id"), F.lit(AS_OF))


def processed(t):
    return Z.processed_records(validated(t), F.lit(AS_OF))


@query(
    "processed_zone",
    f"""WITH {CLEAN} SELECT CAST(NULL AS VARCHAR) AS source_file_id, CAST(row_num AS INTEGER) AS source_row_num, department, objective,
    CAST(NULL AS VARCHAR) AS objective_type, priority, quarter, CAST(team_size AS INTEGER) AS team_size, budget,
    CAST(NULL AS INTEGER) AS timeline_days, progress, status, valid, nullif(errors, '') AS rejected_reason, '{AS_OF}' AS processed_at FROM v""",
    GOALS,
)
def processed_zone(t):
    p = processed(t)
    return p.drop("original_payload").withColumns(
        {c: F.col(c).cast("double") for c in ("budget", "progress")}
    )


def curated(t):
    return Z.curated_records(D.goal_documents(validated(t), F.lit(AS_OF)), F.lit(AS_OF))


@query(
    "curated_zone",
    f"""WITH {CLEAN} SELECT concat(source_file, '#', row_num) AS source, row_num, valid AS is_valid, objective, '{AS_OF}' AS created_at FROM v""",
    GOALS,
)
def curated_zone(t):
    """Read back through the meta JSON."""
    meta = F.from_json("meta", "row_num bigint, is_valid boolean, original_fields struct<objective: string>")
    return curated(t).withColumn("m", meta).select(
        "source", "m.row_num", "m.is_valid", "m.original_fields.objective", "created_at"
    )


def stats(t):
    rows = t.goal_rows
    files = rows.select(
        F.col("source_file").alias("path"), F.sha2("source_file", 256).alias("sha256"),
        F.lit(AS_OF).alias("ingested_at"),
    )
    return Z.zone_stats(Z.file_rows(files), rows, processed(t), curated(t))


STATS = f"""{CLEAN},
s AS (SELECT 'raw' AS zone, 'files' AS metric, count(DISTINCT source_file) AS value FROM v
  UNION ALL SELECT 'raw', 'records', count(*) FROM v UNION ALL SELECT 'processed', 'total_records', count(*) FROM v
  UNION ALL SELECT 'processed', 'valid_records', count(CASE WHEN valid THEN 1 END) FROM v
  UNION ALL SELECT 'processed', 'invalid_records', count(CASE WHEN NOT valid THEN 1 END) FROM v
  UNION ALL SELECT 'curated', 'documents', count(*) FROM v UNION ALL SELECT 'curated', 'with_embeddings', 0 FROM (SELECT 1))"""


@query("zone_stats", f"WITH {STATS} SELECT * FROM s", GOALS)
def zone_stats(t):
    return stats(t)


@query(
    "run_totals",
    f"""WITH {CLEAN} SELECT count(DISTINCT source_file) AS files, count(*) AS records, count(*) AS loaded, count(*) AS curated,
    2 * count(*) AS processed_total FROM v""",
    GOALS,
)
def run_totals(t):
    return Z.run_totals(stats(t))


@query(
    "ingest_event",
    f"""SELECT concat(concat('src/', source), '.csv') AS file_path, concat(source, '.csv') AS key, 'raw_ingest' AS event_type,
    count(*) AS rows_ingested, '{AS_OF}' AS timestamp, 'completed' AS status FROM documents GROUP BY source""",
)
def ingest_event(t):
    counts = t.goal_rows.groupBy(F.col("source_file").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    return Z.ingest_events(counts, F.lit(AS_OF)).select("key", "value.*")


@query(
    "processed_event",
    f"""SELECT 'batch_991396800' AS key, 'processed_update' AS event_type, count(*) AS records_processed, '{AS_OF}' AS timestamp,
    'completed' AS status FROM lineitem""",
)
def processed_event(t):
    return Z.processed_event(t.lineitem, F.lit(991396800), F.lit(AS_OF)).select("key", "value.*")


@query(
    "upsert_latest",
    """SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
    ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def upsert_latest(t):
    return Z.upsert_latest(
        t.events.select("user_id", "event_type", "event_id", "ts", "value"),
        ["user_id", "event_type"],
        ["ts", "event_id"],
    )


@query(
    "json_messages",
    f"""SELECT id AS key, CAST(to_json({{'id': id, 'item_name': item_name, 'price': price, 'quantity': quantity, 'department_id': department_id,
    'source': source, 'kafka_sent_timestamp': '{AS_OF}', 'dag_run_id': 'manual'}}) AS VARCHAR) AS value FROM v_items""",
    ("v_items",),
)
def json_messages(t):
    return M.to_messages(
        t.items, "id", kafka_sent_timestamp=F.lit(AS_OF), dag_run_id=F.lit("manual")
    )


BROKEN = "CASE WHEN event_id % 7 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END"


@query(
    "dead_letter",
    f"""SELECT 'invalid json' AS error, 'raw_ingest' AS source_topic, 0 AS "partition", event_id AS "offset", payload, '{AS_OF}' AS ts
    FROM (SELECT event_id, {BROKEN} AS payload FROM events) WHERE NOT json_valid(payload)""",
)
def dead_letter(t):
    messages = t.events.select(
        F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.expr(BROKEN).alias("value")
    )
    error = F.when(F.try_parse_json("value").isNull(), "invalid json")
    return Z.dead_letters(messages, error, "raw_ingest", F.lit(AS_OF))


@query(
    "done_event",
    f"""SELECT CAST(event_id AS VARCHAR) AS file_id, event_type AS batch_id, 'api' AS source,
    CASE WHEN event_id % 3 = 0 THEN user_id ELSE event_id % 3 END AS count, '{AS_OF}' AS ts FROM events""",
)
def done_event(t):
    events = t.events.select(
        F.col("event_id").cast("string").alias("file_id"),
        F.col("event_type").alias("batch_id"),
        F.lit("api").alias("source"),
        (F.col("event_id") % 3).alias("count"),
        F.col("user_id").alias("rows"),
    )
    return Z.done_events(events, F.lit(AS_OF))


@query(
    "row_fingerprint",
    """SELECT o_orderkey, sha256(concat('{"o_custkey": ', o_custkey, ', "o_orderdate": "', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'),
    '", "o_orderkey": ', o_orderkey, ', "o_orderpriority": "', o_orderpriority, '", "o_orderstatus": "', o_orderstatus,
    '", "o_totalprice": ', CAST(o_totalprice AS VARCHAR), '}')) AS fingerprint FROM orders""",
)
def fingerprint(t):
    o = t.orders
    return o.select("o_orderkey", row_fingerprint(o).alias("fingerprint"))
