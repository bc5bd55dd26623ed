"""Streaming queries. The source is ``events`` written as JSON lines; the result is the table a run leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.goals import PROGRESS_CTE, TREND_CTE, now
from tidemark.catalog.registry import query
from tidemark.catalog.sources import EVENT, land_events
from tidemark.operators import goals as G
from tidemark.plans.fixtures import AS_OF
from tidemark.session import scratch
from tidemark.sinks import messages as M
from tidemark.sources import topics as TP
from tidemark.streaming import ingest as I
from tidemark.streaming import views as V
from tidemark.streaming.velocity import keep_velocity_parts

BROKEN = "CASE WHEN event_id % 7 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END"


def land_envelopes(t, name):
    """Messages of the raw topic: envelope fields and payload; every seventh is cut short."""
    path = scratch(t.spark, name)
    e = t.events.select(
        F.col("event_id").alias("offset"),
        F.to_json(
            F.struct(
                F.concat(F.lit("src/"), "event_type", F.lit(".csv")).alias("_file_path"),
                F.col("event_type").alias("_file_sha256"),
                F.col("user_id").alias("_rows"),
                F.col("event_id").alias("_row_num"),
                F.col("user_id").alias("user"),
                F.col("value").alias("value"),
                F.struct(F.col("props").alias("p")).alias("inner"),
            )
        ).alias("value"),
    )
    cut = F.expr("substr(value, 1, length(value) - 1)")
    M.write_table(e.withColumn("value", F.when(F.col("offset") % 7 == 0, cut).otherwise(F.col("value"))), path, "parquet")
    stream = t.spark.readStream.schema("offset BIGINT, value STRING").parquet(path)
    return stream.withColumn("partition", F.lit(0))


def ingested(t, name):
    out = scratch(t.spark, name)
    I.start_ingest(land_envelopes(t, name + "_in"), out, F.lit(AS_OF)).awaitTermination()
    return out


@query(
    "stream_ingest",
    f"""SELECT sha256(concat('src/', event_type, '.csv|', event_type)) AS file_id, event_id AS row_num, '{AS_OF}' AS loaded_at,
    user_id AS "user", value, props AS p FROM events WHERE event_id % 7 <> 0""",
)
def stream_ingest(t):
    """Raw records left by the stream, payload expanded."""
    records = I.raw_zone(t.spark, ingested(t, "stream_ingest"))
    body = F.from_json("payload", "user BIGINT, value DOUBLE, inner STRUCT<p: STRING>, _rows BIGINT")
    return records.withColumn("b", body).filter("b._rows IS NULL").select(
        "file_id", "row_num", "loaded_at", "b.user", "b.value", "b.inner.p"
    )


@query(
    "stream_files",
    f"""SELECT concat('src/', event_type, '.csv') AS path, event_type AS sha256, '{AS_OF}' AS ingested_at,
    sha256(concat('src/', event_type, '.csv|', event_type)) AS file_id, CAST(arg_max(user_id, event_id) AS BIGINT) AS rows
    FROM events WHERE event_id % 7 <> 0 GROUP BY event_type""",
)
def stream_files(t):
    return I.raw_files(t.spark, ingested(t, "stream_files"))


@query(
    "stream_dead_letter",
    f"""SELECT 'invalid json' AS error, 'raw_ingest' AS source_topic, 0 AS "partition", event_id AS "offset", '{AS_OF}' AS ts
    FROM events WHERE event_id % 7 = 0""",
)
def stream_dead_letter(t):
    return I.dead_zone(t.spark, ingested(t, "stream_dead_letter"), "raw_ingest").drop("payload")


def events(t, name):
    topic = TP.stream_topic(t.spark, land_events(t, name))
    return TP.parse_values(topic, EVENT)


@query(
    "stream_kpis",
    """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(CASE WHEN value < 10 THEN 1 END) AS low
    FROM events GROUP BY event_type""",
)
def stream_kpis(t):
    out = scratch(t.spark, "stream_kpis")
    kpis = events(t, "stream_kpis_in").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.count_if(F.col("value") < 10).alias("low")
    )
    V.keep_summary(kpis, out)
    return V.newest(t.spark, out).withColumn("total", F.round("total", 4))


@query(
    "stream_latest",
    "SELECT event_id, ts, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000",
)
def stream_latest(t):
    out = scratch(t.spark, "stream_latest")
    rows = events(t, "stream_latest_in").select("event_id", "ts", "user_id", "event_type", "value")
    V.keep_latest(rows, out, [F.col("ts").desc(), F.col("event_id").desc()], 1000)
    return V.newest(t.spark, out)


@query("stream_file_sink", "SELECT * FROM events")
def stream_file_sink(t):
    out = scratch(t.spark, "stream_file_sink")
    V.append_table(events(t, "stream_file_sink_in"), out)
    return t.spark.read.parquet(f"{out}/table")


GOAL = """objective_id BIGINT, department STRING, status STRING, priority STRING, created_date TIMESTAMP_NTZ,
updated_date TIMESTAMP_NTZ, target_completion_date TIMESTAMP_NTZ"""


def goal_stream(t, name):
    path = scratch(t.spark, name)
    M.publish(M.to_messages(t.objectives, "objective_id").select("value"), path, "text")
    return TP.parse_values(TP.stream_topic(t.spark, path), GOAL)


def _risk_sql(columns):
    from tidemark.catalog.goals import RISK_CTE

    return f"WITH {RISK_CTE} SELECT {columns} FROM k"


@query("stream_transform", _risk_sql("objective_id, department, status, days_remaining, risk_level"), ("v_objectives",))
def stream_transform(t):
    """Topic to topic: goals in, goals with risk out, read back from the messages."""
    out = scratch(t.spark, "stream_transform")
    risked = G.with_risk(goal_stream(t, "stream_transform_in"), now())
    V.append_table(M.to_messages(risked, "objective_id"), out)
    done = t.spark.read.parquet(f"{out}/table")
    return TP.parse_values(done, GOAL + ", days_remaining BIGINT, risk_level STRING").select(
        "objective_id", "department", "status", "days_remaining", "risk_level"
    )


@query(
    "stream_department_stats",
    """SELECT department, round(100.0 * sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) / count(*), 6) AS completion_rate,
    count(objective_id) AS total_objectives FROM v_objectives WHERE department IS NOT NULL GROUP BY department""",
    ("v_objectives",),
)
def stream_department_stats(t):
    """The department totals as a running aggregate in complete mode."""
    out = scratch(t.spark, "stream_department_stats")
    V.keep_summary(G.department_stats(goal_stream(t, "stream_department_stats_in")), out)
    return V.newest(t.spark, out).withColumn("completion_rate", F.round("completion_rate", 6))


def message_stream(t, df, key, name):
    """A topic of the rows of ``df``, read as a stream."""
    path = scratch(t.spark, name)
    M.publish(M.to_messages(df, key).select("value"), path, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return TP.parse_values(TP.stream_topic(t.spark, path), fields)


@query(
    "stream_key_results",
    f"""WITH {PROGRESS_CTE} SELECT key_result_id, status, progress_percentage, round(achievement_rate, 6) AS achievement_rate,
    is_on_track, needs_attention, days_to_deadline FROM p""",
    ("v_key_results",),
)
def stream_key_results(t):
    """Topic to topic: key results in, key results with progress out, read back from the messages."""
    out = scratch(t.spark, "stream_key_results")
    progressed = G.with_progress(message_stream(t, t.key_results, "key_result_id", "stream_key_results_in"), now())
    V.append_table(M.to_messages(progressed, "key_result_id"), out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in progressed.schema)
    return TP.parse_values(t.spark.read.parquet(f"{out}/table"), fields).select(
        "key_result_id", "status", "progress_percentage", F.round("achievement_rate", 6).alias("achievement_rate"),
        "is_on_track", "needs_attention", "days_to_deadline",
    )


@query(
    "stream_trends",
    f"WITH {TREND_CTE} SELECT key_result_id, round(velocity, 6) AS velocity, trend_direction, last_update, update_frequency FROM t",
    ("v_progress_updates",),
)
def stream_trends(t):
    """Velocity and direction per key result, from the state that a stream of updates keeps of each."""
    out = scratch(t.spark, "stream_trends")
    keep_velocity_parts(message_stream(t, t.progress_updates, "key_result_id", "stream_trends_in"), out)
    return G.trends_of(V.newest(t.spark, out)).select("key_result_id", F.round("velocity", 6).alias("velocity"), "trend_direction", "last_update", "update_frequency")


@query(
    "stream_insights",
    f"""WITH {TREND_CTE},
c AS (SELECT key_result_id, count(*) AS n FROM v_progress_updates GROUP BY key_result_id)
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM c) AS total_updates_processed, (SELECT count(*) FROM c) AS active_key_results,
       (SELECT round(avg(n), 6) FROM c WHERE key_result_id IS NOT NULL) AS avg_update_frequency,
       (SELECT count(*) FROM t WHERE trend_direction = 'positive') AS positive_trends,
       (SELECT count(*) FROM t WHERE trend_direction = 'negative') AS negative_trends""",
    ("v_progress_updates",),
)
def stream_insights(t):
    """Totals over all updates, from the state that a stream of updates keeps of each key result."""
    out = scratch(t.spark, "stream_insights")
    keep_velocity_parts(message_stream(t, t.progress_updates, "key_result_id", "stream_insights_in"), out)
    return G.insights_of(V.newest(t.spark, out)).withColumn("avg_update_frequency", F.round("avg_update_frequency", 6))
