"""Goal analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.functions.times import moment
from tidemark.operators import goals as G
from tidemark.plans.fixtures import AS_OF

_NOW = f"TIMESTAMP '{AS_OF}'"
_DAY = 86400000000.0


def _days(column: str) -> str:
    return f"CAST(floor((epoch_us({column}) - epoch_us({_NOW})) / {_DAY}) AS BIGINT)"


RISK_CTE = f"""r AS (SELECT *, {_days('target_completion_date')} AS days_remaining FROM v_objectives),
k AS (SELECT *, CASE WHEN days_remaining < 30 AND coalesce(status, '') <> 'completed' THEN 'high'
      WHEN days_remaining < 60 AND coalesce(status, '') <> 'completed' THEN 'medium' ELSE 'low' END AS risk_level FROM r)"""

PROGRESS_CTE = f"""p AS (SELECT * REPLACE (coalesce(progress_percentage, 0.0) AS progress_percentage),
  CASE WHEN target_value > 0 THEN current_value / target_value * 100 ELSE 0.0 END AS achievement_rate,
  coalesce(progress_percentage, 0.0) >= 70 AS is_on_track,
  coalesce(progress_percentage, 0.0) < 50 AND coalesce(status, '') <> 'completed' AS needs_attention,
  {_days('due_date')} AS days_to_deadline FROM v_key_results)"""

TREND_CTE = f"""d AS (
  SELECT key_result_id, update_date,
         progress_percentage - lag(progress_percentage) OVER w AS pd,
         CAST(floor((epoch_us(update_date) - epoch_us(lag(update_date) OVER w)) / {_DAY}) AS BIGINT) AS td
  FROM v_progress_updates
  WINDOW w AS (PARTITION BY key_result_id ORDER BY update_date NULLS LAST, update_id)),
r AS (SELECT key_result_id, update_date, coalesce(pd, 0.0) AS pd, coalesce(td, 1) AS td FROM d),
q AS (SELECT key_result_id, update_date,
             CASE WHEN td <> 0 THEN pd / td WHEN pd > 0 THEN CAST('Infinity' AS DOUBLE)
                  WHEN pd < 0 THEN CAST('-Infinity' AS DOUBLE) END AS v FROM r),
a AS (SELECT key_result_id, sum(CASE WHEN v = CAST('Infinity' AS DOUBLE) THEN 1 ELSE 0 END) AS ip,
             sum(CASE WHEN v = CAST('-Infinity' AS DOUBLE) THEN 1 ELSE 0 END) AS im,
             avg(CASE WHEN abs(v) < 1e300 THEN v END) AS fin, max(update_date) AS last_update, count(*) AS n
      FROM q GROUP BY key_result_id HAVING count(*) > 1),
t AS (SELECT key_result_id, CASE WHEN ip + im = 0 THEN fin END AS velocity,
       CASE WHEN ip > 0 AND im > 0 THEN 'stable' WHEN ip > 0 THEN 'positive' WHEN im > 0 THEN 'negative'
            WHEN fin > 0 THEN 'positive' WHEN fin < 0 THEN 'negative' ELSE 'stable' END AS trend_direction,
       last_update, n AS update_frequency FROM a)"""


def now():
    return moment(AS_OF)


@query(
    "department_stats",
    """SELECT department, round(100.0 * sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) / count(*), 6) AS completion_rate,
       count(objective_id) AS total_objectives
FROM v_objectives WHERE department IS NOT NULL GROUP BY department""",
    ("v_objectives",),
)
def department_stats(t):
    """Completion rate and goal count per department."""
    return G.department_stats(t.objectives).withColumn("completion_rate", F.round("completion_rate", 6))


@query(
    "objective_risk",
    f"WITH {RISK_CTE} SELECT objective_id, department, status, priority, days_remaining, risk_level FROM k",
    ("v_objectives",),
)
def objective_risk(t):
    return G.with_risk(t.objectives, now()).select(
        "objective_id", "department", "status", "priority", "days_remaining", "risk_level"
    )


@query(
    "key_result_progress",
    f"""WITH {PROGRESS_CTE} SELECT key_result_id, status, progress_percentage,
    round(achievement_rate, 6) AS achievement_rate, is_on_track, needs_attention, days_to_deadline FROM p""",
    ("v_key_results",),
)
def key_result_progress(t):
    return G.with_progress(t.key_results, now()).select(
        "key_result_id", "status", "progress_percentage",
        F.round("achievement_rate", 6).alias("achievement_rate"),
        "is_on_track", "needs_attention", "days_to_deadline",
    )


@query(
    "key_result_metrics",
    f"""WITH {PROGRESS_CTE} SELECT round(avg(progress_percentage), 6) AS average_progress, count(*) AS total_key_results,
    count(CASE WHEN is_on_track THEN 1 END) AS on_track_count,
    count(CASE WHEN needs_attention THEN 1 END) AS needs_attention_count,
    round(100.0 * count(CASE WHEN status = 'completed' THEN 1 END) / count(*), 6) AS completion_rate,
    greatest(max(target_value), max(current_value)) AS scale_max FROM p""",
    ("v_key_results",),
)
def key_result_metrics(t):
    m = G.key_result_metrics(G.with_progress(t.key_results, now()))
    return m.withColumn("average_progress", F.round("average_progress", 6)).withColumn(
        "completion_rate", F.round("completion_rate", 6)
    )


@query(
    "key_result_split",
    f"""WITH {PROGRESS_CTE} SELECT count(CASE WHEN is_on_track THEN 1 END) AS on_track,
    count(CASE WHEN needs_attention THEN 1 END) AS needs_attention,
    count(*) - count(CASE WHEN is_on_track THEN 1 END) - count(CASE WHEN needs_attention THEN 1 END) AS normal FROM p""",
    ("v_key_results",),
)
def key_result_split(t):
    return G.key_result_split(G.with_progress(t.key_results, now()))


@query(
    "goal_overview",
    f"""WITH {RISK_CTE} SELECT count(*) AS total_objectives, count(CASE WHEN status = 'completed' THEN 1 END) AS completed_objectives,
    round(100.0 * count(CASE WHEN status = 'completed' THEN 1 END) / count(*), 6) AS completion_rate,
    count(CASE WHEN risk_level = 'high' THEN 1 END) AS high_risk FROM k""",
    ("v_objectives",),
)
def goal_overview(t):
    return G.goal_overview(G.with_risk(t.objectives, now())).withColumn(
        "completion_rate", F.round("completion_rate", 6)
    )


@query(
    "progress_bins",
    """WITH b(lo, hi, bin) AS (VALUES (0, 25, '0-25%'), (25, 50, '26-50%'), (50, 75, '51-75%'), (75, 100, '76-100%'))
SELECT bin, count(progress_percentage) AS n FROM b LEFT JOIN v_key_results ON progress_percentage > lo AND progress_percentage <= hi
GROUP BY bin""",
    ("v_key_results",),
)
def progress_bins(t):
    return G.progress_bins(t.key_results)


@query(
    "goal_counts",
    f"""WITH {RISK_CTE},
u AS (SELECT 'status' AS dimension, status AS value FROM k UNION ALL SELECT 'priority', priority FROM k
      UNION ALL SELECT 'risk_level', risk_level FROM k UNION ALL SELECT 'department', department FROM k)
SELECT dimension, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY dimension, value""",
    ("v_objectives",),
)
def goal_counts(t):
    return G.value_counts(
        G.with_risk(t.objectives, now()), ["status", "priority", "risk_level", "department"]
    )


@query(
    "histogram_20",
    """WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
SELECT CAST(least(floor((l_quantity - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n
FROM lineitem, s GROUP BY 1""",
)
def histogram_20(t):
    return G.equal_width_histogram(t.lineitem, "l_quantity", 20)


@query(
    "achievement_histogram",
    f"""WITH {PROGRESS_CTE},
s AS (SELECT min(achievement_rate) AS lo, max(achievement_rate) AS hi FROM p)
SELECT CAST(least(floor((achievement_rate - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n
FROM p, s GROUP BY 1""",
    ("v_key_results",),
)
def achievement_histogram(t):
    return G.equal_width_histogram(G.with_progress(t.key_results, now()), "achievement_rate", 20)


@query(
    "key_result_trends",
    f"WITH {TREND_CTE} SELECT key_result_id, round(velocity, 6) AS velocity, trend_direction, last_update, update_frequency FROM t",
    ("v_progress_updates",),
)
def key_result_trends(t):
    """Velocity per key result; rows of a hot key are ordered day by day."""
    return G.key_result_trends(t.progress_updates).withColumn("velocity", F.round("velocity", 6))


@query(
    "trend_counts",
    f"WITH {TREND_CTE} SELECT trend_direction, count(*) AS n FROM t GROUP BY trend_direction",
    ("v_progress_updates",),
)
def trend_counts(t):
    return G.trend_counts(G.key_result_trends(t.progress_updates))


@query(
    "overall_insights",
    f"""WITH {TREND_CTE},
c AS (SELECT key_result_id, count(*) AS n FROM v_progress_updates GROUP BY key_result_id)
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM c) AS total_updates_processed, (SELECT count(*) FROM c) AS active_key_results,
       (SELECT round(avg(n), 6) FROM c WHERE key_result_id IS NOT NULL) AS avg_update_frequency,
       (SELECT count(*) FROM t WHERE trend_direction = 'positive') AS positive_trends,
       (SELECT count(*) FROM t WHERE trend_direction = 'negative') AS negative_trends""",
    ("v_progress_updates",),
)
def overall_insights(t):
    return G.overall_insights(t.progress_updates).withColumn(
        "avg_update_frequency", F.round("avg_update_frequency", 6)
    )


@query(
    "velocity_histogram",
    f"""WITH {TREND_CTE}, s AS (SELECT min(velocity) AS lo, max(velocity) AS hi FROM t)
SELECT CAST(least(floor((velocity - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n
FROM t, s WHERE velocity IS NOT NULL GROUP BY 1""",
    ("v_progress_updates",),
)
def velocity_histogram(t):
    trends = G.key_result_trends(t.progress_updates)
    return G.equal_width_histogram(trends, "velocity", 20)
