import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.times import moment
from tidemark.operators import goals as G


def velocity(rows):
    """Speed of one key with pandas: rows of (date, id, progress) in date order."""
    p = pd.DataFrame(rows, columns=["t", "i", "p"]).sort_values(["t", "i"], na_position="last")
    change = p["p"].diff().fillna(0)
    days = pd.to_datetime(p["t"]).diff().dt.days.fillna(1)
    with np.errstate(all="ignore"):
        return (change / days).mean()


@pytest.mark.parametrize("seed", range(3))
def test_velocity_matches_pandas(spark, seed):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        key = 0 if rng.random() < 0.4 else rng.randint(1, 150)
        # hot key 0 moves on whole days most of the time, so that its velocity stays finite
        gap = dt.timedelta(days=i) if key == 0 else dt.timedelta(hours=rng.randint(0, 2000))
        progress = None if rng.random() < 0.1 else float(rng.randint(0, 100))
        rows.append((i, key, progress, start + gap))
    df = spark.createDataFrame(
        rows, "update_id bigint, key_result_id bigint, progress_percentage double, update_date timestamp_ntz"
    )
    got = {r["key_result_id"]: r for r in G.key_result_trends(df).collect()}
    by_key = {}
    for i, key, p, t in rows:
        by_key.setdefault(key, []).append((t, i, p))
    assert set(got) == {k for k, v in by_key.items() if len(v) > 1}
    for k, r in got.items():
        v = velocity(by_key[k])
        assert r["update_frequency"] == len(by_key[k])
        assert r["trend_direction"] == ("positive" if v > 0 else "negative" if v < 0 else "stable")
        assert (r["velocity"] is None) == (not np.isfinite(v))
        if r["velocity"] is not None:
            assert r["velocity"] == pytest.approx(v)


def test_null_rules(spark):
    goals = spark.createDataFrame(
        [(1, "a", None, dt.datetime(2001, 6, 10)), (2, "a", "completed", dt.datetime(2001, 6, 10)),
         (3, None, "active", None), (None, "a", "active", dt.datetime(2001, 7, 20))],
        "objective_id bigint, department string, status string, target_completion_date timestamp_ntz",
    )
    risked = {r["objective_id"]: r["risk_level"] for r in G.with_risk(goals, moment("2001-06-01 12:00:00")).collect()}
    assert risked == {1: "high", 2: "low", 3: "low", None: "medium"}
    assert [tuple(r) for r in G.department_stats(goals).collect()] == [("a", pytest.approx(100 / 3), 2)]


def test_insights_count_null_key_once(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(1, 7, 1.0, t), (2, 7, 5.0, t + dt.timedelta(days=2)), (3, None, 1.0, t), (4, None, 2.0, t)],
        "update_id bigint, key_result_id bigint, progress_percentage double, update_date timestamp_ntz",
    )
    assert tuple(G.overall_insights(df).first()) == (4, 2, 2.0, 1, 0)


def test_progress_bins_are_right_closed_and_keep_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (25.0,), (25.5,), (100.0,), (101.0,), (None,)], "progress_percentage double")
    assert {r["bin"]: r["n"] for r in G.progress_bins(df).collect()} == {
        "0-25%": 1, "26-50%": 1, "51-75%": 0, "76-100%": 1,
    }


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    assert [tuple(r) for r in G.equal_width_histogram(df, "v").collect()] == [(0, 2)]


def test_seed_goals(spark):
    """Three goals and six key results of the sample schema."""
    kr = spark.createDataFrame(
        [(95.0, 87.0, 87.0), (2.0, 3.5, 65.0), (15.0, 8.0, 53.0), (10.0, 6.0, 60.0), (3.0, 1.0, 33.0), (0.0, 1.2, None)],
        "target_value double, current_value double, progress_percentage double",
    ).withColumns({"status": F.lit(None).cast("string"), "due_date": moment("2024-12-31 00:00:00")})
    m = G.key_result_metrics(G.with_progress(kr, moment("2024-12-01 00:00:00"))).first()
    assert m["on_track_count"] == 1 and m["needs_attention_count"] == 2 and m["total_key_results"] == 6
    assert m["average_progress"] == pytest.approx(298 / 6)
