"""Hot keys are spread over tasks, and results stay those of the plain operation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import goals as G
from tidemark.operators import skew
from tidemark.operators import stock as S
from tests.test_goals import velocity
from tests.test_stock import rows


@pytest.fixture
def split(spark, monkeypatch):
    """Small keys are split too, and no partitions are merged after a shuffle."""
    monkeypatch.setattr(skew, "LEAST_ROWS", 100)
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    yield
    spark.conf.set(conf, "true")


def most_in_a_task(df):
    counts = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    return max(counts) / sum(counts)


def requests_and_approvals(spark, hot, n=20_000):
    """Nine tenths of the approvals have one key (null or not), all alike; requests have it a few times."""
    key = f"if(id % 10 < 9, {hot}, concat('k', id % 400))"
    app = spark.range(n).selectExpr(
        f"{key} AS id", "'t' AS tool_id", "'d' AS approved_date", "1 AS is_approved", "1 AS is_requester_received",
        "1 AS is_returned", "1.0D AS returned_quantity",
    )
    req = spark.range(900).selectExpr(f"if(id < 7, {hot}, concat('k', id)) AS id", "'t' AS tool_id", "double(id) AS requested_quantity")
    return req, app


@pytest.mark.parametrize("hot", ["'h'", "CAST(NULL AS STRING)"])
def test_hot_approvals_are_spread(spark, split, hot):
    req, app = requests_and_approvals(spark, hot)
    joined = S.with_approvals(req, app)
    plain = req.withColumn("id", F.coalesce("id", F.lit("nan"))).join(
        app.withColumn("id", F.coalesce("id", F.lit("nan"))).select("id", "tool_id", *S.APPROVAL_ADDED), ["id", "tool_id"], "left"
    )
    assert joined.columns == plain.columns and joined.dtypes == plain.dtypes
    assert joined.exceptAll(plain).count() == 0 and plain.exceptAll(joined).count() == 0
    assert joined.count() > 7 * 18_000
    assert most_in_a_task(joined) < 0.3


def test_hot_keys_on_one_side_only(spark, split):
    left = spark.range(3000).selectExpr("if(id % 3 = 0, 'a', if(id % 3 = 1, NULL, string(id))) AS id", "id AS x")
    right = spark.range(3000).selectExpr("if(id % 2 = 0, 'b', string(id)) AS id", "id AS y")
    hot = skew.hot_keys([left, right], ["id"])
    assert sorted(n for counts in hot.rows.values() for n in counts) == [1, 1, 1, 1000, 1000, 1500]
    got = skew.left_join(left, right, ["id"], hot)
    assert rows(got) == rows(left.join(right, ["id"], "left"))
    assert skew.hot_keys([left.limit(0), right.limit(0)], ["id"]).rows == {}


def test_hot_request_of_all_three_sides_of_the_stock(spark, split):
    items = spark.range(600).selectExpr("if(id % 3 = 0, 'h', string(id)) AS id", "int(id) AS quantity")
    sums = spark.range(900).selectExpr("string(id) AS tool_id", "if(id % 2 = 0, 'h', string(id)) AS id", "1.0D AS requested_quantity")
    back = spark.range(5).selectExpr("string(id) AS tool_id", "if(id % 2 = 0, 'h', string(id)) AS id", "double(id) AS returned_quantity")
    got = S.current_stock(items, sums, back)
    plain = S._stock(items.join(sums.drop("tool_id"), "id", "left").join(back.drop("tool_id"), "id", "left"))
    assert got.count() > 200 * 450 * 3 and rows(got) == rows(plain)
    assert most_in_a_task(got) < 0.3


@pytest.mark.parametrize("when", ["2024-05-05 10:10:00", None])
def test_hot_minute_is_spread(spark, split, when):
    """Nine tenths of all updates fall in one minute of one key, or have no date."""
    r = random.Random(7)
    at = dt.datetime.fromisoformat(when) if when else None
    data = []
    for i in range(20_000):
        hot = r.random() < 0.9
        t = at and at + dt.timedelta(microseconds=r.randrange(60_000_000))
        free = dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(9000))
        data.append((i, 5 if hot else r.randrange(40), float(r.randrange(100)), t if hot else free))
    df = spark.createDataFrame(data, "update_id bigint, key_result_id bigint, progress_percentage double, update_date timestamp_ntz")
    slices = [x["n"] for x in G.ordered_slices(df).groupBy("_slice").agg(F.count("*").alias("n")).collect()]
    assert len(slices) == 8 and max(slices) < 0.25 * len(data)
    by_key = {}
    for i, k, p, t in data:
        by_key.setdefault(k, []).append((t, i, p))
    got = {x["key_result_id"]: x for x in G.key_result_trends(df).collect()}
    assert set(got) == set(by_key)
    for k, x in got.items():
        assert x["update_frequency"] == len(by_key[k])
        if x["velocity"] is not None:
            assert x["velocity"] == pytest.approx(velocity(by_key[k]))
