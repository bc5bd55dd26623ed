"""Streamed velocity: state by key, late rows, restarts, and what a batch reads."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import goals as G
from tidemark.streaming import views as V
from tidemark.streaming.velocity import UNDATED, VelocityState, keep_velocity_parts

SCHEMA = "update_id bigint, key_result_id bigint, progress_percentage double, update_date timestamp_ntz"


def updates(seed, n=400):
    r = random.Random(seed)
    start = dt.datetime(1969, 12, 1)
    rows = []
    for i in range(n):
        key = r.choice([None, 1, 1, 1, *range(2, 12)])
        at = None if r.random() < 0.1 else start + dt.timedelta(hours=r.randrange(2000), minutes=r.randrange(3) * 20, microseconds=r.randrange(3))
        rows.append((i, key, r.choice([None, 0.0, 5.0, 5.0, float(r.randrange(100))]), at))
    return rows


def same_parts(got, want):
    def table(df):
        return {r["key_result_id"]: r.asDict() for r in df.collect()}

    a, b = table(got), table(want)
    assert set(a) == set(b)
    for k, r in b.items():
        assert all(a[k][c] == r[c] for c in ("n", "last_update", "up", "down", "finite")), (k, a[k], r)
        assert a[k]["total"] == pytest.approx(r["total"], abs=1e-9)


def test_batches_in_any_order_equal_the_batch_result(spark, tmp_path):
    rows = updates(1)
    random.Random(2).shuffle(rows)  # most rows are late
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def go():
        keep_velocity_parts(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), out)

    go()
    got = V.newest(spark, out)
    same_parts(got, G.velocity_parts(spark.createDataFrame(rows[:300], SCHEMA)))
    # a later run goes on from the state
    spark.createDataFrame(rows[300:], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    go()
    whole = spark.createDataFrame(rows, SCHEMA)
    got = V.newest(spark, out)
    same_parts(got, G.velocity_parts(whole))
    assert G.insights_of(got).first() == G.overall_insights(whole).first()
    trends = G.trends_of(got).withColumn("velocity", F.round("velocity", 9))
    assert sorted(trends.collect(), key=str) == sorted(G.key_result_trends(whole).withColumn("velocity", F.round("velocity", 9)).collect(), key=str)


class Held:
    """A state variable in memory that counts the values read."""

    def __init__(self):
        self.value, self.map, self.reads = None, {}, 0

    def exists(self):
        return self.value is not None

    def get(self):
        self.reads += 1
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        value = self.map[key]
        self.reads += len(value[0]) if isinstance(value[0], list) else 1
        return value

    def updateValue(self, key, value):
        self.map[key] = value

    def iterator(self):
        self.reads += len(self.map)
        return iter(self.map.items())


def processor():
    p = VelocityState()
    p.head, p.summaries, p.rows = Held(), Held(), Held()
    return p, (p.head, p.summaries, p.rows)


def feed(p, rows):
    frame = pd.DataFrame(rows, columns=["micros", "update_id", "p"]).astype({"micros": "Int64", "update_id": "Int64"})
    return next(p.handleInputRows(("k1",), iter([frame[:1], frame[1:]]), None)).iloc[0]


HOUR = 3_600_000_000


def test_rows_in_order_do_not_read_the_history():
    p, states = processor()
    reads = []
    for batch in range(300):
        for s in states:
            s.reads = 0
        out = feed(p, [((2 * batch + k) * HOUR, 2 * batch + k, float(k)) for k in range(2)])
        reads.append(sum(s.reads for s in states))
    assert out["n"] == 600 and max(reads) <= 5 and reads[-1] == reads[1]


def test_a_late_row_reads_the_rows_of_its_hour_only():
    p, (head, summaries, rows) = processor()
    for batch in range(50):
        feed(p, [(batch * HOUR + k, 100 * batch + k, 1.0) for k in range(100)])
    rows.reads = 0
    out = feed(p, [(7 * HOUR + 50, 9999, 90.0)])
    assert out["n"] == 5001 and rows.reads == 100 and summaries.reads >= 50
    assert (out["up"], out["down"]) == (1, 1)


def test_undated_rows_stay_last():
    p, (head, summaries, rows) = processor()
    feed(p, [(None, 5, 50.0), (None, 4, 40.0)])
    out = feed(p, [(24 * HOUR, 1, 10.0), (0, 2, 0.0)])
    # 0 -> 10 over one day, then 30 and 10 over a day each, and the first row
    assert (out["n"], out["total"], out["finite"], out["last_micros"]) == (4, 50.0, 4, 24 * HOUR)
    assert head.value[9] == UNDATED
