import json

from pyspark.sql import functions as F

from tidemark.streaming import ingest as I
from tidemark.streaming import views as V

SCHEMA = "offset bigint, value string, partition int"


def write(spark, path, messages):
    rows = [(o, m if isinstance(m, str) else json.dumps(m), 0) for o, m in messages]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def state(spark, out):
    files = {(r["path"], r["sha256"]): (r["rows"], r["file_id"]) for r in I.raw_files(spark, out).collect()}
    records = sorted((r["offset"], r["payload"]) for r in I.raw_zone(spark, out).collect())
    return files, records, sorted(r["offset"] for r in I.dead_zone(spark, out, "raw").collect())


def test_ingest_restart_and_dead_letters(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    env = {"_file_path": "a.csv", "_file_sha256": "s", "_rows": 3}
    write(spark, source, [(0, {**env, "_row_num": 1, "x": 1, "y": {"z": [1.5, None]}}), (1, "{broken"), (2, "[1]"), (9, {"_row_num": "x"})])
    write(spark, source, [(3, {"_source": "api2", "_batch_id": "b", "n": "t"}), (4, {"q": None})])
    I.start_ingest(stream(spark, source), out, F.lit("t1")).awaitTermination()
    files, records, dead = state(spark, out)
    assert set(files) == {("a.csv", "s"), ("api2", "b"), ("api", "")}
    assert [(o, json.loads(p)) for o, p in records] == [(0, {"x": 1, "y": {"z": [1.5, None]}}), (3, {"n": "t"}), (4, {"q": None})]
    assert dead == [1, 2, 9]
    # nothing new: nothing added
    I.start_ingest(stream(spark, source), out, F.lit("t2")).awaitTermination()
    assert state(spark, out) == (files, records, dead)
    # a new version of a file keeps its id and takes the new row count
    write(spark, source, [(5, {**env, "_rows": 9, "x": 2})])
    I.start_ingest(stream(spark, source), out, F.lit("t3")).awaitTermination()
    after, more, _ = state(spark, out)
    assert after[("a.csv", "s")] == (9, files[("a.csv", "s")][1]) and len(more) == 4


def test_repeated_batch_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = spark.createDataFrame([(0, '{"a": 1}', 0), (1, "x", 0)], SCHEMA)
    for _ in range(2):
        I.write_batch(batch, 0, out, F.lit("t"))
    _, records, dead = state(spark, out)
    assert len(records) == 1 and dead == [1]


def test_latest_and_summary_over_several_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for b in range(3):
        write(spark, source, [(b * 10 + i, "v") for i in range(10)])
    V.keep_latest(stream(spark, source).select("offset"), str(tmp_path / "l"), [F.col("offset").desc()], 12)
    assert sorted(r["offset"] for r in V.newest(spark, str(tmp_path / "l")).collect()) == list(range(18, 30))
    counts = stream(spark, source).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    V.keep_summary(counts, str(tmp_path / "s"))
    assert [tuple(r) for r in V.newest(spark, str(tmp_path / "s")).collect()] == [("v", 30)]


def test_row_number_rules(spark):
    texts = ['{"_row_num": null}', '{"_row_num": 3.7}', '{"_row_num": "4"}', '{"_row_num": "3.7"}', '{"a": 1}', '{"_rows": null}', '{"_rows": 2.9}']
    messages = spark.createDataFrame([(t, 0, i) for i, t in enumerate(texts)], "value string, partition int, offset long")
    got = [(r["error"], r["row_num"], r["rows"]) for r in I.parse_envelopes(messages).orderBy("offset").collect()]
    assert got == [("invalid _row_num", 0, 0), (None, 3, 0), (None, 4, 0), ("invalid _row_num", 0, 0), (None, 0, 0), (None, 0, 0), (None, 0, 2)]


def test_last_message_of_a_file_wins(spark, tmp_path):
    env = {"_file_path": "a.csv", "_file_sha256": "s"}
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, source, [(0, {**env, "_rows": 9}), (1, {**env, "_rows": 3})])
    I.start_ingest(spark.readStream.schema(SCHEMA).parquet(source), out, F.lit("now")).awaitTermination()
    assert [r["rows"] for r in I.raw_files(spark, out).collect()] == [3]


def test_upserted_views_hold_the_last_row_of_a_key(spark, tmp_path):
    for rows in [[(1, 10.0), (2, 5.0), (None, 1.0)], [(1, 7.0), (3, 2.0)], [(None, 4.0)]]:
        spark.createDataFrame(rows, "k long, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k long, v double").parquet(f"{tmp_path}/in")
        changes = stream.groupBy("k").agg(F.sum("v").alias("v"))
        V.keep_upserted(changes, f"{tmp_path}/out", ["k"])
    got = {r["k"]: r["v"] for r in V.newest(spark, f"{tmp_path}/out").collect()}
    assert got == {1: 17.0, 2: 5.0, 3: 2.0, None: 5.0}
