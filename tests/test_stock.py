from pyspark.sql import functions as F

from tidemark.operators import stock as S

REQ = "id string, tool_id string, requested_quantity double"
APP = "id string, tool_id string, approved_date string, is_approved int, is_requester_received int, is_returned int, returned_quantity double"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_null_keys_match_and_repeats_fan_out(spark):
    req = spark.createDataFrame([("1", "a", 2.0), (None, "a", 3.0), ("2", "a", 1.0)], REQ)
    app = spark.createDataFrame(
        [("1", "a", "d", 1, 1, 0, 0.0), ("1", "a", "d", 0, 0, 0, 0.0), (None, "a", "d", 1, 1, 0, 0.0)], APP
    )
    joined = S.with_approvals(req, app)
    assert joined.count() == 4
    assert rows(S.fulfilled(joined).select("id", "requested_quantity")) == [("1", 2.0), ("nan", 3.0)]


def test_summed_join_equals_row_join(spark):
    req = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("id"),
        (F.col("id") % 2).cast("string").alias("tool_id"), (F.col("id") % 9).cast("double").alias("requested_quantity"),
    )
    app = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 70).cast("string")).alias("id"),
        (F.col("id") % 2).cast("string").alias("tool_id"), F.lit("d").alias("approved_date"),
        (F.col("id") % 4).cast("int").alias("is_approved"), (F.col("id") % 2).cast("int").alias("is_requester_received"),
        (F.col("id") % 2).cast("int").alias("is_returned"), F.lit(1.0).alias("returned_quantity"),
    )
    joined = S.with_approvals(req, app)
    cols = ["tool_id", "id", "requested_quantity"]
    assert rows(S.fulfilled(joined).select(cols)) == rows(S.fulfilled_from(req, app).select(cols))
    direct = joined.groupBy("is_approved", "is_requester_received").agg(F.count(F.lit(1)).alias("n"))
    assert rows(direct) == rows(S.approval_counts(req, app))


def test_without_approvals_stock_is_quantity(spark):
    items = spark.createDataFrame([("1", 5)], "id string, quantity int")
    assert rows(S.current_stock(items, None, None)) == [("1", 5, 5)]
    req = spark.createDataFrame([("1", "a", 2.0)], REQ)
    assert S.with_approvals(req, None).first()["approved_date"] is None


def test_stock_pairs_and_one_row_per_item(spark):
    items = spark.createDataFrame([("1", 10), ("9", 4)], "id string, quantity int")
    sums = spark.createDataFrame([("1", "1", 2.0), ("x", "1", 3.0)], "tool_id string, id string, requested_quantity double")
    back = spark.createDataFrame([("1", "1", 1.0), ("y", "1", 4.0)], "tool_id string, id string, returned_quantity double")
    pairs = rows(S.current_stock(items, sums, back).select("id", "current_stock"))
    assert pairs == [("1", 11.0), ("1", 12.0), ("1", 8.0), ("1", 9.0), ("9", 4.0)]
    assert rows(S.current_stock_by_item(items, sums, back).select("id", "current_stock")) == [("1", 9.0), ("9", 4.0)]


def test_missing_columns_and_printed_null_ids(spark):
    df = spark.createDataFrame([(None, 7)], "id string, tool_id int")
    r = S.requested_tools(df).first()
    assert r["id"] == "None" and r["tool_id"] == "7" and r["uom_name"] == ""


def test_union_dedup_is_idempotent(spark):
    a = spark.createDataFrame([("1", None), ("1", None), ("2", 3)], "id string, q int")
    once = S.union_sources({"tools": a, "inventory": a}).dropDuplicates()
    assert rows(once) == rows(once.dropDuplicates()) and once.count() == 4


def test_bad_dates_are_left_out(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-01T10:00:00",), ("soon",), (None,)], "requested_date string")
    assert [(str(r["day"]), r["n"]) for r in S.daily_requests(df).collect()] == [("2024-01-01", 2)]
