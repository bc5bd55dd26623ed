"""Frequent and distinct values without moving texts, and labels with many nulls."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import features as E
from tidemark.operators import quality as Q


def brute(values, n):
    counts = Counter(v for v in values if v is not None)
    return [(v, k, i + 1) for i, (v, k) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:n])]


def test_top_values_with_ties_and_common_beginnings(spark):
    r = random.Random(3)
    long = "the same beginning of all of these texts, "
    rows = [(r.choice(["a", "b", "c", "", None]), long + str(r.randrange(3000)), f"v{i}é", None) for i in range(4000)]
    df = spark.createDataFrame(rows, "few string, `long` string, once string, none string").withColumn("number", F.lit(1))
    got = Q.top_values(df, 7).collect()
    for at, column in enumerate(["few", "long", "once", "none"]):
        mine = sorted((x["rank"], x["value"], x["n"]) for x in got if x["column"] == column)
        assert [(v, n, k) for k, v, n in mine] == brute([x[at] for x in rows], 7)
    assert Q.top_values(df.limit(0)).collect() == []


def exchanged_texts(df):
    """Exchanges that carry a whole text column, by what they output."""
    plan = df._jdf.queryExecution().executedPlan()
    stack, found = [plan], []
    while stack:
        p = stack.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            stack.append(p.executedPlan())
        if p.nodeName() == "Exchange":
            found.append([p.output().apply(i).name() for i in range(p.output().size())])
        stack.extend(p.children().apply(i) for i in range(p.children().size()))
    return found


def test_texts_are_not_shuffled_to_be_counted(spark):
    df = spark.createDataFrame([("x" * 1000, 1), ("y" * 1000, 2), (None, 3)], "text string, n int")
    profile = Q.table_profile(df)
    assert {x["column"]: x["distinct"] for x in profile.collect()} == {"text": 2, "n": 3}
    # the only values that travel are those of the number column, which were sliced before
    digests = [x for x in df.select(Q._digest(F.col("text")).alias("text")).dtypes]
    assert digests == [("text", "struct<a:bigint,b:bigint>")]
    for names in exchanged_texts(profile) + exchanged_texts(Q.top_values(df)):
        assert "text" not in names


def test_null_labels_take_no_part_in_the_join(spark):
    df = spark.range(2000).selectExpr("id", "if(id % 10 = 0, concat('l', id % 30), NULL) AS label", "if(id % 2 = 0, '', NULL) AS other")
    got = E.label_encode(df, ["label", "other"], null_code=-1)
    codes = {"l0": 0, "l10": 1, "l20": 2}
    for x, y in zip(sorted(got.collect()), sorted(df.collect()), strict=True):
        assert (x["label"], x["other"]) == (codes.get(y["label"], -1), -1 if y["other"] is None else 0)
