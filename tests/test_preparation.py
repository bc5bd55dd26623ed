"""Statistics of training sets against fits of the usual stages, dictionaries of many values."""

import pytest
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from tidemark.operators import models as ML
from tidemark.operators import preparation as P
from tidemark.operators.features import with_fold


def rows(spark, n=400):
    i = F.col("id")
    return spark.range(n).select(
        "id",
        F.when(i % 7 == 0, None).when(i % 11 == 0, float("nan")).otherwise((i * 37 % 101) / 3.0 + 1e6).alias("x"),
        F.when(i % 5 != 0, F.concat(F.lit("v"), F.floor(F.sqrt(i)).cast("string"))).alias("c"),
        F.lit("same").alias("d"),
        (i * 37 % 101 > 50).cast("double").alias("y"),
    )


def test_equal_to_fits_of_each_fold(spark):
    est = ML.forest(["x"], ["c", "d"], "y")
    folded = ML.fold_rows(rows(spark), est, ["id"], 4)
    made = P.fit(folded, est.numbers, est.categories, 4)
    coded = made.coded(folded).cache()
    for k in range(4):
        train = folded.filter(F.col("fold") != k)
        index = StringIndexer(inputCols=["c", "d"], outputCols=["cc", "dc"], stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
        fill = Imputer(inputCols=["x"], outputCols=["xx"]).fit(train)
        whole = VectorAssembler(inputCols=["xx", "cc", "dc"], outputCol="raw")
        ready = whole.transform(fill.transform(index.transform(train)))
        scaler = StandardScaler(inputCol="raw", outputCol="want", withMean=True, withStd=True).fit(ready)
        stats = made.sets[k]
        assert stats["x"].fill == pytest.approx(fill.surrogateDF.first()["x"], rel=1e-12)
        assert [stats[c].fill for c in ("c", "d")] == [len(x) for x in index.labelsArray]
        assert [stats[c].mean for c in ("x", "c", "d")] == pytest.approx(list(scaler.mean), rel=1e-12)
        assert [stats[c].std for c in ("x", "c", "d")] == pytest.approx(list(scaler.std), rel=1e-8)
        # training rows and rows left out, whose texts may be new
        both = scaler.transform(whole.transform(fill.transform(index.transform(made.features(coded, k, "got")))))
        for r in both.select("got", "want").collect():
            assert list(r["got"]) == pytest.approx(list(r["want"]), rel=1e-6, abs=1e-6)


def test_one_read_for_all_folds(spark):
    """The rows are evaluated once, however many folds there are."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = rows(spark, 300)
    scores = ML.cross_validate(df.mapInArrow(count, df.schema), ML.forest(["x"], ["c"], "y", 3, 3), "y", ["id"], 5)
    assert scores.count() == 5 and seen.value == 300
    seen.value = 0
    ML.forest(["x"], ["c"], "y", 3, 3).fit(df.mapInArrow(count, df.schema))
    assert seen.value == 300


def test_scores_equal_single_fits(spark):
    """A fold's accuracy is that of a forest fitted on the other folds alone."""
    est = ML.forest(["x"], ["c"], "y", 10, 6)
    df = with_fold(rows(spark), ["id"], 3)
    got = {r["fold"]: r["accuracy"] for r in ML.cross_validate(df.drop("fold"), est, "y", ["id"], 3).collect()}
    for k in range(3):
        model = est.fit(df.filter(F.col("fold") != k).drop("fold"))
        alone = ML.accuracy(ML.score(model, df.filter(F.col("fold") == k).drop("fold"), "y"))
        assert got[k] == pytest.approx(alone, abs=0.08)  # the trees draw rows by partition


def test_a_million_values(spark, tmp_path):
    """Codes are a table: a model of a million values is fitted, saved, loaded and scores."""
    i = F.col("id")
    df = spark.range(1_000_000).select(F.format_string("%07d", i).alias("c"), (i >= 500_000).cast("double").alias("y"))
    model = ML.forest([], ["c"], "y", 2, 3).fit(df)
    stats = model.preparation.sets[0]["c"]
    assert (stats.fill, stats.mean) == (1_000_000, 499_999.5)
    ML.save_version(model, str(tmp_path), 3)
    read = ML.load_newest(spark, str(tmp_path))
    assert ML.accuracy(ML.score(read, df, "y")) > 0.95
    new = spark.createDataFrame([(None,), ("new",)], "c string")
    assert [r["y_pred"] for r in ML.score(read, new).collect()] == [1, 1]  # the code after the last


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "fold int, x double, c string")
    made = P.fit(empty, ["x"], ["c"], 2)
    assert made.sets[0] == {"x": P.Scaling(0.0, 0.0, 0.0), "c": P.Scaling(0.0, 0.0, 0.0)}
    assert made.features(made.coded(empty), 1).count() == 0
    lone = spark.createDataFrame([(0, None, None), (1, None, None)], "fold int, x double, c string")
    made = P.fit(lone, ["x"], ["c"], 2)
    assert [list(r["_features"]) for r in made.features(made.coded(lone)).collect()] == [[0.0, 0.0]] * 2
    with pytest.raises(ValueError, match="fold"):
        ML.fold_rows(lone, ML.forest(["fold"], [], "x"), ["c"], 2)


def test_hot_and_repeated_texts(spark):
    """A text of nine tenths of the rows and one that a fold alone has."""
    data = [(f, "hot", 1.0) for f in (0, 1, 2) for _ in range(30)] + [(1, "only", 2.0), (2, "é", 3.0), (0, "A", 4.0)]
    df = spark.createDataFrame(data, "fold int, c string, x double")
    words = {r["value"]: (list(r["counts"]), list(r["codes"])) for r in P.dictionary(df, ["c"], 3).collect()}
    assert words == {
        "A": ([0, 1, 1], [None, 0, 0]), "hot": ([60, 60, 60], [0, 1, 1]), "only": ([1, 0, 1], [1, None, 2]), "é": ([1, 1, 0], [2, 2, None])
    }
