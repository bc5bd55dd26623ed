import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.operators import features as X
from tidemark.operators import models as ML
from tidemark.operators import quality as Q


def data(spark, n, flip=0):
    return spark.range(n).select(
        "id", (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"),
        F.pmod((F.col("id") % 10 > 4).cast("int") + flip, F.lit(2)).cast("double").alias("y"),
    )


def test_update_only_if_better(spark, tmp_path):
    est = ML.forest(["x"], ["c"], "y", trees=5, depth=4)
    good, bad = data(spark, 200), data(spark, 200, flip=1)
    model = est.fit(bad)
    better, changed, before, after = ML.update_if_better(model, est, good, good, "y")
    assert changed and after > before and better is not model
    same, changed, before, after = ML.update_if_better(better, est, bad, good, "y")
    assert not changed and same is better
    ML.save_version(model, str(tmp_path), 9)
    ML.save_version(better, str(tmp_path), 10)
    assert ML.newest_version(spark, str(tmp_path)) == 10
    assert ML.accuracy(ML.score(ML.load_newest(spark, str(tmp_path)), good, "y")) == 1.0


def test_update_archives_and_saves(spark, tmp_path):
    est = ML.forest(["x"], ["c"], "y", trees=5, depth=4)
    good, bad = data(spark, 200), data(spark, 200, flip=1)
    old = est.fit(bad)
    folder = str(tmp_path)
    ML.save_version(old, folder, 9)
    new, changed, before, after = ML.update_if_better(old, est, good, good, "y", folder)
    assert changed and ML.newest_version(spark, folder) == 10
    assert ML.accuracy(ML.score(ML.load_newest(spark, folder), good, "y")) == after
    assert ML.accuracy(ML.score(ML.load_newest(spark, f"{folder}/archive"), good, "y")) == before
    assert not ML.update_if_better(new, est, bad, good, "y", folder)[1] and ML.newest_version(spark, folder) == 10


def test_scores_of_folds(spark):
    est = ML.forest(["x"], [], "y", trees=5, depth=4)
    scores = ML.cross_validate(data(spark, 300), est, "y", ["id"], 3)
    assert scores.count() == 3 and ML.fold_summary(scores).first()["cv_mean"] == pytest.approx(1.0)


def test_unseen_label_is_an_error(spark):
    a = spark.createDataFrame([("x",), ("y",)], "c string")
    b = spark.createDataFrame([("z",)], "c string")
    codes = X.label_codes(a, ["c"])
    assert sorted(r["c"] for r in X.apply_codes(a, codes, ["c"]).collect()) == [0, 1]
    with pytest.raises(Exception, match="unseen label"):
        X.apply_codes(b, codes, ["c"]).collect()


def test_impute_ties_and_empty_columns(spark):
    df = spark.createDataFrame([("b", None, 1.0), ("a", None, None), (None, None, float("nan"))], "s string, e string, n double")
    got = [tuple(r) for r in X.impute(df).collect()]
    assert got == [("b", "Unknown", 1.0), ("a", "Unknown", 1.0), ("a", "Unknown", 1.0)]


def test_constant_column_scales(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["x"] for r in X.scale(df, ["x"]).collect()] == [0.0, 0.0]
    assert [r["x"] for r in X.scale(df, ["x"], sample=True).collect()] == [None, None]


def test_published_confusion_matrix(spark):
    """Accuracy, precision, recall and F1 of the published evaluation follow from its matrix."""
    cells = [(0, 0, 804), (0, 1, 6), (1, 0, 27), (1, 1, 163)]
    rows = [(t, p) for t, p, n in cells for _ in range(n)]
    m = E.classification_metrics(spark.createDataFrame(rows, "y_true int, y_pred int")).first()
    want = (0.967, 0.9669367483391366, 0.967, 0.9662459706782499)
    assert tuple(m) == pytest.approx(want, abs=1e-12)


def test_auc_of_one_class_is_zero(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y_true int, score double")
    assert E.roc_auc(df).first()["roc_auc"] == 0.0


def test_report_of_nulls_in_other_columns(spark):
    """Rows that differ only in which cell is null are not duplicates."""
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None)], "x string, y string")
    r = Q.quality_report(df).first()
    assert (r["total_rows"], r["null_x"], r["null_y"], r["duplicate_rows"]) == (3, 1, 2, 1)
    assert r["quality_score"] == pytest.approx(((1 - 3 / 6) + (1 - 1 / 3)) / 2)
