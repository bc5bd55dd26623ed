"""The metric history grows by a row per run; earlier rows stay as they were."""

from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.sinks import zones as Z


def test_history_over_two_runs(spark, tmp_path):
    path = str(tmp_path / "history")
    runs = [("2024-01-01", [(1, 1), (0, 0)], 1.0), ("2024-01-02", [(1, 1), (0, 1), (0, 0), (1, 1)], 0.75)]
    for when, pairs, _ in runs:
        scores = E.classification_metrics(spark.createDataFrame(pairs, "y_true int, y_pred int"))
        Z.metric_history(scores, "m", F.lit(when)).write.mode("append").parquet(path)
    got = spark.read.parquet(path).orderBy("timestamp").select("timestamp", "model_name", "accuracy").collect()
    assert [tuple(r) for r in got] == [(when, "m", accuracy) for when, _, accuracy in runs]
