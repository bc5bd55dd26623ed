"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the input and the cores.
"""

from __future__ import annotations

import json
import os
import time

from tidemark.catalog.load import QUERIES
from tidemark.session import build_session

HEADLINES = [
    "department_stats", "objective_risk", "key_result_progress", "key_result_metrics", "goal_counts",
    "histogram_20", "key_result_trends", "overall_insights", "requests_with_approvals",
    "fulfilled_requests", "current_stock", "current_stock_by_item", "request_kpis", "inventory_kpis",
    "daily_requests", "flatten_inventory", "endpoint_flatten", "plan_flatten_outer", "plan_counts",
    "csv_scan", "json_envelope_scan", "topic_snapshot", "upsert_latest", "row_numbers",
    "validate_goals", "goal_documents", "processed_zone", "chunk_words", "chunk_sentences",
    "curated_chunks", "row_fingerprint", "quality_report", "table_profile", "top_values", "impute",
    "label_encode", "scale_pop", "classification_metrics", "roc_auc", "drift_numeric",
    "drift_categorical", "train_forest", "stream_ingest", "stream_kpis", "stream_latest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": cores,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    # a fixed job of Spark alone, to tell the machine from the code
    start = time.perf_counter()
    rows = spark.range(20_000_000).selectExpr("id % 100003 AS k", "hash(id) AS v")
    rows.groupBy("k").sum("v").write.format("noop").mode("overwrite").save()
    control = round(time.perf_counter() - start, 3)
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "control": control,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
