import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.ordered import in_slices, numbered, quantiles, running_total


def frequencies(spark, groups):
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_match_numpy(spark, seed):
    rng = random.Random(seed)
    groups = {
        "spread": [rng.random() for _ in range(997)],
        "hot": [5.0] * 900 + [rng.gauss(5, 2) for _ in range(300)],
        "single": [1.0],
        "two": [1.0, 2.0],
    }
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in quantiles(in_slices(frequencies(spark, groups), "v", "g"), "v", "n", "g", shares).collect()}
    for g, values in groups.items():
        assert [got[g][f"q{i}"] for i in range(len(shares))] == pytest.approx(list(np.quantile(values, shares)))


def test_running_total(spark):
    values = random.Random(1).sample(range(100000), 3000)
    df = spark.createDataFrame([("a", v, 1 + v % 3) for v in values], "g string, v int, w int")
    got = {r["v"]: r["running"] for r in running_total(df, "v", "w", "g").collect()}
    total = 0
    for v in sorted(values):
        total += 1 + v % 3
        assert got[v] == total


def test_numbered_over_small_slices(spark):
    rows = [("hot" if i % 3 else f"s{i % 7}", i * 5) for i in range(2000)]
    df = spark.createDataFrame(rows + [(None, 3), (None, 1)], "g string, p bigint")
    got = {(r["g"], r["p"]): r["n"] for r in numbered(df, "g", "p", "n", width=64).collect()}
    seen = {}
    for g, p in sorted(rows + [(None, 1), (None, 3)], key=lambda r: r[1]):
        seen[g] = seen.get(g, 0) + 1
        assert got[(g, p)] == seen[g]
