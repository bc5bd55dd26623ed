"""The exact columns of op11 against whole-number arithmetic, row by row."""

import math
import random

from tidemark.llm import whitening
from tidemark.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"


def exact(rows):
    x = {i: [math.floor(1024 * c) + 100_000 for c in v] for i, v in rows}
    n, sums = len(x), [sum(c) for c in zip(*x.values(), strict=True)]
    return {i: (n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for i, v in x.items()}


def test_deviation_of_op11_is_that_of_the_vector(spark, tmp_path):
    r = random.Random(3)
    good = [(i, [r.randrange(-900, 900) / 512 for _ in range(5)]) for i in range(30)] + [(30, [-4000.0, 3.0, 0.0, 1.0, 70000.0])]
    odd = [(40, None), (41, [1.0, None, 0.0, 0.0, 0.0]), (42, [float("nan")] * 5), (43, [float("-inf"), 0.0, 0.0, 0.0, 0.0])]
    spark.createDataFrame([(*row, 1) for row in good + odd], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op11_whitening"](spark, str(tmp_path)).collect()
    want = exact(good)
    assert {(x["vec_id"], x["n"], x["deviation"]) for x in got} == {(i, *v) for i, v in want.items()}
    assert len(got) == 5 * len(good) and all(x["deviation_digits"] == str(x["deviation"]) for x in got)


def test_row_deviations_beyond_a_long(spark):
    rows = [(1, [1e15, 2.0], 0), (2, [-1e15, 2.0], 0), (3, [0.0, 2.0], 0)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = {i: v for i, (_, v) in exact([r[:2] for r in rows]).items()}
    assert {r["vec_id"]: r["row_deviation_digits"] for r in got} == {i: str(v) for i, v in want.items()}
    assert {r["vec_id"]: r["row_deviation"] for r in got} == {i: v if v < 1 << 63 else None for i, v in want.items()}
