"""Impute, code and scale for several training sets that share one scan of the rows.

Rows carry a ``fold``. Training set k is all rows but those of fold k; with one fold it is all rows.
Numbers are condensed to count, mean and squared deviation per fold, and the folds of a set are
merged. Texts are counted per value and fold into a dictionary, a stored table that holds the code
of each value in every set; neither the driver nor a model holds values. The moments of coded
columns follow from the dictionary, exactly, without another look at the rows.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from fractions import Fraction
from math import sqrt

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.features import code_join, known
from tidemark.operators.ordered import in_slices
from tidemark.session import saved


@dataclass(frozen=True)
class Scaling:
    """What a training set says of a column: ``fill`` stands for missing numbers or is the code of
    nulls and of texts that are not in the set; mean and sample std are those of the filled column."""

    fill: float
    mean: float
    std: float


@dataclass(frozen=True)
class Preparation:
    numbers: list[str]
    categories: list[str]
    sets: list[dict[str, Scaling]]
    codes: DataFrame  # column, value, counts and codes by training set; a code is null where the set lacks the value

    def coded(self, df: DataFrame) -> DataFrame:
        """``df`` with the codes of each category in all sets, ``_codes0``, ``_codes1`` and so on."""
        out = df
        for i, c in enumerate(self.categories):
            out = code_join(out, self.codes, c, F.col("codes"), f"_codes{i}")
        return out

    def features(self, coded: DataFrame, k: int = 0, name: str = "_features") -> DataFrame:
        """Rows of ``coded`` with the vector of filled and scaled columns of training set k."""
        stats = self.sets[k]

        def scaled(value: Column, s: Scaling) -> Column:
            # a constant column says nothing: 0, as the usual scalers have it
            return (F.coalesce(value, F.lit(s.fill)) - s.mean) / s.std if s.std > 0 else F.lit(0.0)

        parts = [scaled(known(c), stats[c]) for c in self.numbers]
        parts += [scaled(F.col(f"_codes{i}")[k].cast("double"), stats[c]) for i, c in enumerate(self.categories)]
        return coded.withColumn(name, array_to_vector(F.array(*parts)))

    def statistics(self, spark: SparkSession) -> DataFrame:
        """(fold, feature, fill, mean, std); ``fold`` is the one left out."""
        rows = [(k, c, s.fill, s.mean, s.std) for k, stats in enumerate(self.sets) for c, s in stats.items()]
        return spark.createDataFrame(rows, "fold int, feature string, fill double, mean double, std double")

    def save(self, path: str) -> None:
        spark = self.codes.sparkSession
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        sets = [{c: asdict(s) for c, s in stats.items()} for stats in self.sets]
        text = json.dumps({"numbers": self.numbers, "categories": self.categories, "sets": sets})
        spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{path}/statistics")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Preparation:
        read = json.loads(spark.read.text(f"{path}/statistics").first()["value"])
        sets = [{c: Scaling(**s) for c, s in stats.items()} for stats in read["sets"]]
        return Preparation(read["numbers"], read["categories"], sets, spark.read.parquet(f"{path}/codes"))


def _training(folds: int, k: int) -> list[int]:
    return [f for f in range(folds) if f != k or folds == 1]


def dictionary(df: DataFrame, categories: list[str], folds: int = 1) -> DataFrame:
    """(column, value, counts, codes) of the non-null texts, stored.

    ``counts`` and ``codes`` have an entry for each training set: the rows that have the value and its
    0-based rank, by code points, among the values of the set. Values are ordered inside sampled
    ranges; only what a range holds is added up over a whole column.
    """
    sets = range(folds)
    long = df.select("fold", *categories).unpivot(["fold"], categories, "column", "value").filter(F.col("value").isNotNull())

    def count(k: int) -> Column:
        return F.count(F.when(F.col("fold").isin(_training(folds, k)), 1)).alias(f"n{k}")

    def seen(k: int) -> Column:
        return (F.col(f"n{k}") > 0).cast("bigint")

    sliced = in_slices(long.groupBy("column", "value").agg(*map(count, sets)), "value", "column")
    sums = sliced.groupBy("column", "slice").agg(*(F.sum(seen(k)).alias(f"s{k}") for k in sets))
    earlier = Window.partitionBy("column").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        "column", "slice", *(F.coalesce(F.sum(f"s{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in sets)
    )
    inside = Window.partitionBy("column", "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    codes = [F.when(seen(k) > 0, F.col(f"b{k}") + F.sum(seen(k)).over(inside) - 1) for k in sets]
    ranked = sliced.join(before, ["column", "slice"]).select(
        "column", "value", F.array(*(F.col(f"n{k}") for k in sets)).alias("counts"), F.array(*codes).alias("codes")
    )
    return saved(ranked, "codes")


def _merged(parts: list[tuple[int, float, float]]) -> tuple[int, float, float]:
    """Count, mean and squared deviation of rows from those of their parts."""
    n, mean, squares = 0, 0.0, 0.0
    for m, other, more in parts:
        if m:
            gap = other - mean
            squares += more + gap * gap * n * m / (n + m)
            n, mean = n + m, mean + gap * m / (n + m)
    return n, mean, squares


def _of_number(rows: list[Row], c: str, total: int) -> Scaling:
    n, mean, squares = _merged([(r[f"n_{c}"], r[f"m_{c}"], (r[f"v_{c}"] or 0.0) * r[f"n_{c}"]) for r in rows])
    return Scaling(mean, mean, sqrt(squares / (total - 1)) if n and total > 1 else 0.0)


def _of_codes(row: Row | None, k: int, total: int) -> Scaling:
    """Exact, from whole numbers. Nulls have the code after the last one."""
    values, n, first, second = (int(row[f"{x}{k}"] or 0) for x in "unab") if row else (0, 0, 0, 0)
    first += (total - n) * values
    second += (total - n) * values * values
    mean = Fraction(first, total) if total else Fraction(0)
    deviation = Fraction(total * second - first * first, total * (total - 1)) if total > 1 else Fraction(0)
    return Scaling(float(values), float(mean), sqrt(deviation))


def fit(df: DataFrame, numbers: list[str], categories: list[str], folds: int = 1) -> Preparation:
    """Statistics of all training sets of ``df``, a stored table with a ``fold`` from 0 to ``folds - 1``.

    One aggregation reads the numbers and one the texts, however many folds there are. The driver gets
    a row per fold and one per category. Null and NaN are missing numbers; a column without any number
    is filled with 0. Without rows all statistics are 0.
    """
    moments = [F.count(F.lit(1)).alias("rows")]
    for c in numbers:
        moments += [F.count(known(c)).alias(f"n_{c}"), F.avg(known(c)).alias(f"m_{c}"), F.var_pop(known(c)).alias(f"v_{c}")]
    by_fold = {r["fold"]: r for r in df.groupBy("fold").agg(*moments).collect()}

    codes = dictionary(df, categories, folds) if categories else df.sparkSession.createDataFrame(
        [], "column string, value string, counts array<bigint>, codes array<bigint>"
    )
    sums = []
    for k in range(folds):
        n, code = F.col("counts")[k].cast("decimal(13,0)"), F.col("codes")[k].cast("decimal(12,0)")
        sums += [F.count(code).alias(f"u{k}"), F.sum(n).alias(f"n{k}"), F.sum(n * code).alias(f"a{k}"), F.sum(n * code * code).alias(f"b{k}")]
    by_column = {r["column"]: r for r in codes.groupBy("column").agg(*sums).collect()} if categories else {}

    sets = []
    for k in range(folds):
        rows = [by_fold[f] for f in _training(folds, k) if f in by_fold]
        total = sum(r["rows"] for r in rows)
        sets.append(
            {c: _of_number(rows, c, total) for c in numbers} | {c: _of_codes(by_column.get(c), k, total) for c in categories}
        )
    return Preparation(list(numbers), list(categories), sets, codes)
