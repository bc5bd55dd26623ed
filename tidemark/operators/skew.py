"""Joins whose hot keys are split on both sides.

Spark splits a skewed partition of an outer join on its preserved side only, and only between map outputs;
a key that is hot on the other side stays in one task. Here the hot keys of all sides are found first, by a mergeable
summary of frequent items over the key columns. The rows of such a key are dealt into a grid: a left row goes to one
line of it and is repeated along that line, a right row goes to one column and is repeated down it, so each pair of
rows meets in exactly one cell. All other keys are joined plainly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import saved

#: a key with fewer rows is never split; and at most so many hot keys per side are looked for
LEAST_ROWS = 1_000_000
MOST_KEYS = 10_000


@dataclass(frozen=True)
class HotKeys:
    """Rows on each side of the keys that are hot on any side, by the hash of the key; ``cell`` is the rows a task takes."""

    rows: dict[int, tuple[int, ...]]
    cell: int


def partitions(spark: SparkSession) -> int:
    """Partitions a shuffle starts with."""
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(first or spark.conf.get("spark.sql.shuffle.partitions"))


def _hash(keys: list[str]) -> Column:
    # as text, so that sides whose keys differ in type agree
    return F.xxhash64(*(F.col(k).cast("string") for k in keys))


def hot_keys(sides: list[DataFrame], keys: list[str], least: int | None = None) -> HotKeys:
    """Keys that have more rows on a side than two tasks' fair share, and ``least`` at any rate.

    One pass over the key columns of each side. Summaries of frequent items are made by each task and merged; the
    driver gets at most MOST_KEYS hashes a side. A key that is not among them has so few rows that it needs no split: a
    summary that tracks 10 items for each task's share is wrong by less than such a share.
    """
    spark = sides[0].sparkSession
    parts = partitions(spark)
    most = min(max(parts, 64), MOST_KEYS)
    tracked = min(max(10 * most, 1_000), 1_000_000)
    seen = []
    for side in sides:
        hashed = side.select(_hash(keys).alias("_hot_h"))
        seen.append(hashed.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(_hot_h, {most}, {tracked})").alias("top")).first())
    cell = max(LEAST_ROWS if least is None else least, *(2 * r["n"] // parts for r in seen))
    counts = [{x["item"]: x["count"] for x in r["top"] or []} for r in seen]
    hot = {h for c in counts for h, n in c.items() if n > cell}
    return HotKeys({h: tuple(c.get(h, 1) for c in counts) for h in hot}, cell)


def _dealt(df: DataFrame, split: DataFrame, own: str, keys: list[str]) -> DataFrame:
    """The rows of hot keys, each with the line (or column) of the grid it is in.

    Stored, so that a row stays in its line when a lost task is run again. Rows are told apart by where they were
    read, since repeated rows have to be spread too.
    """
    number = F.xxhash64(F.monotonically_increasing_id())
    rows = df.withColumn("_hot_h", _hash(keys)).join(F.broadcast(split), "_hot_h")
    return saved(rows.withColumn(f"_hot_{own}", F.pmod(number, F.col(f"_hot_{own}s")).cast("int")).drop("_hot_h", f"_hot_{own}s"), f"hot-{own}s")


def left_join(left: DataFrame, right: DataFrame, keys: list[str], hot: HotKeys, sides: tuple[tuple[int, ...], int] = ((0,), 1)) -> DataFrame:
    """``left.join(right, keys, "left")`` with the keys in ``hot`` split over a grid.

    ``sides`` says which sides of ``hot`` the two are: the left may be a join of several, its rows per key being the
    product of theirs. What is broadcast has one row per hot key, at most MOST_KEYS a side.
    """
    if not hot.rows:
        return left.join(right, keys, "left")
    spark = left.sparkSession
    grid = []
    for h, counts in hot.rows.items():
        rows = 1
        for s in sides[0]:
            rows *= max(counts[s], 1)
        grid.append((h, max(1, -(-rows // hot.cell)), max(1, -(-counts[sides[1]] // hot.cell))))
    split = spark.createDataFrame(grid, "_hot_h long, _hot_lines int, _hot_columns int").coalesce(1)
    known = F.broadcast(split.select("_hot_h"))

    def cold(df: DataFrame) -> DataFrame:
        return df.withColumn("_hot_h", _hash(keys)).join(known, "_hot_h", "left_anti").drop("_hot_h")

    hot_left = _dealt(left, split, "line", keys)
    hot_right = _dealt(right, split, "column", keys)
    across = hot_left.withColumn("_hot_column", F.explode(F.sequence(F.lit(0), F.col("_hot_columns") - 1))).drop("_hot_columns")
    down = hot_right.withColumn("_hot_line", F.explode(F.sequence(F.lit(0), F.col("_hot_lines") - 1))).drop("_hot_lines")
    met = across.join(down, [*keys, "_hot_line", "_hot_column"]).drop("_hot_line", "_hot_column")
    # a hot key without any row on the right: as many keys as are hot at most
    there = F.broadcast(hot_right.select(*keys).distinct())
    alone = hot_left.drop("_hot_line", "_hot_columns").join(there, keys, "left_anti")
    plain = cold(left).join(cold(right), keys, "left")
    return plain.unionByName(met.select(*plain.columns)).unionByName(alone, allowMissingColumns=True)
