"""Exact global order statistics without a window over one task.

A running total over a whole table needs a global order. The distinct values
are range-partitioned; the partition number becomes a column (``slice``) of a
table that is written once to the shared folder, because a second evaluation
could draw other range borders. Totals per slice give each slice its starting
offset, and windows run inside a slice only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import saved


def in_slices(df: DataFrame, value: str, group: str) -> DataFrame:
    """``df`` (each (group, value) once) with ``slice``, ascending with the value per group."""
    ranged = df.repartitionByRange(group, value).withColumn("slice", F.spark_partition_id())
    return saved(ranged, "slices")


def slice_offsets(sliced: DataFrame, weight: str, group: str) -> DataFrame:
    """(group, slice, before, total): weight before the slice, and in the whole group."""
    order = Window.partitionBy(group).orderBy("slice")  # as long as there are partitions
    every = Window.partitionBy(group)
    sums = sliced.groupBy(group, "slice").agg(F.sum(weight).alias("_t"))
    return sums.select(
        group,
        "slice",
        F.coalesce(
            F.sum("_t").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
        F.col("_t").alias("inside"),
        F.sum("_t").over(every).alias("total"),
    )


def _running(sliced: DataFrame, offsets: DataFrame, value: str, weight: str, group: str, name: str) -> DataFrame:
    inside = Window.partitionBy(group, "slice").orderBy(value)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sliced.join(offsets, [group, "slice"]).withColumn(
        name, F.col("before") + F.sum(weight).over(inside)
    )


def running_total(df: DataFrame, value: str, weight: str, group: str, name: str = "running") -> DataFrame:
    """Add the running total of ``weight`` up to and with each value, per group.

    ``df`` holds each (group, value) once.
    """
    sliced = in_slices(df, value, group)
    offsets = slice_offsets(sliced, weight, group).select(group, "slice", "before")
    return _running(sliced, offsets, value, weight, group, name).drop("before", "slice")


def quantiles(sliced: DataFrame, value: str, count: str, group: str, shares: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    ``sliced`` is (group, value, count) from ``in_slices``. Only the slices that
    hold a wanted rank are ordered. Columns ``q0, q1, ...`` follow ``shares``.
    """
    offsets = slice_offsets(sliced, count, group)
    ranks = [F.lit(float(s)) * (F.col("total") - 1) for s in shares]
    ends = [r for rank in ranks for r in (F.floor(rank), F.ceil(rank))]
    first, last = F.col("before"), F.col("before") + F.col("inside")
    wanted = offsets.filter(F.exists(F.array(*ends), lambda r: (r >= first) & (r < last)))
    run = _running(sliced, wanted.drop("inside"), value, count, group, "_run")
    picks = [
        F.max(F.when((F.col("_run") > r) & (F.col("_run") - F.col(count) <= r), F.col(value))).alias(f"_e{i}")
        for i, r in enumerate(ends)
    ]
    found = run.groupBy(group).agg(F.max("total").alias("total"), *picks)
    out = [F.col(group)]
    for i, rank in enumerate(ranks):
        low, high = F.col(f"_e{2 * i}"), F.col(f"_e{2 * i + 1}")
        out.append((low + (high - low) * (rank - F.floor(rank))).alias(f"q{i}"))
    return found.select(*out)


def numbered(df: DataFrame, group: str, position: str, name: str = "row_num", width: int = 1 << 20) -> DataFrame:
    """1-based row number inside a group, in the order of a unique integer position.

    A group is cut into slices of ``width`` positions, so a slice never holds
    more than ``width`` rows however large the group is. Only slice counts are
    ordered over the whole group.
    """
    cut = F.floor(F.col(position) / width)
    counts = df.groupBy(group, cut.alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("_g"),
        F.col("_s").alias("_o_s"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"),
    )
    inside = Window.partitionBy(group, "_s").orderBy(position)
    local = df.withColumn("_s", cut).withColumn("_r", F.row_number().over(inside))
    joined = local.join(
        offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_o_s"))
    )
    return joined.withColumn(name, (F.col("_o") + F.col("_r")).cast("bigint")).drop(
        "_s", "_r", "_o", "_g", "_o_s"
    )
