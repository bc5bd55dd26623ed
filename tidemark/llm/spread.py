"""Running totals that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(df: DataFrame, by: list[str], bucket: str, amount: Column) -> DataFrame:
    """(by..., bucket, before, inside): sum of ``amount`` in earlier buckets, and in the bucket.

    The window runs over one row per bucket, not over rows.
    """
    sums = df.groupBy(*by, bucket).agg(F.sum(amount).alias("inside"))
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("inside").over(earlier), F.lit(0)))


def unit(*parts: Column) -> Column:
    """Number in (0, 1] that depends on the parts only, alike on every engine with MD5."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    digits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (digits + 1).cast("double") / F.lit(float(1 << 52))
