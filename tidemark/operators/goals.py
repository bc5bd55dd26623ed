"""Goal analytics: risk, achievement, velocity and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import whole_days


def _done() -> Column:
    return F.col("status").eqNullSafe("completed")


def with_risk(goals: DataFrame, as_of: Column) -> DataFrame:
    """Days left and risk level of each goal; unknown dates are low risk."""
    left = F.col("days_remaining")
    return goals.withColumn(
        "days_remaining", whole_days(F.col("target_completion_date"), as_of)
    ).withColumn(
        "risk_level",
        F.when(_done(), "low").when(left < 30, "high").when(left < 60, "medium").otherwise("low"),
    )


def with_progress(key_results: DataFrame, as_of: Column) -> DataFrame:
    """Achievement rate, on-track and attention flags, days to the deadline."""
    target, current = F.col("target_value"), F.col("current_value")
    # a null current value over a positive target stays null, as the division does
    rate = F.when(target > 0, current / target * 100).otherwise(F.lit(0.0))
    return (
        key_results.withColumn("progress_percentage", F.coalesce("progress_percentage", F.lit(0.0)))
        .withColumn("achievement_rate", rate)
        .withColumn("is_on_track", F.col("progress_percentage") >= 70)
        .withColumn("needs_attention", (F.col("progress_percentage") < 50) & ~_done())
        .withColumn("days_to_deadline", whole_days(F.col("due_date"), as_of))
    )


def department_stats(goals: DataFrame) -> DataFrame:
    """Share of completed goals and goal count per department."""
    return (
        goals.filter(F.col("department").isNotNull())
        .groupBy("department")
        .agg(
            (100 * F.avg(_done().cast("int"))).alias("completion_rate"),
            F.count("objective_id").alias("total_objectives"),
        )
    )


def key_result_metrics(progressed: DataFrame) -> DataFrame:
    """One row of totals over the output of ``with_progress``."""
    return progressed.agg(
        F.avg("progress_percentage").alias("average_progress"),
        F.count(F.lit(1)).alias("total_key_results"),
        F.count_if("is_on_track").alias("on_track_count"),
        F.count_if("needs_attention").alias("needs_attention_count"),
        (100 * F.avg(_done().cast("int"))).alias("completion_rate"),
        F.greatest(F.max("target_value"), F.max("current_value")).alias("scale_max"),
    )


def key_result_split(progressed: DataFrame) -> DataFrame:
    """On track, needing attention, and the rest."""
    return progressed.agg(
        F.count_if("is_on_track").alias("on_track"),
        F.count_if("needs_attention").alias("needs_attention"),
        (F.count(F.lit(1)) - F.count_if("is_on_track") - F.count_if("needs_attention")).alias("normal"),
    )


def goal_overview(risked: DataFrame) -> DataFrame:
    """Goals, completed goals, their share in percent, goals at high risk."""
    total, done = F.count(F.lit(1)), F.count_if(_done())
    return risked.agg(
        total.alias("total_objectives"),
        done.alias("completed_objectives"),
        F.when(total > 0, done / total * 100).otherwise(F.lit(0.0)).alias("completion_rate"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk"),
    )


# Right-closed progress bins and their labels.
PROGRESS_BINS = [(0, 25, "0-25%"), (25, 50, "26-50%"), (50, 75, "51-75%"), (75, 100, "76-100%")]


def progress_bins(key_results: DataFrame) -> DataFrame:
    """Key results per progress bin; empty bins stay, 0 and above 100 belong to none."""
    value = F.col("progress_percentage")
    # one row of four counters, turned into four rows: an empty bin needs no join
    counters = [
        F.count_if((value > low) & (value <= high)).alias(label)
        for low, high, label in PROGRESS_BINS
    ]
    labels = [label for _, _, label in PROGRESS_BINS]
    return key_results.agg(*counters).unpivot([], labels, "bin", "n")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long table (dimension, value, n) of the non-null values of some columns."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "dimension", "value"
    )
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def equal_width_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts in equal-width bins from the smallest to the largest value.

    The last bin is closed on the right. Rows without a finite value are left out.
    """
    value = F.col(column).cast("double")
    finite = df.select(value.alias("v")).filter(
        F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    )
    span = finite.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    step = (span["hi"] - span["lo"]) / bins
    number = F.when(step > 0, F.least(F.floor((F.col("v") - span["lo"]) / step), F.lit(bins - 1)))
    return (
        finite.select(F.coalesce(number, F.lit(0)).cast("bigint").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ordered_slices(updates: DataFrame) -> DataFrame:
    """The updates with ``_slice``, which rises in the order of (key, date with null last, id).

    The borders come from a sample of the rows and may lie anywhere in that order, so a key, a minute of
    it or its rows without date are cut like any other rows if they are many.
    """
    rows = updates.select(
        "key_result_id",
        "update_id",
        "update_date",
        F.col("progress_percentage").cast("double").alias("p"),
    )
    order = [F.col("key_result_id"), F.col("update_date").asc_nulls_last(), F.col("update_id"), F.col("p")]
    return rows.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())


def velocity_parts(updates: DataFrame) -> DataFrame:
    """Per key: update count, last update, and sums of the update-to-update speeds.

    Rows of a key are ordered inside one slice of ``ordered_slices``; only the first and last row of
    each (key, slice) are ordered over the whole key, and a key has no more slices than there are
    partitions. Summaries of neighbouring slices merge into that of both.
    """
    inside = Window.partitionBy("key_result_id", "_slice").orderBy(
        F.col("update_date").asc_nulls_last(), F.col("update_id"), F.col("p")
    )
    rows = ordered_slices(updates)
    inner = rows.select(
        "key_result_id",
        "_slice",
        "update_date",
        "p",
        F.row_number().over(inside).alias("_first"),
        F.lead(F.lit(1)).over(inside).isNull().alias("_last"),
        _speed(
            F.col("p") - F.lag("p").over(inside),
            whole_days(F.col("update_date"), F.lag("update_date").over(inside)),
        ).alias("_v"),
    ).withColumn("_v", F.when(F.col("_first") > 1, F.col("_v")))
    first, last = F.col("_first") == 1, F.col("_last")
    slices = inner.groupBy("key_result_id", "_slice").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("update_date").alias("last_update"),
        *_speed_sums("_v"),
        F.max(F.when(first, F.col("p"))).alias("p0"),
        F.max(F.when(first, F.col("update_date"))).alias("t0"),
        F.max(F.when(last, F.col("p"))).alias("p1"),
        F.max(F.when(last, F.col("update_date"))).alias("t1"),
    )
    key = Window.partitionBy("key_result_id").orderBy("_slice")
    stitched = slices.withColumn(
        "_v",
        _speed(
            F.col("p0") - F.lag("p1").over(key),
            whole_days(F.col("t0"), F.lag("t1").over(key)),
        ),
    )
    return stitched.groupBy("key_result_id").agg(
        F.sum("n").alias("n"),
        F.max("last_update").alias("last_update"),
        *[
            (F.sum(name) + F.sum(part)).alias(name)
            for name, part in zip(("up", "down", "total", "finite"), _speed_terms("_v"))
        ],
    )


def _speed(change: Column, days: Column) -> Column:
    """Change per day; no earlier row counts as no change over one day.

    Zero days give plus or minus infinity, and null where nothing changed.
    """
    change = F.coalesce(change, F.lit(0.0))
    days = F.coalesce(days, F.lit(1))
    return (
        F.when(days != 0, F.try_divide(change, days))
        .when(change > 0, F.lit(float("inf")))
        .when(change < 0, F.lit(float("-inf")))
    )


def _speed_terms(name: str) -> list[Column]:
    v = F.col(name)
    up, down = v == float("inf"), v == float("-inf")
    finite = v.isNotNull() & ~up & ~down
    return [
        F.when(up, 1).otherwise(0),
        F.when(down, 1).otherwise(0),
        F.when(finite, v).otherwise(F.lit(0.0)),
        F.when(finite, 1).otherwise(0),
    ]


def _speed_sums(name: str) -> list[Column]:
    return [
        F.sum(term).alias(out)
        for term, out in zip(_speed_terms(name), ("up", "down", "total", "finite"))
    ]


def _direction() -> Column:
    up, down = F.col("up"), F.col("down")
    return (
        F.when((up > 0) & (down > 0), "stable")
        .when(up > 0, "positive")
        .when(down > 0, "negative")
        .when(F.col("total") > 0, "positive")
        .when(F.col("total") < 0, "negative")
        .otherwise("stable")
    )


def trends_of(parts: DataFrame) -> DataFrame:
    """``key_result_trends`` from the parts of each key."""
    return parts.filter(F.col("key_result_id").isNotNull() & (F.col("n") > 1)).select(
        "key_result_id",
        F.when((F.col("up") + F.col("down")) == 0, F.try_divide("total", "finite")).alias("velocity"),
        _direction().alias("trend_direction"),
        "last_update",
        F.col("n").alias("update_frequency"),
    )


def key_result_trends(updates: DataFrame) -> DataFrame:
    """Velocity, direction, last update and update count of keys updated twice or more.

    The velocity is null where it is not finite; the direction stays.
    """
    return trends_of(velocity_parts(updates))


def trend_counts(trends: DataFrame) -> DataFrame:
    return trends.groupBy("trend_direction").agg(F.count(F.lit(1)).alias("n"))


def insights_of(parts: DataFrame) -> DataFrame:
    """``overall_insights`` from the parts of each key."""
    known = F.col("key_result_id").isNotNull()
    trend = F.when(known & (F.col("n") > 1), _direction())
    return parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_updates_processed"),
        F.count(F.lit(1)).alias("active_key_results"),
        F.avg(F.when(known, F.col("n"))).alias("avg_update_frequency"),
        F.count_if(trend == "positive").alias("positive_trends"),
        F.count_if(trend == "negative").alias("negative_trends"),
    )


def overall_insights(updates: DataFrame) -> DataFrame:
    """Updates, distinct keys (null is one), mean updates per known key, trend signs."""
    return insights_of(velocity_parts(updates))
