"""Data quality checks, profiles and stage reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import in_slices, quantiles
from tidemark.session import saved


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def frame_check(df: DataFrame, required: list[str] = ()) -> DataFrame:
    """One row: rows, missing columns, infinite and null cells, and the verdict."""
    missing = missing_columns(df, list(required))
    fractions = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    infinite = reduce(
        lambda a, b: a + b, [F.count_if(F.abs(F.col(c)) == float("inf")) for c in fractions], F.lit(0)
    )
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns], F.lit(0))
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("rows"),
        F.lit(", ".join(missing)).alias("missing_columns"),
        infinite.cast("bigint").alias("infinite_values"),
        nulls.cast("bigint").alias("null_values"),
        ((rows > 0) & F.lit(not missing)).alias("valid"),
    )


def row_digest(df: DataFrame) -> list[Column]:
    """128-bit hash of a whole row with its nulls; stands in for a wide row in a shuffle."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        # a hash passes over nulls, so each cell says whether it is one
        cells += [c, c.isNull()]
    return [F.xxhash64(*cells).alias("_h1"), F.xxhash64(F.lit("second"), *cells).alias("_h2")]


def quality_report(df: DataFrame) -> DataFrame:
    """One row: rows, columns, nulls per column, duplicate rows, score.

    What is shuffled of a row is its hash and one bit per column that says where
    it is null, however long its texts are; equal rows are combined before.
    """
    per_word = 60
    words = [df.columns[i : i + per_word] for i in range(0, len(df.columns), per_word)]
    masks = [
        reduce(
            lambda a, b: a + b,
            [F.when(F.col(f"`{c}`").isNull(), F.lit(1 << i)).otherwise(0).cast("bigint") for i, c in enumerate(part)],
        ).alias(f"_m{w}")
        for w, part in enumerate(words)
    ]
    names = [f"_m{w}" for w in range(len(words))]
    distinct = (
        df.select(*row_digest(df), *masks)
        .groupBy("_h1", "_h2", *names)
        .agg(F.count(F.lit(1)).alias("_n"))
    )

    def nulls_of(w: int, i: int) -> Column:
        bit = F.getbit(F.col(f"_m{w}"), F.lit(i)).cast("bigint")
        return F.coalesce(F.sum(bit * F.col("_n")), F.lit(0))

    counted = distinct.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("_distinct"),
        *[nulls_of(w, i).alias(f"null_{c}") for w, part in enumerate(words) for i, c in enumerate(part)],
    )
    nulls = reduce(lambda a, b: a + b, [F.col(f"null_{c}") for c in df.columns])
    duplicates = F.col("total_rows") - F.col("_distinct")
    width = len(df.columns)
    complete = 1 - F.try_divide(nulls, F.col("total_rows") * width)
    unique = 1 - F.try_divide(duplicates, "total_rows")
    return counted.select(
        "total_rows",
        F.lit(width).cast("bigint").alias("total_columns"),
        *[f"null_{c}" for c in df.columns],
        duplicates.alias("duplicate_rows"),
        ((complete + unique) / 2).alias("quality_score"),
    )


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of the non-null values of columns of one type."""
    return (
        df.select(*columns)
        .unpivot([], columns, "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


#: digests whose texts are fetched by broadcast; and characters by which ties are cut before that
FETCHED, LEADING = 100_000, 32


def _digest(c: Column) -> Column:
    """128-bit hash of a value, null for null; stands in for a long text in a shuffle."""
    return F.when(c.isNotNull(), F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit("second"), c).alias("b")))


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, count, nulls, distinct values; numbers also mean to max.

    Moments come from one pass without a shuffle of rows. Distinct values and the
    exact, interpolated quartiles come from the value frequencies, which are
    combined before their shuffle; texts are counted as digests.
    """
    numbers = _numeric(df)
    others = [c for c in df.columns if c not in numbers]
    nothing = F.lit(None).cast("double")

    def moments(c: str) -> Column:
        v = F.col(f"`{c}`").cast("double")
        v = F.when(~F.isnan(v), v)
        number = c in numbers
        return F.struct(
            F.lit(c).alias("column"),
            F.count(v if number else F.col(f"`{c}`")).alias("count"),
            (F.avg(v) if number else nothing).alias("mean"),
            (F.stddev_samp(v) if number else nothing).alias("std"),
            (F.min(v) if number else nothing).alias("min"),
            (F.max(v) if number else nothing).alias("max"),
            F.count(F.lit(1)).alias("_rows"),
        )

    table = df.agg(F.array(*[moments(c) for c in df.columns]).alias("m")).select(F.inline("m"))
    distinct = []
    if numbers:
        doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in numbers])
        freq = value_frequencies(doubles, numbers).filter(~F.isnan("value"))
        sliced = in_slices(freq, "value", "column")
        distinct.append(sliced.groupBy("column").agg(F.count(F.lit(1)).alias("distinct")))
        table = table.join(quantiles(sliced, "value", "n", "column", [0.25, 0.5, 0.75]), "column", "left")
    if others:
        texts = df.select(*[_digest(F.col(f"`{c}`").cast("string")).alias(c) for c in others])
        freq = value_frequencies(texts, others)
        distinct.append(freq.groupBy("column").agg(F.count(F.lit(1)).alias("distinct")))
    found = reduce(lambda a, b: a.unionByName(b), distinct)
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    quarters = ["q0", "q1", "q2"] if numbers else [nothing] * 3
    return table.join(found, "column", "left").select(
        "column",
        kinds[F.col("column")].alias("type"),
        "count",
        (F.col("_rows") - F.col("count")).alias("nulls"),
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        "mean",
        "std",
        "min",
        *[F.col(q).alias(n) if isinstance(q, str) else q.alias(n) for q, n in zip(quarters, ("p25", "p50", "p75"))],
        "max",
    )


def top_values(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values of each text column; the value breaks ties.

    Digests are counted, with the first characters of their text. Those alone decide which digests can be among the
    first ``n``; only the texts of these are fetched, in a second pass.
    """
    columns = _texts(df)
    head = F.struct("column", F.col("value.d").alias("d"), F.col("value.head").alias("head"))
    marked = df.select(
        *[
            F.when(F.col(f"`{c}`").isNotNull(), F.struct(_digest(F.col(f"`{c}`")).alias("d"), F.substring(f"`{c}`", 1, LEADING).alias("head"))).alias(c)
            for c in columns
        ]
    )
    counts = (
        marked.unpivot([], columns, "column", "value")
        .filter(F.col("value").isNotNull())
        .select(head.alias("k"))
        .groupBy("k")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("k.*", "n")
    )
    first = Window.partitionBy("column").orderBy(F.col("n").desc(), "head")
    able = counts.withColumn("_rank", F.rank().over(first)).filter(F.col("_rank") <= n).select("column", "d", "n")
    able = saved(able, "top-digests")
    wanted = F.broadcast(able) if able.count() <= FETCHED else able
    values = df.select(*columns).unpivot([], columns, "column", "value").withColumn("d", _digest(F.col("value")))
    found = values.join(wanted, ["column", "d"]).groupBy("column", "d", "n").agg(F.min("value").alias("value"))
    best = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
    return ranked.select("column", "value", "n", "rank")


def staged_quality(stages: dict[str, DataFrame], least: float = 0.8) -> DataFrame:
    """Rows, score and status of each stage; a score below ``least`` fails."""
    parts = [
        quality_report(df).select(
            F.lit(name).alias("stage"),
            F.col("total_rows").alias("record_count"),
            "quality_score",
            F.when(F.col("quality_score") >= least, "passed").otherwise("failed").alias("status"),
        )
        for name, df in stages.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def quality_alerts(report: DataFrame) -> DataFrame:
    """One row: alert level, the alerts of the failed stages, their number."""
    failed = F.when(F.col("status") == "failed", F.concat("stage", F.lit(" quality below threshold")))
    # one entry per stage at most
    alerts = F.array_sort(F.collect_list(failed))
    return report.agg(
        F.when(F.size(alerts) > 0, "warning").otherwise("normal").alias("alert_level"),
        F.array_join(alerts, "; ").alias("alerts"),
        F.size(alerts).cast("bigint").alias("alert_count"),
    )


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows picked by the hash of their key: the same rows in every run."""
    text = F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return df.orderBy(F.md5(text), *keys).limit(n)
