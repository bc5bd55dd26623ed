"""Feature preparation: impute, encode, scale, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import running_total
from tidemark.operators.quality import value_frequencies


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def known(c: str) -> Column:
    value = F.col(c).cast("double")
    return F.when(~F.isnan(value), value)


def impute(df: DataFrame, numbers: list[str] | None = None, texts: list[str] | None = None) -> DataFrame:
    """Missing numbers become the mean, missing texts the most frequent value.

    The smallest of equally frequent texts wins; a column without any is 'Unknown'.
    """
    numbers = numeric_columns(df) if numbers is None else numbers
    texts = text_columns(df) if texts is None else texts
    filled = {}
    if numbers:
        means = df.agg(F.struct(*[F.avg(known(c)).alias(c) for c in numbers])).scalar()
        filled.update({c: F.coalesce(known(c), means[c]) for c in numbers})
    if texts:
        best = (
            value_frequencies(df, texts)
            .groupBy("column")
            .agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
        )
        modes = best.agg(F.map_from_entries(F.collect_list(F.struct("column", "value")))).scalar()
        filled.update(
            {c: F.coalesce(c, F.try_element_at(modes, F.lit(c)), F.lit("Unknown")) for c in texts}
        )
    return df.withColumns(filled)


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code): 0-based code of each distinct text in sorted order."""
    values = value_frequencies(df, columns).select("column", "value", F.lit(1).alias("one"))
    ranked = running_total(values, "value", "one", "column", "code")
    return ranked.select("column", "value", (F.col("code") - 1).cast("bigint").alias("code"))


NULL_PARTS = 4096


def code_join(df: DataFrame, codes: DataFrame, c: str, code: Column, name: str) -> DataFrame:
    """``df`` with what ``codes`` says of the text in column ``c``; null where it has nothing.

    A small code table is broadcast by AQE after its size is known; a large one
    is joined by sort-merge with skewed values split. Nulls, which match nothing, are spread.
    """
    table = codes.filter(F.col("column") == c).select(F.col("value").alias("_value"), code.alias(name), F.lit(0).alias("_null"))
    others = F.xxhash64(*(F.col(f"`{x}`") for x in df.columns if x != c), F.lit(c))
    spread = F.when(F.col(c).isNull(), 1 + F.pmod(others, F.lit(NULL_PARTS))).otherwise(0)
    keys = (F.coalesce(F.col(c), F.lit("")) == F.col("_value")) & (spread.cast("int") == F.col("_null"))
    return df.join(table, keys, "left").drop("_value", "_null")


def apply_codes(df: DataFrame, codes: DataFrame, columns: list[str], null_code: int | None = None) -> DataFrame:
    """Replace texts by their codes; an unseen text is an error."""
    out = df
    for c in columns:
        unseen = F.raise_error(F.concat(F.lit(f"unseen label in {c}: "), F.col(c))).cast("bigint")
        code = (
            F.when(F.col(c).isNull(), F.lit(null_code).cast("bigint"))
            .when(F.col("_code").isNull(), unseen)
            .otherwise(F.col("_code"))
        )
        out = code_join(out, codes, c, F.col("code"), "_code").withColumn(c, code).drop("_code")
    return out


def label_encode(df: DataFrame, columns: list[str], null_code: int | None = None) -> DataFrame:
    return apply_codes(df, label_codes(df, columns), columns, null_code)


def scale(df: DataFrame, columns: list[str], sample: bool = False) -> DataFrame:
    """(x - mean) / std. Population std: a constant column is divided by 1.

    Sample std: a constant column has no scaled value (null).
    """
    std = F.stddev_samp if sample else F.stddev_pop
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[std(c).alias(f"s_{c}") for c in columns]
        )
    ).scalar()

    def scaled(c: str) -> Column:
        off, width = F.col(c).cast("double") - stats[f"m_{c}"], stats[f"s_{c}"]
        if sample:
            return F.try_divide(off, width)
        return off / F.when(width == 0, F.lit(1.0)).otherwise(width)

    return df.withColumns({c: scaled(c) for c in columns})


def prepare_features(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Impute, encode and scale every column but ``keep``."""
    features = [c for c in df.columns if c not in keep]
    picked = df.select(*keep, *features)
    texts = [c for c in text_columns(picked) if c in features]
    numbers = [c for c in numeric_columns(picked) if c in features]
    full = impute(picked, numbers, texts)
    coded = label_encode(full, texts)
    return scale(coded, numbers + texts)


def with_split(df: DataFrame, keys: list[str], train: float = 0.8, seed: int = 42) -> DataFrame:
    """``split``: train or test by the hash of the key, the same however the data is laid out."""
    text = F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    limit = f"{round(train * 16**8):08x}"
    return df.withColumn(
        "split", F.when(F.substring(F.md5(text), 1, 8) < limit, "train").otherwise("test")
    )


def with_fold(df: DataFrame, keys: list[str], folds: int, seed: int = 42) -> DataFrame:
    """``fold`` from 0 to ``folds - 1`` by the hash of the key."""
    text = F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", F.pmod(number, F.lit(folds)).cast("int"))
