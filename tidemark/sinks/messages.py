"""Message and table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.jsons import EXACT
from tidemark.functions.times import iso_text


def normalize_values(df: DataFrame) -> DataFrame:
    """NaN to null and times to ISO text, so that JSON holds neither NaN nor dates."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso_text(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def to_messages(df: DataFrame, key: str | None = None, **stamps: Column) -> DataFrame:
    """``key`` and JSON ``value`` of each row; ``stamps`` are added to the value."""
    plain = normalize_values(df).withColumns(stamps) if stamps else normalize_values(df)
    key_column = F.col(key).cast("string") if key else F.lit(None).cast("string")
    return plain.select(
        key_column.alias("key"),
        F.to_json(F.struct(*plain.columns), EXACT).alias("value"),
    )


def publish(messages: DataFrame, target: str, format: str = "json", **options: str) -> None:
    """Write messages: ``json`` to a folder, ``kafka`` to a topic (needs the connector)."""
    if format == "kafka":
        messages.write.format("kafka").option("topic", target).options(**options).save()
    else:
        messages.write.format(format).mode("append").options(**options).save(target)


# File endings and their formats; any other ending is csv.
FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}


def format_of(path: str) -> str:
    return next((f for end, f in FORMATS.items() if path.endswith(end)), "csv")


# Text names every field in every row; packed it takes a tenth. Spark reads it by the ending of its files, each of
# which is one task, so a file holds no more rows than this.
PACKED = {"compression": "gzip", "maxRecordsPerFile": "500000"}
# A lower level takes a third of the time and a quarter more space, for runs that write more than they compute.
QUICK = PACKED | {"zlib.compress.level": "TWO"}


def write_table(df: DataFrame, path: str, format: str = "auto", **options: str) -> None:
    """Write a folder in the format its name ends with; ``options`` are those of the format, such as ``PACKED``."""
    kind = format_of(path) if format == "auto" else format
    writer = df.write.mode("overwrite").options(**options)
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        writer.options(**EXACT).json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format: {kind}")
