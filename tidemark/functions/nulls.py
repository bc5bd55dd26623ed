"""Null handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that a CSV round trip through pandas turns into null.
NULL_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]


def text_to_null(c: Column) -> Column:
    return F.when(~c.isin(NULL_TEXTS), c)


def normalize_nulls(df: DataFrame) -> DataFrame:
    """Null texts to null and NaN to null in every column that can hold them."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            out.append(text_to_null(c).alias(field.name))
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(~F.isnan(c), c).alias(field.name))
        else:
            out.append(c)
    return df.select(*out)


