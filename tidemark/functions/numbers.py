"""Number parsing and printing that follow Python's rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import strip

# A decimal literal Python's float() takes; Java alone would also take "1d" or "0x1p3".
_FLOAT_TEXT = (
    "(?i)^[+-]?((\\d+(_\\d+)*\\.?|(\\d+(_\\d+)*)?\\.\\d+(_\\d+)*|\\d+(_\\d+)*\\.\\d+(_\\d+)*)"
    "(e[+-]?\\d+(_\\d+)*)?|inf|infinity|nan)$"
)


def parse_double(c: Column) -> Column:
    """Double value of a text, null where it is not a number."""
    body = strip(c.cast("string"))
    return F.when(body.rlike(_FLOAT_TEXT), F.regexp_replace(body, "_", "").try_cast("double"))


def is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(float("inf"))


def safe_int(c: Column) -> Column:
    """Whole part of the number in a text; null for no number, NaN and infinity."""
    value = parse_double(c)
    return F.when(~F.isnan(value) & ~is_infinite(value), value.try_cast("bigint"))


def safe_double(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Number in a text, moved into [low, high]; NaN passes as it is."""
    value = parse_double(c)
    if low is None and high is None:
        return value
    clamped = value
    if low is not None:
        clamped = F.greatest(clamped, F.lit(float(low)))
    if high is not None:
        clamped = F.least(clamped, F.lit(float(high)))
    return F.when(F.isnan(value), value).otherwise(clamped)


def double_text(c: Column) -> Column:
    """Text of a double as Python prints it: no exponent from 1e-4 up to 1e16, else like ``1e-05``."""
    size, text = F.abs(c), c.cast("string")
    wide = F.when(size >= 1e7, text.try_cast("decimal(38,10)")).otherwise(text.try_cast("decimal(38,24)"))
    plain = F.regexp_replace(F.rtrim(wide.cast("string"), F.lit("0")), "\\.$", ".0")
    odd = ((size >= 1e7) & (size < 1e16)) | ((size < 1e-3) & (size >= 1e-4))
    power = F.regexp_replace(text, "\\.0E", "E")
    power = F.regexp_replace(F.regexp_replace(power, "E(\\d)", "e+$1"), "E-", "e-")
    power = F.regexp_replace(power, "e(?<s>[+-])(?<d>\\d)$", "e${s}0${d}")
    return F.when(odd, plain).when(text.contains("E"), power).otherwise(text)
