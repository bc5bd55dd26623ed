"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def moment(text: str) -> Column:
    """A time literal without zone."""
    return F.to_timestamp_ntz(F.lit(text))


def whole_days(later: Column, earlier: Column) -> Column:
    """Full days from ``earlier`` to ``later``, rounded down (``datediff`` rounds to zero)."""
    span = later - earlier
    days = F.extract(F.lit("DAY"), span)
    return (days - F.when(F.make_dt_interval(days) > span, 1).otherwise(0)).cast("bigint")


def minute_number(c: Column) -> Column:
    """Minutes since 1970, without a time zone; null stays null."""
    span = c - moment("1970-01-01 00:00:00")
    part = [F.extract(F.lit(unit), span) for unit in ("DAY", "HOUR", "MINUTE")]
    return (part[0] * 1440 + part[1] * 60 + part[2]).cast("bigint")


def iso_text(c: Column) -> Column:
    """ISO text with microseconds only where there are any."""
    # one formatting of the time, also where an expression is evaluated for each use
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.replace(text, F.lit(".000000"), F.lit(""))
