"""Cleaning and validation rules for goal rows and for rows of any kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import (
    is_infinite,
    parse_double,
    safe_double,
    safe_int,
)
from tidemark.functions.text import strip, title_case


def _set(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _text(c: Column) -> Column:
    return F.when(_set(c), strip(c))


# Field -> expression on the raw text. Extend or replace entries to add rules.
GOAL_CLEANERS = {
    "department": lambda c: title_case(_text(c)),
    "objective": _text,
    "objective_type": lambda c: title_case(_text(c)),
    "priority": lambda c: F.coalesce(title_case(_text(c)), F.lit("Medium")),
    "quarter": lambda c: F.upper(_text(c)),
    "team_size": safe_int,
    "budget": safe_double,
    "timeline_days": safe_int,
    "progress": lambda c: safe_double(c, 0, 100),
    "status": lambda c: F.coalesce(title_case(_text(c)), F.lit("Unknown")),
}
WHOLE_NUMBERS = ["team_size", "timeline_days"]

# The rule messages.
EMPTY_ROW = "Empty row"
SHORT_TEXT = "Invalid or too short objective"
PROGRESS = "Progress must be between 0 and 100"
TEAM_SIZE = "Team size must be positive"
INFINITE = "Invalid {}: cannot convert float infinity to integer"

META = ["row_num", "source_file", "file_id"]


def payload_columns(df: DataFrame) -> list[str]:
    """Columns that are data: neither row metadata nor names that start with ``_``.

    Where the metadata is in columns that start with ``_``, its plain names are data like others.
    """
    return [c for c in df.columns if c != row_column(df, c) or (c not in META and not c.startswith("_"))]


def row_column(df: DataFrame, name: str) -> str:
    """Name of a metadata column: with ``_`` in front where there is one."""
    return f"_{name}" if name in META and f"_{name}" in df.columns else name


def any_filled(df: DataFrame, columns: list[str]) -> Column:
    """True where at least one column holds something besides white space."""
    if not columns:
        return F.lit(False)
    filled = [F.coalesce(strip(F.col(f"`{c}`").cast("string")) != "", F.lit(False)) for c in columns]
    out = filled[0]
    for f in filled[1:]:
        out = out | f
    return out


def clean_goals(rows: DataFrame) -> DataFrame:
    """Apply the field cleaners to the columns that are present."""
    return rows.withColumns(
        {n: clean(F.col(n)) for n, clean in GOAL_CLEANERS.items() if n in rows.columns}
    )


def validate_goals(rows: DataFrame) -> DataFrame:
    """Cleaned rows with ``_validation_errors`` (texts) and ``_is_valid``.

    A number text that is infinite is an error, but does not make the row invalid.
    """
    data = payload_columns(rows)
    notes = [F.when(~any_filled(rows, data), EMPTY_ROW)]
    notes += [
        F.when(is_infinite(parse_double(F.col(n))), INFINITE.format(n))
        for n in WHOLE_NUMBERS
        if n in rows.columns
    ]
    fatal = [F.col("_raw_notes")[0].isNotNull()]
    cleaned = clean_goals(rows.withColumn("_raw_notes", F.array(*notes)))
    rules = []
    if "objective" in rows.columns:
        short = F.col("objective").isNull() | (F.length(strip(F.col("objective"))) < 3)
        rules.append(F.when(short, SHORT_TEXT))
        fatal.append(short)
    if "progress" in rows.columns:
        # clamped before, so only NaN can be outside
        outside = F.coalesce(F.isnan("progress"), F.lit(False))
        rules.append(F.when(outside, PROGRESS))
        fatal.append(outside)
    if "team_size" in rows.columns:
        small = F.coalesce(F.col("team_size") < 1, F.lit(False))
        rules.append(F.when(small, TEAM_SIZE))
        fatal.append(small)
    bad = fatal[0]
    for f in fatal[1:]:
        bad = bad | f
    more = F.array(*rules) if rules else F.array().cast("array<string>")
    return cleaned.withColumns(
        {
            "_validation_errors": F.array_compact(F.concat("_raw_notes", more)),
            "_is_valid": ~bad,
        }
    ).drop("_raw_notes")


def validate_generic(rows: DataFrame) -> DataFrame:
    """Trimmed texts and ``_is_valid``: at least one value is filled."""
    texts = {
        f.name: strip(F.col(f.name))
        for f in rows.schema.fields
        if isinstance(f.dataType, T.StringType)
    }
    return rows.withColumn("_is_valid", any_filled(rows, rows.columns)).withColumns(texts)


# Configured ranges and value domains.
GOAL_RANGES = {
    "progress": (0, 100),
    "team_size": (1, 1000),
    "budget": (0, 10_000_000),
    "timeline_days": (1, 3650),
}
REQUIRED = ["objective"]
MIN_TEXT_LENGTH = 3
GOAL_DOMAINS = {
    "status": ["active", "completed", "cancelled", "on_hold"],
    "priority": ["low", "medium", "high", "critical"],
    "quarter": [1, 2, 3, 4],
    "metric_type": ["percentage", "number", "currency", "boolean"],
}


def check_rules(
    df: DataFrame,
    ranges: dict[str, tuple[float, float]] = {},
    required: list[str] = (),
    min_length: int = 0,
    domains: dict[str, list] = {},
) -> DataFrame:
    """Add ``violations``: one text per broken rule. Null passes ranges and domains."""
    rules = []
    for c in required:
        short = F.col(c).isNull() | (F.length(strip(F.col(c).cast("string"))) < max(min_length, 1))
        rules.append(F.when(short, f"{c} missing or too short"))
    for c, (low, high) in ranges.items():
        if c in df.columns:
            rules.append(F.when(~F.col(c).between(low, high), f"{c} out of range"))
    for c, values in domains.items():
        if c in df.columns:
            rules.append(F.when(~F.col(c).isin(values), f"{c} not allowed"))
    found = F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")
    return df.withColumn("violations", found)


# Short column names and what they stand for.
ALIASES = {
    "dept": "department",
    "obj": "objective",
    "obj_type": "objective_type",
    "prio": "priority",
    "qtr": "quarter",
    "team": "team_size",
    "cost": "budget",
    "days": "timeline_days",
    "pct": "progress",
    "stat": "status",
}


def rename_aliases(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Short names to long ones; where a frame has both, the long column is filled from the short."""
    have = set(df.columns)
    both = {short: long for short, long in aliases.items() if short in have and long in have}
    filled = df.withColumns({long: F.coalesce(long, short) for short, long in both.items()}) if both else df
    return filled.drop(*both).withColumnsRenamed(aliases)
