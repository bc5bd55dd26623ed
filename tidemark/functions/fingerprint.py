"""Row fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import double_text
from tidemark.functions.times import iso_text


def _quoted(c: Column) -> Column:
    """JSON string in ASCII with lower-case escapes, as Python prints it."""
    body = F.to_json(F.array(c), {"writeNonAsciiCharacterAsCodePoint": "true"})
    quoted = body.substr(F.lit(2), F.length(body) - 2)
    pieces = F.regexp_extract_all(quoted, F.lit("(?s)(\\\\u[0-9A-F]{4}|\\\\.|[^\\\\]+)"), 1)
    lowered = F.array_join(
        F.transform(pieces, lambda p: F.when(p.rlike("^\\\\u[0-9A-F]{4}$"), F.lower(p)).otherwise(p)), ""
    )
    return F.when(c.rlike("[^ -~]"), lowered).otherwise(quoted)


def row_fingerprint(df: DataFrame) -> Column:
    """SHA-256 of the row as key-sorted JSON text, with ``", "`` and ``": "`` between parts."""
    parts = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            shown = _quoted(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            shown = double_text(c.cast("double"))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            shown = F.concat(F.lit('"'), iso_text(c), F.lit('"'))
        else:
            shown = c.cast("string")
        parts.append(F.concat(F.lit(f'"{f.name}": '), F.coalesce(shown, F.lit("null"))))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)
