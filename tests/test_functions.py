import datetime as dt
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.fingerprint import row_fingerprint
from tidemark.functions.nulls import normalize_nulls
from tidemark.functions.numbers import double_text, parse_double, safe_double, safe_int
from tidemark.functions.text import strip, title_case, words
from tidemark.functions.times import iso_text, whole_days

TEXTS = [
    "", " ", "a", "  two  words ", "tab\tand\nline", "\xa0nbsp em\x1f", "O'neil R&d", "hIGH up",
    "q1-2024 x", "éCOLE d'été", "3rd place", "　wide　",
]


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", fn(F.col("v")).alias("o")).collect())]


def test_text_follows_python(spark):
    assert column(spark, TEXTS, "string", strip) == [t.strip() for t in TEXTS]
    assert column(spark, TEXTS, "string", words) == [t.split() for t in TEXTS]
    assert column(spark, TEXTS, "string", title_case) == [t.title() for t in TEXTS]


NUMBERS = [
    "1", "3.9", "-3.9", " 7 ", "1e3", "1_000", ".5", "5.", "", "x", "1d", "0x10", "nan", "inf", "-Infinity", "1e400", None,
]


def as_float(t):
    try:
        return float(t)
    except (TypeError, ValueError):
        return None


def same(a, b):
    if a is None or b is None:
        return a is b
    return a == b or (math.isnan(a) and math.isnan(b))


def test_numbers_follow_python(spark):
    want = [as_float(t) for t in NUMBERS]
    got = column(spark, NUMBERS, "string", parse_double)
    assert all(same(a, b) for a, b in zip(got, want)), list(zip(NUMBERS, got, want))
    whole = [None if w is None or math.isnan(w) or math.isinf(w) else int(w) for w in want]
    assert column(spark, NUMBERS, "string", safe_int) == whole


def test_clamp_leaves_nan(spark):
    got = column(spark, ["-5", "50", "500", "nan", "inf"], "string", lambda c: safe_double(c, 0, 100))
    assert got[:3] == [0.0, 50.0, 100.0] and math.isnan(got[3]) and got[4] == 100.0


@pytest.mark.parametrize("value", [0.0, 12.0, 0.1, 1e7, 12345678.9, 123456789012.5, 0.0005, 2.5e-4, 99.99, 1e-5, 2.5e-7, 1e-300, 1e16, 1.25e20, -1e-5])
def test_double_text(spark, value):
    assert column(spark, [value], "double", double_text) == [repr(value)]


def test_whole_days_floor(spark):
    t0 = dt.datetime(2024, 1, 2, 12)
    cases = [t0, t0 + dt.timedelta(hours=12), t0 - dt.timedelta(hours=12), t0 - dt.timedelta(hours=36),
             t0 + dt.timedelta(hours=36), t0 - dt.timedelta(days=2), None]
    df = spark.createDataFrame([(i, c, t0) for i, c in enumerate(cases)], "i int, a timestamp_ntz, b timestamp_ntz")
    got = [r[1] for r in sorted(df.select("i", whole_days(F.col("a"), F.col("b"))).collect(), key=lambda r: r[0])]
    assert got == [None if c is None else (c - t0).days for c in cases]


def test_iso_text(spark):
    values = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 60)]
    assert column(spark, values, "timestamp_ntz", iso_text) == [v.isoformat() for v in values]


def test_null_texts(spark):
    df = spark.createDataFrame([("NA", 1.0), ("", float("nan")), ("ok", 2.0)], "a string, b double")
    assert sorted(normalize_nulls(df).collect(), key=str) == [("ok", 2.0), (None, 1.0), (None, None)]


def test_fingerprint_is_python_json(spark):
    row = {"b": 'x"y\né\x01', "a": 7, "c": 0.5, "d": None}
    df = spark.createDataFrame([(row["b"], row["a"], row["c"], None)], "b string, a int, c double, d string")
    want = hashlib.sha256(json.dumps(row, sort_keys=True).encode()).hexdigest()
    assert df.select(row_fingerprint(df)).first()[0] == want
