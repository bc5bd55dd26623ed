"""Velocity of key results as a stream: keyed state instead of the history.

The state of a key is its rows by hour, a summary of each hour, and a head that sums up all hours but the last. Rows
that come in order touch the head and the last hour only. A row for an earlier hour splits the summaries there: that hour
is summed up anew from its rows, and the head from the summaries. No batch reads rows of hours that it does not
touch, and none reads other keys. A key of a few rows has them all in its head instead, so that most keys of a batch
cost one read and one write.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Row as SqlRow
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.times import DAY_MICROS, moment
from tidemark.streaming.views import keep_upserted

HOUR_MICROS = DAY_MICROS // 24
UNDATED = 1 << 62  # the hour of rows without date: after all others
YOUNG = 32  # a key with no more rows has them in its head

# (micros or None, id or None, progress or None)
Row = tuple
# n, up, down, total, finite, then first and last (micros, progress)
Summary = tuple

SUMMARY = "n long, up long, down long, total double, finite long, t0 long, p0 double, t1 long, p1 double"
ROWS = "t array<long>, i array<long>, p array<double>"
PARTS = "key string, n long, last_micros long, up long, down long, total double, finite long"


def _steps(t0: int | None, p0: float | None, t1: int | None, p1: float | None) -> tuple[int, int, float, int]:
    """Up, down, finite sum and finite count of the speed from one row to the next."""
    change = p1 - p0 if p0 is not None and p1 is not None else 0.0
    days = (t1 - t0) // DAY_MICROS if t0 is not None and t1 is not None else 1
    if days == 0:
        return int(change > 0), int(change < 0), 0.0, 0
    return 0, 0, change / days, 1


def _merge(a: Summary | None, b: Summary) -> Summary:
    """Summary of two neighbouring stretches of rows; associative."""
    if a is None:
        return b
    between = _steps(a[7], a[8], b[5], b[6])
    return (a[0] + b[0], *(x + y + z for x, y, z in zip(a[1:5], b[1:5], between, strict=True)), *a[5:7], *b[7:9])


def _summary(rows: Iterable[Row]) -> Summary:
    """Summary of rows in order; the first row counts as no change over one day only for a whole key."""
    out = None
    for t, _, p in rows:
        out = _merge(out, (1, 0, 0, 0.0, 0, t, p, t, p))
    return out


def _order(row: Row) -> tuple:
    t, i, p = row
    return (t is None, t or 0, i is not None, i or 0, p is not None, p or 0.0)


def _none(x) -> float | None:
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else x


def _hour(row: Row) -> int:
    return UNDATED if row[0] is None else row[0] // HOUR_MICROS


def _rows(lists: tuple) -> list[Row]:
    """Rows from their columns, if there are any."""
    return [] if lists[0] is None else [tuple(_none(x) for x in row) for row in zip(*lists, strict=True)]


def _lists(rows: list[Row]) -> tuple:
    return tuple(list(x) for x in zip(*rows, strict=True))


# the summary of no rows
NOTHING = (0, 0, 0, 0.0, 0, None, None, None, None)


class VelocityState(StatefulProcessor):
    """(key, micros, update_id, p) rows in, as frames; the parts of each key of the batch out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        end = ", ".join(f"end_{field}" for field in SUMMARY.split(", "))
        self.head = handle.getValueState("head", f"{SUMMARY}, last_hour long, latest long, {end}, {ROWS}")
        self.summaries = handle.getMapState("summaries", "hour long", SUMMARY)
        self.rows = handle.getMapState("rows", "hour long", ROWS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [
            tuple(None if pd.isna(x) else x for x in row)
            for part in rows
            for row in zip(part["micros"], part["update_id"], part["p"], strict=True)
        ]
        n, latest, up, down, total, finite = self.advance(fresh)
        yield pd.DataFrame(
            {
                "key": [key[0]], "n": [n], "last_micros": pd.array([latest], "Int64"), "up": [up], "down": [down],
                "total": [total], "finite": [finite],
            }
        )

    def advance(self, fresh: Iterable[Row]) -> tuple:
        """Put rows into the state of the key; its n, last micros, up, down, total and finite after that."""
        fresh = [(None if t is None else int(t), None if i is None else int(i), None if p is None else float(p)) for t, i, p in fresh]
        # every call on the state goes to another process: one to read the head, one to write it
        held = self.head.get()
        young, closed, last_hour, latest, end = [], None, None, None, None
        if held is not None:
            held = tuple(_none(x) for x in held)
            closed, last_hour, latest = (held[:9] if held[0] else None), held[9], held[10]
            end, young = (held[11:20] if held[11] else None), _rows(held[20:])
        latest = max((t for t in (latest, *(t for t, _, _ in fresh)) if t is not None), default=None)
        if end is None and len(young) + len(fresh) <= YOUNG:
            rows = sorted(young + fresh, key=_order)
            self.head.update((*NOTHING, _hour(rows[-1]), latest, *NOTHING, *_lists(rows)))
            return self._parts(latest, _summary(rows))
        # what was held in the head goes with the new rows, by hour
        by_hour: dict[int, list[Row]] = {}
        for row in young + fresh:
            by_hour.setdefault(_hour(row), []).append(row)
        known = None if end is None else last_hour
        summed = {hour: self._add(hour, more, known is not None and hour <= known) for hour, more in sorted(by_hour.items())}
        hours = sorted(summed)
        if known is not None and hours[0] < known:
            # late rows: the summaries of all hours, some of them new, are folded again
            closed, every = None, sorted((k[0], tuple(_none(x) for x in v)) for k, v in self.summaries.iterator())
            last_hour = every[-1][0]
            for hour, summary in every[:-1]:
                closed = _merge(closed, summary)
            end = every[-1][1]
        else:
            if known is not None and hours[0] > known:
                closed = _merge(closed, end)
            for hour in hours[:-1]:
                closed = _merge(closed, summed[hour])
            last_hour, end = hours[-1], summed[hours[-1]]
        self.head.update((*(closed or NOTHING), last_hour, latest, *end, None, None, None))
        return self._parts(latest, _merge(closed, end))

    @staticmethod
    def _parts(latest: int | None, summary: Summary) -> tuple:
        n, up, down, total, finite = summary[:5]
        # the first row of a key counts as no change over one day
        return n, latest, up, down, total, finite + 1

    def _add(self, hour: int, more: list[Row], may_be_held: bool) -> Summary:
        """Put rows into an hour and sum it up."""
        held = []
        if may_be_held and self.rows.containsKey((hour,)):
            held = _rows(self.rows.getValue((hour,)))
        rows = sorted(held + more, key=_order)
        self.rows.updateValue((hour,), _lists(rows))
        summary = _summary(rows)
        self.summaries.updateValue((hour,), summary)
        return summary

    def close(self) -> None:
        pass


class VelocityRows(VelocityState):
    """The same with plain rows in and out: a key costs no frame of its own."""

    def handleInputRows(self, key, rows: Iterator[SqlRow], timerValues) -> Iterator[SqlRow]:
        n, latest, up, down, total, finite = self.advance((_none(r["micros"]), _none(r["update_id"]), _none(r["p"])) for r in rows)
        yield SqlRow(key=key[0], n=n, last_micros=latest, up=up, down=down, total=total, finite=finite)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_velocity_parts(updates: DataFrame, out: str) -> None:
    """Keep ``operators.goals.velocity_parts`` of a stream of updates as a table of one row per key below ``out``.

    A batch reads the state of its keys and the last version of the table, whose size is that of the keys.
    """
    start = moment("1970-01-01 00:00:00")
    rows = updates.select(
        # a null key is a group of its own
        F.coalesce(F.concat(F.lit("k"), F.col("key_result_id").cast("string")), F.lit("")).alias("key"),
        F.timestamp_diff("MICROSECOND", start, F.col("update_date").cast("timestamp_ntz")).alias("micros"),
        F.col("update_id").cast("long").alias("update_id"),
        F.col("progress_percentage").cast("double").alias("p"),
    )
    parts = rows.groupBy("key").transformWithState(VelocityRows(), PARTS, "Update", "None")
    kind = dict(updates.dtypes)["key_result_id"]
    days, rest = F.floor(F.col("last_micros") / DAY_MICROS), F.pmod("last_micros", F.lit(DAY_MICROS))
    last = start + F.make_dt_interval(days.cast("int")) + F.make_dt_interval(secs=(rest.cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)"))
    named = parts.select(
        F.expr("substring(key, 2)").cast("string").alias("_key"), (F.col("key") != "").alias("_known"), "n", last.alias("last_update"),
        "up", "down", "total", "finite",
    ).withColumn("key_result_id", F.when(F.col("_known"), F.col("_key")).cast(kind))
    spark = updates.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        keep_upserted(named.drop("_key", "_known"), out, ["key_result_id"])
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
