"""Keys of a few rows live in the head of their state; the way to longer keys keeps every row."""

import random

import pytest
from pyspark.sql import Row

from tests.test_stream_velocity import HOUR, Held, feed, processor
from tidemark.streaming.velocity import YOUNG, VelocityRows, _order, _summary


class Counted(Held):
    """Counts the calls too: each goes to another process."""

    calls = 0

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "containsKey", "getValue", "updateValue", "iterator"):
            Counted.calls += 1
        return object.__getattribute__(self, name)


def test_a_short_key_costs_two_calls_a_batch():
    p, _ = processor()
    p.head, p.summaries, p.rows = Counted(), Counted(), Counted()
    for batch in range(4):
        Counted.calls = 0
        out = feed(p, [(batch * 9 * HOUR + k * HOUR, 10 * batch + k, 1.0) for k in range(3)])
        assert Counted.calls <= 2
    assert out["n"] == 12 and not p.rows.map


@pytest.mark.parametrize("seed", range(6))
def test_rows_in_any_order_across_the_limit(seed):
    r = random.Random(seed)
    rows = [(r.choice([None, r.randrange(50 * HOUR)]), r.choice([None, i]), r.choice([None, 0.0, float(r.randrange(90))])) for i in range(YOUNG * 4)]
    p, (head, _, held) = processor()
    q = VelocityRows()
    q.head, q.summaries, q.rows = Held(), Held(), Held()
    at = 0
    while at < len(rows):
        size = r.choice([2, 3, 7, YOUNG])
        part, at = rows[at : at + size], at + size
        out = feed(p, part) if len(part) > 1 else p.advance(part)
        named = [Row(key="k1", micros=t, update_id=i, p=x) for t, i, x in part]
        again = next(q.handleInputRows(("k1",), iter(named), None))
        n, up, down, total, finite = _summary(sorted(rows[:at], key=_order))[:5]
        dated = [t for t, _, _ in rows[:at] if t is not None]
        assert (again["n"], again["up"], again["down"], again["finite"]) == (n, up, down, finite + 1)
        assert again["total"] == pytest.approx(total, abs=1e-9) and again["last_micros"] == max(dated, default=None)
        if len(part) > 1:
            assert (out["n"], out["up"], out["down"], out["finite"]) == (n, up, down, finite + 1)
    assert sum(len(v[0]) for v in held.map.values()) == len(rows) and head.value[20] is None
