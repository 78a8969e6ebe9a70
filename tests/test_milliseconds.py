"""Hours of s02_first_per_hour and st2_stream_bars by rounded milliseconds, and their order, against their SQL and plain loops."""

import datetime as dt

import pytest
from barlab.plans import registry
from oracle import differences

BEGIN = dt.datetime(2024, 1, 1)
HOUR = 3_600_000_000
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stored(spark, at, rows, begin=BEGIN):
    """A folder whose events are (event_id, microseconds from the beginning, event_type, value)."""
    ticks = [(i, None if us is None else begin + dt.timedelta(microseconds=us), 1, s, v, '{"k": 1}') for i, us, s, v in rows]
    spark.createDataFrame(ticks, SCHEMA).coalesce(1).write.parquet(str(at / "written"))
    next((at / "written").glob("*.parquet")).rename(at / "events.parquet")
    return str(at)


def around_hours():
    """Ticks just before, at and after the last half millisecond of five hours, the ids against the time."""
    times = [h * HOUR + us for h in range(5) for us in (1000, HOUR - 501, HOUR - 500 + h % 2, HOUR - 1)]
    return [(100 - i, us, "ab"[i % 3 % 2], 1.0 + i) for i, us in enumerate(times)]


@pytest.mark.parametrize("begin", [BEGIN, dt.datetime(1969, 12, 31, 21)])
def test_first_per_hour_takes_hours_of_rounded_milliseconds(spark, tmp_path, begin):
    folder = stored(spark, tmp_path, around_hours(), begin)
    query, sql = registry.QUERIES["s02_first_per_hour"], registry.SQL["s02_first_per_hour"]
    assert differences(spark, folder, query, sql) == []
    if begin == BEGIN:
        want, first_hour = {}, int((BEGIN - dt.datetime(1970, 1, 1)).total_seconds()) // 3600
        for event_id, us, symbol, value in sorted(around_hours(), key=lambda r: r[1]):
            want.setdefault((symbol, first_hour + (us + 500) // HOUR), (event_id, value))
        assert {(r.event_type, r.hour): (r.event_id, r.value) for r in query(spark, folder).collect()} == want


def test_first_per_hour_puts_nulls_last(spark, tmp_path):
    rows = [(None, 0, "a", 1.0), (7, 0, "a", 2.0), (3, None, "a", 3.0), (None, None, "a", 4.0), (None, 5, "b", 5.0)]
    folder = stored(spark, tmp_path, rows)
    assert differences(spark, folder, registry.QUERIES["s02_first_per_hour"], registry.SQL["s02_first_per_hour"]) == []


@pytest.mark.parametrize("values", [(3.0, 1.0, 2.0), (2.0, 3.0, 1.0), (None, 2.0, 1.0)])
def test_first_per_hour_leaves_no_tie_to_chance(spark, tmp_path, values):
    folder = stored(spark, tmp_path, [(1, 0, "a", v) for v in values])
    assert [r.value for r in registry.QUERIES["s02_first_per_hour"](spark, folder).collect()] == [1.0]


def test_stream_bars_take_hours_of_rounded_milliseconds(spark, tmp_path):
    folder = stored(spark, tmp_path, around_hours())
    query, sql = registry.QUERIES["st2_stream_bars"], registry.SQL["st2_stream_bars"]
    assert differences(spark, folder, query, sql) == []
    want, first_hour = {}, int((BEGIN - dt.datetime(1970, 1, 1)).total_seconds()) // 3600
    last = max((us + 500) // 1000 for _, us, *_ in around_hours())
    for _, us, symbol, value in sorted(around_hours(), key=lambda r: r[1]):
        hour = (us + 500) // HOUR
        if (hour + 1) * 3_600_000 <= last - 2 * 3_600_000:
            want.setdefault((symbol, first_hour + hour), []).append(value)
    got = {(r.symbol, r.hour): (r.open, r.high, r.low, r.close, r.volume) for r in query(spark, folder).collect()}
    assert len(want) > 4 and got == {k: (v[0], max(v), min(v), v[-1], len(v)) for k, v in want.items()}


@pytest.mark.parametrize("last", [3 * HOUR - 501, 3 * HOUR - 500, 3 * HOUR])
def test_stream_bars_are_out_when_the_rounded_watermark_has_passed(spark, tmp_path, last):
    folder = stored(spark, tmp_path, [(1, 10, "a", 1.0), (2, last, "a", 2.0)])
    assert differences(spark, folder, registry.QUERIES["st2_stream_bars"], registry.SQL["st2_stream_bars"]) == []
    assert registry.QUERIES["st2_stream_bars"](spark, folder).count() == (last >= 3 * HOUR - 500)


def test_stream_bars_put_ids_that_are_null_last(spark, tmp_path):
    rows = [(None, 10, "a", 1.0), (7, 10, "a", 2.0), (3, 10, "a", 3.0), (9, 5 * HOUR, "a", 4.0)]
    folder = stored(spark, tmp_path, rows)
    assert differences(spark, folder, registry.QUERIES["st2_stream_bars"], registry.SQL["st2_stream_bars"]) == []
    assert [(r.open, r.close) for r in registry.QUERIES["st2_stream_bars"](spark, folder).collect()] == [(3.0, 1.0)]


@pytest.mark.parametrize("values", [(3.0, 1.0, 2.0), (1.0, 3.0, 2.0), (2.0, 3.0, 1.0)])
def test_stream_bars_leave_no_tie_to_chance(spark, tmp_path, values):
    folder = stored(spark, tmp_path, [(1, 0, "a", v) for v in values] + [(2, 5 * HOUR, "a", 9.0)])
    assert [(r.open, r.close) for r in registry.QUERIES["st2_stream_bars"](spark, folder).collect()] == [(1.0, 3.0)]
