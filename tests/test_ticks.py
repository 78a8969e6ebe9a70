"""Ticks within one millisecond: bars open and close in the order of the whole time, as their SQL says."""

import datetime as dt

import pytest
from barlab.plans import registry
from barlab.sources import store
from barlab.sources.bars import build_bars
from oracle import differences

BEGIN = dt.datetime(2024, 1, 1)
#: (event_id, microseconds, value): ids run against the time.
TICKS = [(9, 100, 1.0), (5, 400, 2.0), (3, 900, 3.0)]


@pytest.fixture
def ticks(spark):
    return spark.createDataFrame([(i, BEGIN + dt.timedelta(microseconds=us), 1, "a", v, '{"k": 1}') for i, us, v in TICKS], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_bars_follow_microseconds(ticks):
    assert [(r.open, r.close) for r in build_bars(ticks.repartition(3)).collect()] == [(1.0, 3.0)]


def test_stored_bars_follow_microseconds(spark, ticks, tmp_path):
    for i, (event, _, _) in enumerate(TICKS):
        store.add_batch(str(tmp_path / "bars"), i, ticks.where(f"event_id = {event}"))
    assert [(r.open, r.close) for r in store.stored_bars(spark, str(tmp_path / "bars"), 1).collect()] == [(1.0, 3.0)]


@pytest.mark.parametrize("values", [(3.0, 1.0, 2.0), (1.0, 3.0, 2.0), (2.0, 3.0, 1.0)])
def test_ticks_of_one_time_and_id_are_ordered_by_price(spark, tmp_path, values):
    rows = [(1, BEGIN, 1, "a", v, '{"k": 1}') for v in values]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1)
    assert [(r.open, r.close) for r in build_bars(events).collect()] == [(1.0, 3.0)]
    store.add_batch(str(tmp_path / "bars"), 0, events)
    assert [(r.open, r.close) for r in store.stored_bars(spark, str(tmp_path / "bars"), 1).collect()] == [(1.0, 3.0)]
    events.write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "events.parquet")
    for name in ("c06_run_fingerprint", "s03_bars"):
        assert differences(spark, str(tmp_path), registry.QUERIES[name], registry.SQL[name]) == []


def test_the_last_half_millisecond_belongs_to_its_hour(spark, tmp_path):
    rows = [(0, BEGIN, 1, "a", 1.0, '{"k": 1}'), (1, BEGIN + dt.timedelta(microseconds=3_599_999_734), 1, "a", 2.0, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "events.parquet")
    assert [r.volume for r in registry.QUERIES["s03_bars"](spark, str(tmp_path)).collect()] == [2.0]
    assert differences(spark, str(tmp_path), registry.QUERIES["s03_bars"], registry.SQL["s03_bars"]) == []


def test_fingerprints_equal_their_sql(spark, ticks, tmp_path):
    ticks.coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "events.parquet")
    for name in ("c06_run_fingerprint", "s03_bars"):
        assert differences(spark, str(tmp_path), registry.QUERIES[name], registry.SQL[name]) == []


@pytest.fixture(scope="module")
def close_ticks(spark, tmp_path_factory):
    """Every event of sf0.01 four times: three within a millisecond, ids against the time, the last of them twice with equal time and id; and all prices apart."""
    at = tmp_path_factory.mktemp("close")
    copies = "inline(arrays_zip(array(9, 5, 3, 3), array(100, 400, 900, 900), array(1.0D, 1.03D, 0.98D, 1.07D))) AS (k, us, p)"
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").selectExpr("*", copies)
    rows = events.selectExpr("event_id * 10 + k AS event_id", "timestampadd(MICROSECOND, us, date_trunc('MILLISECOND', ts)) AS ts", "user_id", "event_type", "value * p AS value", "props")
    rows.withColumn("ts", rows.ts.cast("timestamp_ntz")).coalesce(1).write.parquet(str(at / "written"))
    next((at / "written").glob("*.parquet")).rename(at / "events.parquet")
    return str(at)


SIGNALS = ["g05_dual_ma", "g09_kama_trend", "g11_chaos_trend", "g12_vol_regime_arb", "g13_pattern_blend", "g15_momentum", "g16_heikin_ashi_ema", "g17_connors_rsi2", "g21_obv_divergence", "g22_two_timeframes"]


@pytest.mark.parametrize("name", SIGNALS)
def test_signals_on_close_ticks_equal_their_sql(spark, close_ticks, name):
    assert differences(spark, close_ticks, registry.QUERIES[name], registry.SQL[name]) == []
    assert registry.QUERIES[name](spark, close_ticks).count() > 20


@pytest.fixture(scope="module")
def tied_ticks(spark, tmp_path_factory):
    """Every event of sf0.01 six times with the same time and id and other prices, in mixed order."""
    at = tmp_path_factory.mktemp("tied")
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").selectExpr("*", "explode(array(1.0D, 1.31D, 0.87D, 1.12D, 0.76D, 1.23D)) AS p")
    rows = events.selectExpr("event_id", "ts", "user_id", "event_type", "round(value * p, 2) AS value", "props", "xxhash64(event_id, p) AS mixed").repartition(1).sortWithinPartitions("mixed").drop("mixed")
    rows.write.parquet(str(at / "written"))
    next((at / "written").glob("*.parquet")).rename(at / "events.parquet")
    return str(at)


#: Each of these had other rows than its SQL while ticks of equal time and id were left to chance.
TIED = [
    "g05_dual_ma",
    "g09_kama_trend",
    "g11_chaos_trend",
    "g12_vol_regime_arb",
    "g13_pattern_blend",
    "g15_momentum",
    "g16_heikin_ashi_ema",
    "g17_connors_rsi2",
    "g21_obv_divergence",
    "g22_two_timeframes",
]


@pytest.mark.parametrize("name", TIED)
def test_signals_on_ticks_of_one_time_and_id_equal_their_sql(spark, tied_ticks, name):
    assert differences(spark, tied_ticks, registry.QUERIES[name], registry.SQL[name]) == []
    assert registry.QUERIES[name](spark, tied_ticks).count() > 20
