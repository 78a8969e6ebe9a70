"""Streams that stop and go on, and stored bars that grow: what is counted once, late, or read in part."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.sources import store
from barlab.streaming import state

BEGIN = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, s, float(v), BEGIN + dt.timedelta(minutes=m)) for i, (s, m, v) in enumerate(rows)], "event_id long, event_type string, value double, ts timestamp_ntz")


def gate_by_loop(rows, until_minute):
    out = {}
    for s in sorted({r[0] for r in rows}):
        equity, peak, day, lost, broken, taken, refused = state.CAPITAL, state.CAPITAL, -1, 0.0, False, 0, 0
        for _, m, v in sorted((r for r in rows if r[0] == s and r[1] < until_minute), key=lambda r: r[1]):
            if m // 1440 > day:
                day, lost = m // 1440, 0.0
            broken = broken or (peak - equity) / peak * 100 >= state.BREAKER
            if broken or (lost < 0 and -lost / equity * 100 >= state.DAILY):
                refused += 1
                continue
            pnl = (v - 50) / 10
            equity, lost, taken = equity + pnl, lost + pnl, taken + 1
            peak = max(peak, equity)
        out[s] = (round(equity, 5), broken, taken, refused)
    return out


def test_the_gate_goes_on_after_a_restart_and_leaves_late_rows_out(spark, tmp_path):
    rng = np.random.default_rng(1)
    minutes = rng.permutation(4000)[:900]
    rows = [(str(rng.choice(["a", "b"])), int(m), float(rng.normal(20 if m % 1440 > 900 else 60, 60))) for m in sorted(minutes)]
    parts = [rows[:300], rows[300:600], rows[600:]]
    late = [("a", 5, 1e6)]  # days behind the watermark of the third run
    at, source = str(tmp_path / "gate"), str(tmp_path / "in")
    for i, part in enumerate(parts):
        shuffled = [part[j] for j in rng.permutation(len(part))] + (late if i == 2 else [])
        events(spark, shuffled).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("event_id long, event_type string, value double, ts timestamp_ntz").parquet(source)
        state.run_risk_gate(stream, at)
        seen = [r for p in parts[: i + 1] for r in p]
        until = (max(r[1] for r in seen) - 60 * state.DELAY_HOURS) // 60 * 60
        got = {r.symbol: (r.equity, r.broken, r.taken, r.refused) for r in state.latest_of_gate(spark, at).collect()}
        assert got == gate_by_loop(rows, until)
    assert sum(t + f for _, _, t, f in got.values()) > 700 and any(f for *_, f in got.values())
    kept = spark.read.format("statestore").option("stateVarName", "gate").load(f"{at}/progress").selectExpr("key.symbol AS symbol", "round(value.equity, 5) AS equity", "value.taken AS taken").collect()
    assert {r.symbol: (r.equity, r.taken) for r in kept} == {s: (e, t) for s, (e, _, t, _) in got.items()}


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    rows = [("a", m, m % 90) for m in range(500)] + [("b", m, 1) for m in range(3)]
    source, at = str(tmp_path / "in"), str(tmp_path / "out")
    events(spark, rows).repartition(4).write.parquet(source)
    stream = spark.readStream.schema("event_id long, event_type string, value double, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(source).selectExpr("event_type AS symbol", "value AS x")
    sums = state.sums_of_batches(stream, at, ["symbol"])
    assert {r.symbol: (r.n, r.s) for r in sums.collect()} == {"a": (500, float(sum(m % 90 for m in range(500)))), "b": (3, 3.0)}
    assert spark.read.parquet(f"{at}/sums").select("batch").distinct().count() == 4
    # the commit of the last batch is lost: it runs again, and writes the same part
    commits = sorted((tmp_path / "out" / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert {r.symbol: r.n for r in state.sums_of_batches(stream, at, ["symbol"]).collect()} == {"a": 500, "b": 3}


def bars_by_loop(rows, hours):
    out = {}
    for i, (s, m, v) in enumerate(rows):
        if v > 0:
            out.setdefault((s, (int(BEGIN.timestamp()) // 3600 + m // 60) // hours * hours), []).append((m, i, v))
    return sorted((s, h, min(x)[2], max(v for *_, v in x), min(v for *_, v in x), max(x)[2], float(len(x))) for (s, h), x in out.items())


def test_stored_bars_grow_by_batches_and_are_read_in_part(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(str(rng.choice(["a", "b", "c"])), int(rng.integers(0, 3000)), float(rng.integers(0, 100))) for _ in range(1500)]
    root, ev = str(tmp_path / "bars"), events(spark, rows)
    with_epoch = ev.withColumn("ts", F.col("ts"))
    for batch in (0, 1, 2, 1):  # batches overlap in their hours, and one is run twice
        store.add_batch(root, batch, with_epoch.where(F.col("event_id") % 3 == batch))
    for hours in (1, 4, 24):
        got = sorted(map(tuple, store.stored_bars(spark, root, hours).select("symbol", "hour", "open", "high", "low", "close", "volume").collect()))
        assert got == bars_by_loop(rows, hours)
    want = bars_by_loop(rows, 1)
    middle = want[len(want) // 6][1]
    part = store.stored_bars(spark, root, 1, ["a", "c"], middle)
    assert sorted((r.symbol, r.hour) for r in part.collect()) == [(s, h) for s, h, *_ in want if s in "ac" and h >= middle]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tf" in plan and "symbol" in plan.split("PartitionFilters:")[1].split("]")[0] and "GreaterThanOrEqual(hour" in plan
    read = spark.read.parquet(root).where("tf = 1 AND symbol IN ('a', 'c')").select("*", F.input_file_name().alias("f"))
    assert {r.f.split("/bars/")[1].split("/batch=")[0] for r in read.collect()} == {"tf=1/symbol=a", "tf=1/symbol=c"}
    assert {r.symbol: r.hour for r in store.newest(spark, root, 1).collect()} == {s: max(h for t, h, *_ in want if t == s) for s in "abc"}


def test_order_books_keep_the_best_prices_and_take_empty_sides(spark):
    rng = np.random.default_rng(3)
    rows = [(1, bool(rng.random() < 0.5), float(rng.integers(1, 60)), float(rng.integers(1, 9))) for _ in range(400)] + [(2, True, 5.0, 2.0), (3, False, 7.0, 3.0), (3, False, 7.0, 1.0), (3, False, 6.0, 1.0)]
    books = {r.book: r for r in store.order_book(spark.createDataFrame(rows, "book int, is_bid boolean, price double, size double").repartition(4), "book", 5).collect()}
    for side, sign, name in ((True, -1, "bids"), (False, 1, "asks")):
        levels = {}
        for b, is_bid, price, size in rows:
            if b == 1 and is_bid == side:
                levels[price] = levels.get(price, 0) + size
        assert [tuple(x) for x in books[1][name]] == sorted(levels.items(), key=lambda x: sign * x[0])[:5]
    assert books[2].asks == [] and [tuple(x) for x in books[3].asks] == [(6.0, 1.0), (7.0, 4.0)] and books[3].bids == []
    summary = {r.book: r for r in store.book_summary(spark.createDataFrame([(2, [(5.0, 2.0)], []), (4, [(10.0, 1.0), (9.0, 1.0)], [(10.5, 2.0)])], "book int, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>"), "book").collect()}
    assert (summary[2].bid_volume, summary[2].ask_volume, summary[2].spread_bps) == (2.0, 0.0, None)
    assert summary[4].spread_bps == pytest.approx(500.0) and summary[4].bid_volume == 2.0


def test_rows_of_the_gate_wait_by_hour_in_parts(spark, tmp_path, monkeypatch):
    """A batch leaves Python seven rows at a time, so hours wait in several parts, which go through in the order of time."""
    monkeypatch.setattr(state, "WAITING_ROWS", 7)
    rng = np.random.default_rng(4)
    rows = [(str(rng.choice(["a", "b"])), int(m), float(rng.normal(30 if m % 1440 > 900 else 60, 60))) for m in sorted(rng.permutation(2000)[:500])]
    source, at = str(tmp_path / "in"), str(tmp_path / "gate")
    events(spark, [rows[j] for j in rng.permutation(len(rows))]).coalesce(1).write.parquet(source)
    state.run_risk_gate(spark.readStream.schema("event_id long, event_type string, value double, ts timestamp_ntz").parquet(source), at)
    until = (max(r[1] for r in rows) - 60 * state.DELAY_HOURS) // 60 * 60
    got = {r.symbol: (r.equity, r.broken, r.taken, r.refused) for r in state.latest_of_gate(spark, at).collect()}
    assert got == gate_by_loop(rows, until)
    parts = spark.read.format("statestore").option("stateVarName", "parts").load(f"{at}/progress").selectExpr("value.n AS n").collect()
    assert len(parts) == 2 and all(r.n > 20 for r in parts)
