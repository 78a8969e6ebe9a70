import numpy as np
import pytest
from barlab.plans import registry
from oracle import differences


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(spark, sf_dir, registry.QUERIES[name], registry.SQL[name]) == []


def test_non_overlapping_trades_equal_a_plain_loop(spark, sf_dir):
    every = sorted(tuple(r) for r in registry.candidates(spark, sf_dir).select("symbol", "entry_hour", "exit_hour").collect())
    want, free = [], {}
    for s, a, b in every:
        if a >= free.get(s, -1):
            want.append((s, a, b))
            free[s] = b
    got = sorted(tuple(r) for r in registry.QUERIES["t09_non_overlap"](spark, sf_dir).select("symbol", "entry_hour", "exit_hour").collect())
    assert got == want and len(want) > 5


def test_risk_gate_equals_a_plain_loop(spark, sf_dir):
    from barlab.operators.trades import non_overlapping, risk_gate

    trades = non_overlapping(registry.candidates(spark, sf_dir)).select("symbol", "entry_hour", "exit_hour", "side", "net")
    every = sorted(tuple(r) for r in trades.collect())
    want, state = [], {}
    for s, a, b, side, net in every:
        equity, peak, day, lost, last = state.get(s, (100.0, 100.0, None, 0.0, -(10**6)))
        lost = lost if a // 24 == day else 0.0
        if equity > peak * 0.8 and lost > -5.0 and a - last >= 12:
            want.append((s, a, b, side))
            state[s] = (equity + net, max(peak, equity + net), a // 24, lost + net, a)
    got = sorted(tuple(r) for r in risk_gate(trades, 100.0, hours_between=12).select("symbol", "entry_hour", "exit_hour", "side").collect())
    assert got == want and 0 < len(want) < len(every)


def test_features_do_not_look_ahead(spark, sf_dir):
    from barlab.functions.features import FEATURES
    from barlab.functions.layers import add_layers
    from barlab.sources.bars import bars

    layers, out = FEATURES["w14_volume"]
    b = bars(spark, sf_dir)
    cut = b.selectExpr("percentile(hour, 0.6)").first()[0]
    whole = add_layers(b, layers).where(f"hour < {cut}").select("symbol", "hour", *out)
    short = add_layers(b.where(f"hour < {cut}"), layers).select("symbol", "hour", *out)
    assert whole.exceptAll(short).count() == 0


def test_flagship_has_a_row_per_symbol(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).count() == 5


def test_clusters_are_in_range_and_a_saved_model_says_the_same(spark, sf_dir):
    """The labels of m04 are the nearest centroids of the saved table, by a plain search; m12 tells of that table."""
    from barlab.plans.patterns import TWO, VARIANTS
    from barlab.plans.relations import Tables

    t = Tables(spark, sf_dir)
    saved = sorted(tuple(r) for r in t.get("book_flat_8").select("entry", "q").collect())
    labels = {(r.symbol, r.hour): r.cluster for r in registry.QUERIES["m04_kmeans"](spark, sf_dir).collect()}
    rows = t.get("scaled_windows").select("symbol", "hour", "q").collect()
    assert len(labels) == len(rows) == t.get("windows").count() and len(saved) == 8
    centroids = np.array([q for _, q in saved], dtype=np.int64)
    for r in rows:
        assert labels[r.symbol, r.hour] == saved[int(((centroids - np.array(r.q, dtype=np.int64)) ** 2).sum(1).argmin())][0]
    told = {r.entry: (r.dims, r.first_close, r.last_return, r.total) for r in registry.QUERIES["m12_saved_model"](spark, sf_dir).collect()}
    assert told == {e: (len(q), q[3], q[99], sum(q)) for e, q in saved}
    for name, variant in (("m04_kmeans", "flat_8"), ("m05_bisecting", "bisecting_20"), ("m06_two_levels", TWO)):
        low, high = registry.QUERIES[name](spark, sf_dir).selectExpr("min(cluster)", "max(cluster)").first()
        assert low >= 0 and high < VARIANTS[variant][0]
