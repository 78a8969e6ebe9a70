"""Ranks of bandwidths that are equal but for their last bits, against exact fractions."""

import datetime as dt
from fractions import Fraction

import numpy as np
import pandas as pd
from barlab.plans import frame, registry

BEGIN = dt.datetime(2024, 1, 1)


def exact_ranks(cents):
    """100 x the share of the last 99 rows whose bandwidth is smaller, by row; its square in whole numbers, as prices are cents."""
    width = [None] * len(cents)
    for i in range(19, len(cents)):
        w = cents[i - 19 : i + 1]
        width[i] = Fraction(20 * sum(x * x for x in w) - sum(w) ** 2, sum(w) ** 2)
    out = []
    for i, now in enumerate(width):
        seen = [x for x in width[max(0, i - 99) : i + 1] if x is not None]
        out.append(None if now is None or len(seen) < 20 else 100 * sum(x < now for x in seen) / min(i, 99))
    return out


def test_ranks_of_prices_that_repeat_are_exact(spark):
    rng = np.random.default_rng(5)
    cents = {s: [int(x) for x in rng.choice(prices, 400)] for s, prices in (("a", [110, 230, 370, 490, 530, 610]), ("b", [110, 230]), ("c", [5855, 5855, 5912, 3070]))}
    rows = [pd.DataFrame({"symbol": s, "hour": range(400), "close": [x / 100 for x in c]}) for s, c in cents.items()]
    bars = spark.createDataFrame(pd.concat(rows)).selectExpr("symbol", "hour", "close AS open", "close AS high", "close AS low", "close", "1D AS volume")
    got = {(r.symbol, r.hour): r.bb_bw_percentile for r in frame.bounded(bars).collect()}
    wrong = [(s, i) for s, c in cents.items() for i, x in enumerate(exact_ranks(c)) if (x is None) != (got[s, i] is None) or x is not None and abs(x - got[s, i]) > 1e-9]
    assert wrong == []


def test_no_bandwidth_of_a_snapshot_is_below_its_equals(spark, tmp_path):
    """Prices repeat every twenty bars, so each window holds the same prices and all bandwidths are equal."""
    prices = [round(3 + 7.7 * (i * 7 % 20) ** 0.5, 2) for i in range(20)]
    rows = [(i, BEGIN + dt.timedelta(hours=4 * i), 7, "a", prices[i % 20], '{"k": 1}') for i in range(150)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "events.parquet")
    got = [r.bb_bw_percentile for r in registry.QUERIES["s09_snapshot_by_user"](spark, str(tmp_path)).sort("hour").collect()]
    assert got == [None] * 38 + [0.0] * 112
