"""The last line item of a cell is found without sorting all items."""

import datetime as dt

import numpy as np
from barlab.plans.portfolio import last_of_cells

BEGIN = dt.date(1995, 1, 1)


def test_last_items_equal_a_plain_search_and_only_the_newest_orders_are_sorted(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(int(x) for x in (rng.integers(0, 40), rng.integers(1, 5), rng.integers(0, 30), rng.integers(0, 20))) + (float(rng.integers(1, 9)), float(rng.integers(1, 99)), int(rng.integers(0, 3))) for _ in range(3000)]
    items = spark.createDataFrame([(o, n, p, s, q, e, BEGIN + dt.timedelta(days=d)) for o, n, p, s, q, e, d in rows], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate date")
    want = {}
    for o, n, p, s, q, e, d in rows:
        cell = ("reference" if n % 2 else "second", s % 10, (BEGIN - dt.date(1970, 1, 1)).days + d)
        want[cell] = max(want.get(cell, ()), (o, n, p, e, q))
    last = last_of_cells(items.repartition(4))
    got = {(r.venue, r.asset, r.day): (tuple(r.last.ord), r.last.price) for r in last.collect()}
    assert got == {c: (x, x[3] / x[4]) for c, x in want.items()} and len(got) == 60
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan.split("SortAggregate")[-1] and "HashAggregate" in plan
