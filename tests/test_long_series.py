"""Chunked series, islands, choices and draws against plain loops, where series are long, sparse or hot."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.functions import series
from barlab.functions.dialect import draw, duck_text, spark_text
from barlab.operators.joins import asof, next_at_or_after
from barlab.operators.ledger import held_bars, one_at_a_time
from barlab.operators.selection import distinct_best


def sparse(spark, rows=2000, gap=0):
    """One row a chunk, then a gap, then as many again."""
    hours = [i * series.CHUNK + 3 for i in range(rows)] + [(rows + gap + i) * series.CHUNK for i in range(20)]
    x = np.random.default_rng(1).random(len(hours))
    return hours, x, spark.createDataFrame(list(zip(["s"] * len(hours), hours, x.tolist(), strict=True)), "symbol string, hour long, x double")


@pytest.mark.parametrize("gap", [0, 2000])
def test_averages_are_carried_over_any_number_of_chunks(spark, gap):
    hours, x, df = sparse(spark, 2000, gap)
    got = series.ewms(df, {"slow": ("x", 0.002, 0), "fast": ("x", 0.3, 5)}).orderBy("hour").collect()
    slow, fast = [x[0]], [x[0]]
    for v in x[1:]:
        slow.append(0.998 * slow[-1] + 0.002 * v)
        fast.append(0.7 * fast[-1] + 0.3 * v)
    assert [r.slow for r in got] == pytest.approx(slow, rel=1e-9)
    assert [r.fast for r in got][:4] == [None] * 4 and [r.fast for r in got][4:] == pytest.approx(fast[4:], rel=1e-9)


def test_a_held_value_survives_two_thousand_flat_chunks(spark):
    hours = [0, 1, 2] + [i * series.CHUNK for i in range(1, 2100)]
    values = [5.0, 7.0, 6.0] + [None] * 2099
    df = spark.createDataFrame(list(zip(["s"] * len(hours), hours, values, strict=True)), "symbol string, hour long, v double")
    got = series.ewm_gaps(series.indexed(df), "v", 0.5, "y").orderBy("hour").collect()
    assert got[2].y == pytest.approx(got[-1].y) and got[-1].y > 5
    total = series.scan(df.withColumn("b", F.coalesce("v", F.lit(0.0))), "1D", "b", "t").orderBy("hour").collect()
    assert total[-1].t == pytest.approx(18.0)


def test_running_values_and_previous_rows_equal_pandas(spark):
    rng = np.random.default_rng(2)
    rows = [(k, c, int(h), None if rng.random() < 0.3 else float(rng.normal())) for k, c in (("a", "x"), ("a", "y"), ("b", "x")) for h in rng.choice(5000, 300, replace=False)]
    df = spark.createDataFrame(rows, "symbol string, cfg string, hour long, v double")
    key = ["symbol", "cfg"]
    outs = {"total": ("sum", "v"), "top": ("max", "v"), "low": ("min", "v"), "held": ("last", "v")}
    p = pd.DataFrame(rows, columns=[*key, "hour", "v"]).sort_values([*key, "hour"]).reset_index(drop=True)
    g = p.groupby(key)["v"]
    want = {"total": g.transform(lambda v: v.fillna(0).cumsum()), "top": g.cummax().groupby([p.symbol, p.cfg]).ffill(), "low": g.cummin().groupby([p.symbol, p.cfg]).ffill(), "held": g.ffill()}
    got = series.previous(series.running(df, outs, key, "hour"), {"before": "v"}, key, "hour").orderBy(*key, "hour").toPandas()
    for c, w in want.items():
        assert np.allclose(got[c].astype(float), w, equal_nan=True), c
    assert np.allclose(got["before"].astype(float), g.shift(1), equal_nan=True)
    back = series.running(df, {"next": ("last", "v")}, key, "hour", backwards=True).orderBy(*key, "hour").toPandas()
    assert np.allclose(back["next"].astype(float), g.bfill(), equal_nan=True)
    out = series.running(df, {"n": ("sum", "1L")}, key, "hour", exclusive=True).orderBy(*key, "hour").toPandas()
    assert (out["n"] == p.groupby(key).cumcount()).all()


def test_as_of_joins_equal_a_plain_search(spark):
    rng = np.random.default_rng(3)
    left = [(s, int(t)) for s in "ab" for t in rng.integers(0, 4000, 200)]
    right = [(s, int(t), float(v)) for s in "ab" for t, v in zip(rng.choice(4000, 40, replace=False), rng.normal(size=40), strict=True)]
    lf, rf = spark.createDataFrame(left, "symbol string, t long"), spark.createDataFrame(right, "symbol string, u long, v double")
    for r in asof(lf, rf, "symbol", "t", "u", "v", -9.0).collect():
        known = [(u, v) for s, u, v in right if s == r.symbol and u <= r.t]
        assert r.v == (max(known)[1] if known else -9.0)
    found = next_at_or_after(lf, rf, ["symbol"], "t", "u", ["u", "v"], "nxt").collect()
    assert len(found) == len(left)
    for r in found:
        ahead = [(u, v) for s, u, v in right if s == r.symbol and u >= r.t]
        assert (r.nxt and tuple(r.nxt)) == (min(ahead) if ahead else None)


def taken_by_loop(rows):
    out, free = [], {}
    for s, a, b in sorted(rows):
        if a >= free.get(s, -1):
            out.append((s, a, b))
            free[s] = b
    return out


@pytest.mark.parametrize("fold_rows", [1, 4, 2048])
def test_islands_of_any_size_equal_a_plain_loop(spark, fold_rows):
    rng = np.random.default_rng(4)
    rows = []
    for s, hold in (("dense", 30), ("loose", 3), ("bridged", 400)):
        rows += [(s, int(a), int(a + rng.integers(1, hold))) for a in rng.choice(4000, 700, replace=False)]
    trades = spark.createDataFrame(rows, "symbol string, entry_hour long, exit_hour long").withColumn("cfg", F.lit("c"))
    got = sorted(tuple(r) for r in one_at_a_time(trades, fold_rows).select("symbol", "entry_hour", "exit_hour").collect())
    assert got == taken_by_loop(rows)


def test_one_island_of_many_trades_is_not_gathered(spark):
    n = 60_000
    trades = spark.range(n).selectExpr("'s' AS symbol", "'c' AS cfg", "id AS entry_hour", "id + 2 + id % 3 AS exit_hour")
    got = [r.entry_hour for r in one_at_a_time(trades).select("entry_hour").orderBy("entry_hour").collect()]
    assert got == [a for _, a, _ in taken_by_loop([("s", i, i + 2 + i % 3) for i in range(n)])]


def test_held_bars_equal_a_plain_join(spark):
    rng = np.random.default_rng(5)
    trades = [("s", int(a), int(a + rng.integers(0, 120))) for a in rng.integers(0, 600, 60)]
    hours = sorted(rng.choice(700, 400, replace=False).tolist())
    bars = spark.createDataFrame([("s", h, 1.0, 1.0, 1.0) for h in hours], "symbol string, hour long, close double, high double, low double")
    t = spark.createDataFrame(trades, "symbol string, entry_hour long, exit_hour long")
    for last in (False, True):
        got = sorted((r.entry_hour, r.exit_hour, r.p_hour) for r in held_bars(t, bars, 49, last).collect())
        assert got == sorted((a, b, h) for _, a, b in trades for h in hours if a <= h < min(b + last, a + 49))


def kept_by_loop(rows, apart):
    out = []
    for r in sorted(rows, key=lambda r: (-round(r[3], 9), r[4])):
        if all((abs(r[1] - k[1]) / 10 + abs(r[2] - k[2]) / 4) / 2 >= apart for k in out if k[0] == r[0]):
            out.append(r)
    return sorted(out)


@pytest.mark.parametrize(("n", "batch"), [(0, 8), (300, 8), (3000, 256)])
def test_choice_of_rows_apart_equals_a_plain_loop(spark, n, batch):
    rng = np.random.default_rng(6)
    rows = [(f"s{rng.integers(0, 3)}", float(rng.random() * 10), float(rng.integers(0, 5)), float(np.round(rng.random(), 2)), f"{i:05d}") for i in range(n)]
    df = spark.createDataFrame(rows, "strategy string, a double, b double, fitness double, name string")
    got = sorted(map(tuple, distinct_best(df, "strategy", {"a": (0, 10), "b": (0, 4)}, "fitness", "name", 0.15, batch).collect()))
    assert got == kept_by_loop(rows, 0.15)


def test_choice_of_a_hundred_thousand_rows(spark):
    df = spark.range(100_000).selectExpr("'s' AS strategy", "rand(7) * 10 AS a", "rand(8) * 4 AS b", "round(rand(9), 6) AS fitness", "cast(id AS string) AS name").cache()
    rows = sorted(map(tuple, df.collect()), key=lambda r: (-r[3], r[4]))
    out, at = [], np.zeros((0, 2))
    for r in rows:
        p = np.array([r[1] / 10, r[2] / 4])
        if not len(at) or np.abs(at - p).mean(1).min() >= 0.15:
            out.append(r)
            at = np.vstack([at, p])
    got = sorted(map(tuple, distinct_best(df, "strategy", {"a": (0, 10), "b": (0, 4)}, "fitness", "name").collect()))
    assert got == sorted(out)
    df.unpersist()


@pytest.mark.parametrize("n", [50, 200, 1000])
def test_resampled_totals_spread_as_those_of_numpy(spark, n):
    """Standard deviation of totals drawn with replacement, within five percent of independent draws'; neighbouring draws do not go together."""
    rng = np.random.default_rng(n)
    values, sims = rng.normal(size=n), 3000
    drawn = spark.range(sims).selectExpr("id AS i", f"explode(sequence(0, {n - 1})) AS pos").selectExpr("i", "pos", spark_text(f"{draw(7, repr('s'), 'i', 'pos')} AS u"))
    u = drawn.orderBy("i", "pos").select("u").toPandas()["u"].to_numpy().reshape(sims, n)
    totals = values[np.floor(u * n).astype(int)].sum(1)
    independent = values[rng.integers(0, n, (sims, n))].sum(1)
    assert totals.std() == pytest.approx(math.sqrt(n) * values.std(), rel=0.05) and totals.std() == pytest.approx(independent.std(), rel=0.08)
    assert abs(totals.mean() - n * values.mean()) < 4 * totals.std() / math.sqrt(sims)
    flat = u.ravel()
    assert abs(np.corrcoef(flat[:-1], flat[1:])[0, 1]) < 0.02 and np.unique(np.round(np.diff(u[0]), 6)).size > 0.9 * (n - 1)
    assert np.abs(np.sort(flat[:20_000]) - np.linspace(0, 1, 20_000)).max() < 0.02


def test_draws_are_the_same_in_both_dialects(spark):
    import duckdb

    text = f"SELECT i, {draw(3, 'i', repr('x'))} AS u FROM n"
    spark.range(200).toDF("i").createOrReplaceTempView("n")
    got = sorted(map(tuple, spark.sql(spark_text(text)).collect()))
    want = sorted(duckdb.connect().execute(duck_text(text.replace("FROM n", "FROM (SELECT unnest(range(200)) AS i) n"))).fetchall())
    assert got == want
    spark.catalog.dropTempView("n")


def test_folds_go_to_the_end_of_the_series(spark, tmp_path):
    """2,300 hours make 51 folds; every row but those behind the last whole fold lies in one."""
    from barlab.plans import registry

    hours = 2300
    spark.range(hours).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id AS int)) AS ts", "id % 7 AS user_id", "'view' AS event_type", "10 + id % 13 + id / 100D AS value", "'{}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    got = registry.QUERIES["p08_label_folds"](spark, str(tmp_path)).collect()
    assert {r.fold for r in got} == set(range((hours - 300) // 40 + 1)) and {(r.role, r.bars) for r in got} == {("train", 200), ("val", 60), ("test", 40)}


def test_flat_and_bisecting_clusters_equal_plain_loops(spark):
    from barlab.operators import clusters

    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 200, (70, 6)) for c in (-2000, 0, 1500)]).round()
    order = rng.permutation(len(x))
    grp = rng.integers(0, 2, len(x))
    rows = spark.createDataFrame([(int(grp[i]), f"{order[i]:04d}", [int(v) for v in x[i]]) for i in range(len(x))], "grp int, o string, q array<long>").repartition(5)

    def lloyd(own, k, rounds):
        own = own[np.argsort(order[own], kind="stable")]
        c = x[own[:k]].copy()
        for _ in range(rounds):
            near = ((x[own][:, None] - c[None]) ** 2).sum(2).argmin(1)
            for j in np.unique(near):
                c[j] = x[own[near == j]].sum(0) // (near == j).sum()
        return c

    got = clusters.fit(rows, 4, 5)
    assert sorted(got) == [0, 1]
    for g in got:
        assert (got[g] == lloyd(np.flatnonzero(grp == g), 4, 5)).all()
    leaf, n = np.zeros(len(x), int), 1
    while n < 6:
        sizes = np.bincount(leaf, minlength=n)
        chosen = sorted((j for j in range(n) if sizes[j] >= 2), key=lambda j: (-sizes[j], j))[: min(n, 6 - n)]
        for i, j in enumerate(chosen):
            own = np.flatnonzero(leaf == j)
            c = lloyd(own, 2, 3)
            leaf[own[((x[own][:, None] - c[None]) ** 2).sum(2).argmin(1) == 1]] = n + i
        n += min(n, 6 - n)
    want = np.array([x[leaf == j].sum(0) // (leaf == j).sum() for j in np.unique(leaf)])
    assert (clusters.bisected(rows, 6) == want).all()
    table = clusters.as_table(spark, got)
    back = clusters.from_table(table.repartition(3))
    labels = clusters.assigned(rows, back, ["o"], 4).collect()
    macro = np.array([got[g].sum(0) // 4 for g in (0, 1)])
    by_order = {f"{order[i]:04d}": x[i] for i in range(len(x))}
    for r in labels:
        g = int(((macro - by_order[r.o]) ** 2).sum(1).argmin())
        assert r.cluster == g * 4 + int(((got[g] - by_order[r.o]) ** 2).sum(1).argmin())


def test_risk_rules_equal_a_plain_loop(spark):
    """Many trades a day, over midnight, with falls that trip the breaker in one key and not in the other."""
    from barlab.operators.ledger import RULES, gated, sized

    rng = np.random.default_rng(8)
    rows = []
    for key, drift in (("up", 0.06), ("down", -0.03)):
        hour = 0
        for _ in range(400):
            hour += int(rng.choice([0, 1, 2, 5, 30]))
            end = hour + int(rng.integers(1, 5))
            rows.append((key, "c", hour, end, float(rng.random() * 2), 100.0, float(rng.normal(drift, 0.12))))
            hour = end
    t = spark.createDataFrame(rows, "symbol string, cfg string, entry_hour long, exit_hour long, atr double, fill double, ret double")
    r, want = RULES, {}
    for key in ("up", "down"):
        equity = peak = r["capital"]
        day, lost, last, broken, losses = -1, 0.0, None, False, 0
        for _, _, a, b, atr, fill, ret in (x for x in rows if x[0] == key):
            if a // 24 > day:
                day, lost = a // 24, 0.0
            broken = broken or (peak - equity) / peak * 100 >= r["breaker_pct"]
            verdict = "circuit_breaker" if broken else "daily_loss_limit" if lost < 0 and -lost / equity * 100 >= r["daily_pct"] else "min_interval" if last is not None and a - last < r["hours_between"] else "approved"
            size, start = min(r["cap"], r["target_vol"] / max(atr / fill * 365**0.5, 0.01)), equity
            if verdict == "approved":
                pnl = size * equity * ret
                equity, lost, last = equity + pnl, lost + pnl, b
                peak, losses = max(peak, equity), losses + 1 if pnl < 0 else 0
            want[key, a] = (verdict, start * size, equity, losses)
    got = {(x.symbol, x.entry_hour): x for x in sized(t).collect()}
    assert got.keys() == want.keys() and {v[0] for v in want.values()} == {"approved", "daily_loss_limit", "min_interval", "circuit_breaker"}
    for k, (verdict, size, equity, losses) in want.items():
        assert (got[k].verdict, got[k].losses) == (verdict, losses) and got[k].size_volatility == pytest.approx(size) and got[k].equity == pytest.approx(equity)
    plain = t.selectExpr("symbol", "entry_hour", "exit_hour", "1 AS side", "100 * ret AS net")
    kept = sorted((x.symbol, x.entry_hour) for x in gated(plain, 100.0, 0.2, 6.0, 3).collect())
    out = []
    for key in ("up", "down"):
        equity = peak = 100.0
        day, lost, last = -1, 0.0, -(10**6)
        for _, _, a, _, _, _, ret in (x for x in rows if x[0] == key):
            lost = lost if a // 24 == day else 0.0
            if equity > peak * 0.8 and lost > -6.0 and a - last >= 3:
                out.append((key, a))
                equity, day, lost, last = equity + 100 * ret, a // 24, lost + 100 * ret, a
                peak = max(peak, equity)
    assert kept == sorted(out) and 0 < len(out) < len(rows)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles_equal_numpy(spark, accuracy):
    from barlab.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(9)
    groups = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 3, 2000).astype(float), "spread": np.exp(rng.normal(0, 40, 1500)), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "flat": np.full(900, 7.0)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("nulls", None), ("two", None)]
    ps = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(6), ["g"], "v", ps, accuracy).collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        assert got[g].n == len(x) and got[g].q == pytest.approx(np.quantile(x, ps).tolist(), rel=1e-12)


def test_sums_of_a_round_equal_plain_sums_and_leave_out_rows_without_a_group(spark):
    from barlab.operators import clusters

    rows = [(g, f"{i:02}", [i, -i]) for i, g in enumerate([0, 2, -1, 0, 1, 2, -1, 0])]
    place = lambda x, grp: (grp.astype("int64"), (x[:, 0] % 2).astype("int64"))
    found = clusters._summed(spark.createDataFrame(rows, "grp int, o string, q array<long>").repartition(3), place)
    want: dict = {}
    for g, _, (a, b) in rows:
        if g >= 0:
            n, s, t = want.get((g, a % 2), (0, 0, 0))
            want[g, a % 2] = (n + 1, s + a, t + b)
    assert [(r["grp"], r["entry"], r["n"], r["sums"]) for r in found] == [(g, e, n, [s, t]) for (g, e), (n, s, t) in sorted(want.items())]
