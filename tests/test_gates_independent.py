"""Gates, fitness and books worked out again from trades, curves and prices with pandas."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from barlab.plans import gates, registry
from barlab.plans.relations import Tables


@pytest.fixture(scope="module")
def told(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return {n: t.get(n).toPandas() for n in ("taken", "marked", "judged", "fit", "scored", "configs", "b")}


def sharpe(r):
    return float(np.mean(r) / np.std(r, ddof=1)) if len(r) > 1 and np.std(r, ddof=1) > 0 else 0.0


def test_judged_figures_equal_pandas(told):
    last = told["b"].groupby("symbol").hour.max()
    trials = len(told["configs"])
    for j in told["judged"].itertuples():
        own = told["taken"][(told["taken"].symbol == j.symbol) & (told["taken"].entry_hour >= last[j.symbol] - 240)]
        base, stress = own[own.cfg == "base"], own[own.cfg == "stress"]
        assert j.n == len(base) and j.net == pytest.approx(base.net.sum(), abs=1e-9) and (not len(stress) or j.stress_net == pytest.approx(stress.net.sum(), abs=1e-9))
        won, lost = base.net[base.net > 0].sum(), -base.net[base.net <= 0].sum()
        assert j.pf == pytest.approx(won / lost if lost > 0 else 999 if won > 0 else 0)
        curve = told["marked"][(told["marked"].symbol == j.symbol) & (told["marked"].cfg == "base")].sort_values("hour")
        sealed = curve[curve.segment == "sealed"].r.dropna()
        assert j.sr == pytest.approx(sharpe(sealed) * math.sqrt(8760), rel=1e-6, abs=1e-9)
        assert j.dd == pytest.approx(100 * (1 - curve.equity / curve.equity.cummax()).max()) and j.trials == trials
        r = base.ret.to_numpy(float)
        if len(r) > 4:
            z, sd = r - r.mean(), r.std()
            skew, kurt, per = (z**3).mean() / sd**3, (z**4).mean() / sd**4, sharpe(r)
            assert (j.per_trade, j.skew, j.kurt) == pytest.approx((per, skew, kurt), rel=1e-6)
            inverse, e = NormalDist().inv_cdf, 0.5772156649015329
            star = 1 / math.sqrt(len(r)) * ((1 - e) * inverse(1 - 1 / trials) + e * inverse(1 - 1 / (trials * math.e)))
            assert j.star == pytest.approx(star, rel=1e-6)
            dsr = NormalDist().cdf((per - star) * math.sqrt(len(r) - 1) / math.sqrt(1 - skew * per + (kurt - 1) / 4 * per**2))
            assert j.dsr == pytest.approx(dsr, abs=1e-6) and j.tstat == pytest.approx(per * math.sqrt(len(r)), rel=1e-6)


def test_gates_and_score_follow_from_the_figures(spark, sf_dir, told):
    limits = gates.LIMITS
    rows = {(r.symbol, r.gate): r for r in registry.QUERIES["c10_scorecard_gates"](spark, sf_dir).collect()}
    plain = {
        "g01": lambda j: not j.ruined and j.sr >= limits["g01_sharpe"] and j.pf >= limits["g01_profit_factor"] and j.n >= limits["g01_trades"] and j.net > limits["g01_net"],
        "g02": lambda j: j.sr_is > 0 and 1 - j.sr / j.sr_is <= limits["g02_degradation"] and j.sr > 0, "g03": lambda j: j.n >= 4 and j.dsr >= limits["g03_dsr"], "g04": lambda j: not j.ruined and j.dd <= limits["g04_drawdown_pct"],
        "g07": lambda j: j.n >= limits["g07_trades"] and j.p_ruin <= limits["g07_ruin"] and j.p_profit >= limits["g07_profit"], "g10": lambda j: j.n >= limits["g10_trades"] and j.tstat >= limits["g10_tstat"],
    }
    for j in told["judged"].itertuples():
        for g, rule in plain.items():
            assert rows[j.symbol, g].passed == bool(rule(j)), (j.symbol, g)
    for r in registry.QUERIES["a32_scorecard"](spark, sf_dir).collect():
        own = [x for (s, _), x in rows.items() if s == r.symbol]
        score = sum(x.weight * max(-1, min(1, x.margin)) if x.passed else -2 * x.weight if x.mandatory else 0 for x in own)
        assert r.n_passed == sum(x.passed for x in own) and r.score == pytest.approx(score, abs=1e-3)


def test_share_of_profitable_resamplings_is_near_the_normal_one(told):
    """With independent draws the share of totals above 0 follows from mean and spread of the sealed trades; 200 draws leave some noise."""
    last = told["b"].groupby("symbol").hour.max()
    for j in told["judged"].itertuples():
        net = told["taken"].query("symbol == @j.symbol and cfg == 'base'")
        net = net[net.entry_hour >= last[j.symbol] - 240].net.to_numpy(float)
        if len(net) >= 12 and net.std() > 0:
            assert j.p_profit == pytest.approx(NormalDist().cdf(net.mean() * math.sqrt(len(net)) / net.std()), abs=0.15)


def test_fitness_equals_pandas(told):
    fit = told["fit"]
    for s in told["scored"].itertuples():
        median = fit[(fit.cfg == s.cfg) & (fit.symbol != s.symbol)].train.median()
        degradation = 100 if s.train <= 0 else max(0, (s.train - s.val) / abs(s.train) * 100)
        want = 0.5 * s.train + 0.3 * s.val + 0.1 * math.log(max(s.n, 1)) + 0.25 * max(-1, min(1, median)) - 0.02 * max(0, degradation - 30) - 0.1 * max(0, s.dd - 5) - 0.05 * max(0, 30 - s.n) - (0.3 if median <= 0 else 0)
        assert s.fitness == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_books_hold_the_best_and_the_worst(spark, sf_dir):
    book = registry.QUERIES["x07_long_short_book"](spark, sf_dir).toPandas()
    scores = registry.QUERIES["x05_zscore"](spark, sf_dir).toPandas()
    weight = next(c for c in book.columns if c not in ("asset", "day"))
    score = next(c for c in scores.columns if c not in ("asset", "day"))
    both = book.merge(scores, on=["asset", "day"])
    seen = 0
    for _, day in both.groupby("day"):
        long, short = day[pd.to_numeric(day[weight]) > 0], day[pd.to_numeric(day[weight]) < 0]
        rest = scores[(scores.day == day.day.iloc[0]) & ~scores.asset.isin(day[pd.to_numeric(day[weight]) != 0].asset)][score].dropna()
        if len(long) and len(short):
            seen += 1
            assert len(long) == len(short) and long[score].min() >= short[score].max() - 1e-6
            assert rest.empty or (long[score].min() >= rest.max() - 1e-6 and short[score].max() <= rest.min() + 1e-6)
    assert seen > 10
