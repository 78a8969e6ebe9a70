"""The scorecard: eleven gates on every candidate, verdicts, fitness and rankings, as queries over the ledger.

A candidate is a symbol with the base configuration; its in-sample trades are those before the sealed part of ten days.
Thresholds, weights and mandatory flags are rows of `limits` and `spec`. Counts of trades and periods are lower than a
market's, as the given events span a month; periods are weeks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from barlab.functions.dialect import draw
from barlab.operators.selection import distinct_best
from barlab.plans.relations import Tables, computed, derived, query, relation
from barlab.plans.strategies import normal_cdf
from barlab.sources.shared import shared_folder, written

#: Coefficients of the inverse normal distribution function (Acklam's rational approximation; fixed values).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_LOW = 0.02425
EULER = 0.5772156649015329


def _poly(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"({coefficients[0]!r}e0)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}e0))"
    return out.replace("e-05e0", "e-05").replace("e-03e0", "e-03")


def normal_ppf(p: str) -> str:
    """The inverse of the normal distribution function for 0 < p < 1."""
    tail = "sqrt(-2 * ln({}))"
    low, high = tail.format(p), tail.format(f"(1 - {p})")
    mid = f"({p} - 0.5)"
    square = f"({mid} * {mid})"
    return f"(CASE WHEN {p} < {_LOW} THEN {_poly(low, _C)} / {_poly(low, (*_D, 1.0))} WHEN {p} <= {1 - _LOW} THEN {_poly(square, _A)} * {mid} / {_poly(square, (*_B, 1.0))} ELSE -{_poly(high, _C)} / {_poly(high, (*_D, 1.0))} END)"


def expected_best(trials: str, spread: str) -> str:
    """The best Sharpe ratio to expect of independent trials without skill."""
    n = f"greatest({trials}, 2)"
    first, second = normal_ppf(f"(1 - 1e0 / {n})"), normal_ppf(f"(1 - 1e0 / ({n} * exp(1e0)))")
    return f"(greatest({spread}, 1e-9) * ({1 - EULER!r} * {first} + {EULER!r} * {second}))"


LIMITS = {
    "g01_sharpe": 0.8, "g01_profit_factor": 1.2, "g01_trades": 4, "g01_net": 0.0, "g02_degradation": 0.5, "g03_dsr": 0.95, "g04_drawdown_pct": 25.0, "g05_sharpe": 0.3, "g05_profit_factor": 1.05, "g06_sharpe": 0.5, "g06_degradation": 0.6,
    "g07_ruin": 0.05, "g07_profit": 0.85, "g07_trades": 4, "g08_assets": 2, "g08_sharpe": 0.0, "g09_fraction": 0.6, "g09_sharpe": 0.3, "g10_tstat": 2.0, "g10_trades": 4, "g11_trade": 0.35, "g11_regime": 0.8,
}
SPEC = {"g01": (True, 2.0), "g02": (True, 1.5), "g03": (True, 3.0), "g04": (True, 2.0), "g05": (True, 2.0), "g06": (True, 1.0), "g07": (True, 1.5), "g08": (True, 2.0), "g09": (True, 1.5), "g10": (True, 1.5), "g11": (False, 1.0)}
derived("limits", "SELECT " + ", ".join(f"{float(v)!r}e0 AS {k}" for k, v in LIMITS.items()))
derived("spec", " UNION ALL ".join(f"SELECT '{g}' AS gate, {str(m).lower()} AS mandatory, {w}e0 AS weight" for g, (m, w) in SPEC.items()))
query("c09_trial_count", "SELECT count(*) AS trials, count(DISTINCT cfg) AS configurations FROM (SELECT DISTINCT symbol, cfg FROM {taken})")

# ---------------------------------------------------------------- what gates read

derived("cutoffs", "SELECT symbol, max(hour) - 240 AS cutoff, max_by(close, hour) / min_by(close, hour) - 1 AS held_return FROM {b} GROUP BY symbol")
derived("parted", "SELECT t.*, CASE WHEN entry_hour >= cutoff THEN 'sealed' ELSE 'in_sample' END AS segment FROM {taken} t JOIN {cutoffs} USING (symbol)")
_SUMS = "count(*) AS n, sum(net) AS net, coalesce(sum(CASE WHEN net > 0 THEN net END), 0) AS won, -coalesce(sum(CASE WHEN net <= 0 THEN net END), 0) AS lost, avg(ret) AS m, stddev_samp(ret) AS sd, avg(ret * ret) AS r2, avg(ret * ret * ret) AS r3, avg(ret * ret * ret * ret) AS r4, max(net) AS best, avg(exit_hour - entry_hour) AS hours_held, avg(CASE WHEN net > 0 THEN 1e0 ELSE 0e0 END) AS win_rate"
derived("trade_sums", f"SELECT symbol, cfg, segment, {_SUMS} FROM {{parted}} GROUP BY symbol, cfg, segment")
derived("curve_sums", "SELECT symbol, cfg, segment, coalesce(avg(r) / nullif(stddev_samp(r), 0), 0) * sqrt(8760) AS sharpe FROM {marked} GROUP BY symbol, cfg, segment")
derived("depths", "SELECT symbol, cfg, 100 * max(1 - equity / peak) AS dd, min(equity) <= 0 AS ruined FROM {marked} GROUP BY symbol, cfg")
derived(
    "sums",
    """SELECT c.symbol, c.cfg, c.segment, sharpe, coalesce(n, 0) AS n, coalesce(net, 0) AS net, CASE WHEN lost > 0 THEN won / lost WHEN won > 0 THEN 999e0 ELSE 0e0 END AS pf, m, sd, coalesce(m / nullif(sd, 0), 0) AS per_trade,
    CASE WHEN n < 4 OR r2 - m * m <= 1e-18 THEN 0e0 ELSE (r3 - 3 * m * r2 + 2 * m * m * m) / pow(r2 - m * m, 1.5) END AS skew, CASE WHEN n < 4 OR r2 - m * m <= 1e-18 THEN 3e0 ELSE (r4 - 4 * m * r3 + 6 * m * m * r2 - 3 * m * m * m * m) / pow(r2 - m * m, 2) END AS kurt, best, hours_held, win_rate
    FROM {curve_sums} c LEFT JOIN {trade_sums} t ON t.symbol = c.symbol AND t.cfg = c.cfg AND t.segment = c.segment""",
    write=True,
)
query("a15_referee_metrics", "SELECT symbol, cfg, segment, n, round(net, 6) AS net, round(pf, 6) AS profit_factor, round(sharpe, 5) AS sharpe_annualised, round(per_trade, 6) AS sharpe_per_trade, round(win_rate, 6) AS win_rate, round(hours_held, 6) AS hours_held FROM {sums}")
query("a19_moments", "SELECT symbol, cfg, segment, n, round(skew, 5) AS skew, round(kurt, 5) AS kurt FROM {sums} WHERE n > 0")
derived("entered", "SELECT p.*, coalesce(regime, 'unknown') AS regime FROM {parted} p LEFT JOIN (SELECT symbol AS f_symbol, hour AS f_hour, regime FROM {rg}) ON f_symbol = p.symbol AND f_hour = p.entry_hour")
derived("regimes", "SELECT symbol, segment, regime, sum(net) AS net FROM {entered} WHERE cfg = 'base' GROUP BY symbol, segment, regime")
query("j04_regime_at_entry", "SELECT symbol, cfg, entry_hour, regime FROM {entered} WHERE cfg NOT LIKE 'near%'")
query("a18_pnl_by_regime", "SELECT regime, trades, round(net, 4) AS total, round(net / nullif(whole, 0), 6) AS share FROM (SELECT regime, count(*) AS trades, sum(net) AS net FROM {entered} WHERE cfg = 'base' GROUP BY regime) CROSS JOIN (SELECT sum(net) AS whole FROM {entered} WHERE cfg = 'base')")
query("a37_concentration", "SELECT r.symbol, r.segment, round(max(r.net) / nullif(sum(CASE WHEN r.net > 0 THEN r.net END), 0), 6) AS top_regime, round(max(s.best) / nullif(max(s.net), 0), 6) AS top_trade FROM {regimes} r JOIN {sums} s ON s.symbol = r.symbol AND s.segment = r.segment AND s.cfg = 'base' GROUP BY r.symbol, r.segment")
_DRAW = draw(13, 'symbol', 'i', 'pos')
derived("sealed_results", "SELECT symbol, net, row_number() OVER (PARTITION BY symbol ORDER BY entry_hour) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM {parted} WHERE cfg = 'base' AND segment = 'sealed'")
derived(
    "sealed_runs",
    f"""SELECT symbol, sim, sum(net) AS pnl, max(100 * (peak - equity) / peak) AS dd FROM (SELECT *, greatest(1000e0, max(equity) OVER (PARTITION BY symbol, sim ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM (
      SELECT *, 1000 + sum(net) OVER (PARTITION BY symbol, sim ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM (
        SELECT d.symbol, d.sim, d.slot, r.net FROM (SELECT symbol, i AS sim, pos AS slot, cast(floor({_DRAW} * n) AS bigint) AS draw FROM {{sealed_results}} CROSS JOIN {{numbers}} WHERE i < 200) d JOIN {{sealed_results}} r ON r.symbol = d.symbol AND r.pos = d.draw))) GROUP BY symbol, sim""",
)
_STAR = expected_best("trials", "1 / sqrt(greatest(n, 2))")
_Z = "(per_trade - star) * sqrt(greatest(n - 1, 0)) / sqrt(greatest(1 - skew * per_trade + (kurt - 1) / 4 * per_trade * per_trade, 1e-9))"
derived(
    "judged",
    f"""SELECT *, {normal_cdf('z')} AS dsr, {normal_cdf('z0')} AS psr, per_trade * sqrt(n) AS tstat FROM (SELECT *, {_Z} AS z, {_Z.replace('- star', '')} AS z0 FROM (SELECT *, {_STAR} AS star FROM (
      SELECT s.symbol, s.n, s.net, s.pf, s.sharpe AS sr, s.per_trade, s.skew, s.kurt, s.best, i.sharpe AS sr_is, i.per_trade AS per_trade_is, i.n AS n_is, i.net AS net_is, x.sharpe AS stress_sr, x.pf AS stress_pf, x.net AS stress_net, l.sharpe AS lag0_sr, d.dd, d.ruined, t.trials, h.held_return,
        o.assets, o.median_sr, k.fraction, k.near_sr, mc.p_profit, mc.p_ruin, rg.top_regime
      FROM (SELECT * FROM {{sums}} WHERE cfg = 'base' AND segment = 'sealed') s JOIN (SELECT * FROM {{sums}} WHERE cfg = 'base' AND segment = 'in_sample') i ON i.symbol = s.symbol
      LEFT JOIN (SELECT * FROM {{sums}} WHERE cfg = 'stress' AND segment = 'sealed') x ON x.symbol = s.symbol LEFT JOIN (SELECT * FROM {{sums}} WHERE cfg = 'lag0' AND segment = 'sealed') l ON l.symbol = s.symbol
      LEFT JOIN (SELECT * FROM {{depths}} WHERE cfg = 'base') d ON d.symbol = s.symbol LEFT JOIN {{cutoffs}} h ON h.symbol = s.symbol CROSS JOIN (SELECT count(*) AS trials FROM {{configs}}) t
      LEFT JOIN (SELECT a.symbol, sum(CASE WHEN o.net > 0 AND o.n >= 4 THEN 1 ELSE 0 END) AS assets, median(o.sharpe) AS median_sr FROM {{sums}} a JOIN {{sums}} o ON o.cfg = 'base' AND o.segment = 'sealed' AND o.symbol <> a.symbol WHERE a.cfg = 'base' AND a.segment = 'sealed' GROUP BY a.symbol) o ON o.symbol = s.symbol
      LEFT JOIN (SELECT symbol, avg(CASE WHEN pf > 1 THEN 1e0 ELSE 0e0 END) AS fraction, median(sharpe) AS near_sr FROM {{sums}} WHERE cfg LIKE 'near%' AND segment = 'sealed' GROUP BY symbol) k ON k.symbol = s.symbol
      LEFT JOIN (SELECT symbol, avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END) AS p_profit, avg(CASE WHEN dd > 50 THEN 1e0 ELSE 0e0 END) AS p_ruin FROM {{sealed_runs}} GROUP BY symbol) mc ON mc.symbol = s.symbol
      LEFT JOIN (SELECT symbol, coalesce(max(net) / nullif(sum(CASE WHEN net > 0 THEN net END), 0), 1) AS top_regime FROM {{regimes}} WHERE segment = 'sealed' GROUP BY symbol) rg ON rg.symbol = s.symbol)))""",
    write=True,
)
query("a21_probabilistic_sharpe", "SELECT symbol, n, round(per_trade, 6) AS sharpe, round(psr, 5) AS psr FROM {judged}")
query("a22_expected_best", "SELECT symbol, trials, round(star, 6) AS expected_best FROM {judged}")
query("a23_deflated_sharpe", "SELECT symbol, n, round(dsr, 5) AS dsr FROM {judged}")
query("a24_t_statistic", f"SELECT symbol, n, round(tstat, 6) AS tstat, round(1 - {normal_cdf('tstat')}, 5) AS p_value FROM {{judged}}")
query("a43_cross_asset", "SELECT symbol, assets, round(median_sr, 5) AS median_sharpe FROM {judged}")
query("a39_neighbourhood", "SELECT symbol, round(fraction, 6) AS fraction_profitable, round(near_sr, 5) AS median_sharpe FROM {judged}")
query("a12_degradation", "SELECT symbol, round(sr_is, 5) AS in_sample, round(sr, 5) AS sealed, round(CASE WHEN sr_is <= 0 THEN 100 ELSE greatest(0e0, (sr_is - sr) / abs(sr_is) * 100) END, 5) AS degradation_pct FROM {judged}")

# ---------------------------------------------------------------- gates

#: gate -> (passes, margin); a gate that cannot be judged fails with a margin of -1.
_LAG = "CASE WHEN lag0_sr > 0 THEN 1 - sr / lag0_sr WHEN sr >= 0 THEN 0e0 ELSE 1e0 END"
GATES = {
    "g01": ("NOT ruined AND sr >= g01_sharpe AND pf >= g01_profit_factor AND n >= g01_trades AND net > g01_net", "least(sr / g01_sharpe - 1, n / g01_trades - 1)"),
    "g02": ("sr_is > 0 AND 1 - sr / sr_is <= g02_degradation AND sr > 0", "CASE WHEN sr_is <= 0 THEN -1e0 ELSE (g02_degradation - 1 + sr / sr_is) / g02_degradation END"),
    "g03": ("n >= 4 AND dsr >= g03_dsr", "CASE WHEN n < 4 THEN -1e0 ELSE (dsr - g03_dsr) / (1 - g03_dsr) END"),
    "g04": ("NOT ruined AND dd <= g04_drawdown_pct", "CASE WHEN ruined THEN -1e0 ELSE (g04_drawdown_pct - dd) / g04_drawdown_pct END"),
    "g05": ("NOT ruined AND stress_sr >= g05_sharpe AND stress_pf >= g05_profit_factor", "stress_sr / g05_sharpe - 1"),
    "g06": (f"sr >= g06_sharpe AND pf > 1 AND {_LAG} <= g06_degradation", f"(g06_degradation - ({_LAG})) / g06_degradation"),
    "g07": ("n >= g07_trades AND p_ruin <= g07_ruin AND p_profit >= g07_profit", "CASE WHEN n < g07_trades THEN -1e0 ELSE least((g07_ruin - p_ruin) / g07_ruin, (p_profit - g07_profit) / (1 - g07_profit)) END"),
    "g08": ("assets >= g08_assets AND median_sr >= g08_sharpe", "(assets - g08_assets) / 4"),
    "g09": ("fraction >= g09_fraction AND near_sr >= g09_sharpe", "(fraction - g09_fraction) / g09_fraction"),
    "g10": ("n >= g10_trades AND tstat >= g10_tstat", "CASE WHEN n < g10_trades THEN -1e0 ELSE (tstat - g10_tstat) / g10_tstat END"),
    "g11": ("n >= 4 AND net > 0 AND best / nullif(net, 0) <= g11_trade AND top_regime <= g11_regime", "CASE WHEN n < 4 OR net <= 0 THEN -1e0 ELSE least((g11_trade - best / net) / g11_trade, (g11_regime - top_regime) / g11_regime) END"),
}
derived("gate_rows", " UNION ALL ".join(f"SELECT symbol, '{g}' AS gate, coalesce({ok}, false) AS passed, coalesce({margin}, -1e0) AS margin FROM {{judged}} CROSS JOIN {{limits}}" for g, (ok, margin) in GATES.items()))
query("c10_scorecard_gates", "SELECT symbol, g.gate, passed, round(margin, 5) AS margin, mandatory, weight FROM {gate_rows} g JOIN {spec} s ON s.gate = g.gate")
for _id, _gate in zip(range(11, 21), list(GATES)[1:], strict=True):
    _ok, _margin = GATES[_gate]
    query(f"c{_id}_gate_{_gate}", f"SELECT symbol, coalesce({_ok}, false) AS passed, round(coalesce({_margin}, -1e0), 5) AS margin FROM {{judged}} CROSS JOIN {{limits}}")
query("c21_gate_spec", "SELECT s.gate, mandatory, weight, count(*) AS candidates, sum(CASE WHEN passed THEN 1 ELSE 0 END) AS passed FROM {spec} s JOIN {gate_rows} g ON g.gate = s.gate GROUP BY s.gate, mandatory, weight")
query(
    "a32_scorecard",
    """SELECT symbol, sum(CASE WHEN passed THEN 1 ELSE 0 END) AS n_passed, min(CASE WHEN mandatory AND NOT passed THEN 0 ELSE 1 END) = 1 AS passed, round(sum(CASE WHEN passed THEN weight * greatest(-1e0, least(1e0, margin)) WHEN mandatory THEN -2 * weight ELSE 0 END), 4) AS score
    FROM {gate_rows} g JOIN {spec} s ON s.gate = g.gate GROUP BY symbol""",
)

# ---------------------------------------------------------------- verdicts

_DEGRADED = "CASE WHEN sr_is <= 0 THEN 100 ELSE greatest(0e0, (sr_is - sr) / abs(sr_is) * 100) END"
query("a13_robustness", f"SELECT symbol, NOT ruined AND dd <= 15 AND sr >= 0.8 AND n >= 4 AND {_DEGRADED} <= 30 AND pf > 1 AS robust, NOT ruined AS survives, dd <= 15 AS drawdown_ok, sr >= 0.8 AS sharpe_ok, n >= 4 AS trades_ok, {_DEGRADED} <= 30 AS degradation_ok, pf > 1 AS profit_factor_ok FROM {{judged}}")
query("a14_acceptance", f"SELECT symbol, sr >= 1 AND dd <= 15 AND n >= 4 AND pf > 1 AND {_DEGRADED} <= 30 AS acceptable FROM {{judged}}")
derived("weeks", "SELECT symbol, cast(floor(exit_hour / 168) AS bigint) AS week, sum(net) AS net, count(*) AS n, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) AS sharpe FROM {taken} WHERE cfg = 'base' GROUP BY symbol, cast(floor(exit_hour / 168) AS bigint)")
query("a17_sharpe_by_period", "SELECT symbol, week, n, round(sharpe, 6) AS sharpe, round(net, 6) AS net FROM {weeks}")
query("p17_periods_of_enough_rows", "SELECT symbol, cast(floor(hour / 168) AS bigint) AS week, count(*) AS n, round(max_by(close, hour) / min_by(close, hour) - 1, 8) AS total FROM {b} GROUP BY symbol, cast(floor(hour / 168) AS bigint) HAVING count(*) >= 30")
derived("period_counts", "SELECT symbol, sum(CASE WHEN net < 0 THEN 1 ELSE 0 END) AS negative, count(*) AS periods, median(net) AS middle FROM {weeks} GROUP BY symbol")
query("a50_pre_screen", "SELECT j.symbol, n_is + n >= 4 AND per_trade_is > 0 AND negative <= 1 AND middle > 0 AND stress_net > 0 AND dd < 25 AND median_sr > 0 AS passed, negative, round(middle, 6) AS middle FROM {judged} j JOIN {period_counts} p ON p.symbol = j.symbol")
_NINE = {
    "long_only": "n_short = 0", "positive_oos": "net > 0 AND sr > 0", "acceptable_drawdown": "dd < 25", "survives_stress": "stress_net > 0", "enough_trades": "n >= 4", "not_single_asset": "median_sr > 0", "not_single_period": "negative <= 1 AND periods >= 2",
    "no_single_trade": "net <= 0 OR best / net < 0.35", "beats_holding": "net / 1000 > held_return",
}
query(
    "a51_final_acceptance",
    f"SELECT symbol, {', '.join(f'{k}' for k in _NINE)}, {' + '.join(f'CASE WHEN {k} THEN 1 ELSE 0 END' for k in _NINE)} AS n_met, CASE WHEN n < 4 THEN 'EXPLORATORY' WHEN {' AND '.join(_NINE)} THEN 'ACCEPT' ELSE 'REJECT' END AS verdict FROM (SELECT j.symbol, j.n, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in _NINE.items())} FROM {{judged}} j JOIN {{period_counts}} p ON p.symbol = j.symbol JOIN (SELECT symbol, sum(CASE WHEN side = -1 THEN 1 ELSE 0 END) AS n_short FROM {{taken}} WHERE cfg = 'base' GROUP BY symbol) q ON q.symbol = j.symbol)",
)
query("c27_frozen_candidates", "SELECT symbol, sha256_hex, round(score, 4) AS score FROM (SELECT symbol, {HASH} AS sha256_hex, sum(CASE WHEN passed THEN weight ELSE 0 END) AS score FROM {gate_rows} g JOIN {spec} s ON s.gate = g.gate GROUP BY symbol)".replace("{HASH}", "<sha>concat(symbol, ':base:20:2:3:24')</sha>"))

#: (deflated Sharpe ratio, trades, t statistic) that certification asks for at least.
CERTIFIED = (0.95, 30, 2.0)
query("c23_certification", f"SELECT symbol, n, round(dsr, 5) AS dsr, round(tstat, 6) AS tstat, NOT ruined AND sr > 0 AND n >= {CERTIFIED[1]} AND dsr >= {CERTIFIED[0]} AND tstat >= {CERTIFIED[2]} AS certified, CASE WHEN ruined THEN 'ruined' WHEN n < {CERTIFIED[1]} THEN 'too few trades' WHEN sr <= 0 THEN 'no return' WHEN dsr < {CERTIFIED[0]} THEN 'explained by trials' WHEN tstat < {CERTIFIED[2]} THEN 'not significant' ELSE 'certified' END AS reason FROM {{judged}}")

# ---------------------------------------------------------------- fitness and rankings

derived(
    "fit",
    """SELECT i.symbol, i.cfg, c.lookback, c.stop_mult, c.target_mult, c.hours, i.n, i.sharpe AS train, s.sharpe AS val, i.per_trade, i.pf, i.net, d.dd, d.ruined, s.net AS net_sealed, s.n AS n_sealed FROM {sums} i JOIN {sums} s ON s.symbol = i.symbol AND s.cfg = i.cfg AND s.segment = 'sealed' JOIN {configs} c ON c.cfg = i.cfg JOIN {depths} d ON d.symbol = i.symbol AND d.cfg = i.cfg WHERE i.segment = 'in_sample'""",
    write=True,
)
derived("crossed", "SELECT f.*, x.median_other FROM {fit} f JOIN (SELECT a.symbol, a.cfg, median(o.train) AS median_other FROM {fit} a JOIN {fit} o ON o.cfg = a.cfg AND o.symbol <> a.symbol GROUP BY a.symbol, a.cfg) x ON x.symbol = f.symbol AND x.cfg = f.cfg")
_FITNESS = "0.5 * train + 0.3 * val + 0.1 * ln(greatest(n, 1)) + 0.25 * greatest(-1e0, least(1e0, median_other)) - 0.02 * greatest(0e0, CASE WHEN train <= 0 THEN 100 ELSE greatest(0e0, (train - val) / abs(train) * 100) END - 30) - 0.1 * greatest(0e0, dd - 5) - 0.05 * greatest(0e0, 30 - n) - CASE WHEN median_other <= 0 THEN 0.3 ELSE 0 END"
derived("scored", f"SELECT *, {_FITNESS} AS fitness FROM {{crossed}}", write=True)
query("a47_robust_fitness", "SELECT symbol, cfg, round(least(train, val) - CASE WHEN least(n, n_sealed) < 3 THEN 2 ELSE 0 END - CASE WHEN ruined THEN 5 ELSE 0 END, 5) AS fitness FROM {fit}")
query("a48_composite_fitness", "SELECT symbol, cfg, round(fitness, 5) AS fitness FROM {scored}")
query("a49_grid_ranking", "SELECT symbol, cfg, round(score, 5) AS score, place FROM (SELECT symbol, cfg, score, row_number() OVER (PARTITION BY symbol ORDER BY round(score, 9) DESC, cfg) AS place FROM (SELECT symbol, cfg, train * sqrt(n) * least(pf, 3) / 3 AS score FROM {fit} WHERE n >= 5)) WHERE place <= 10")
query("a34_score_table", "SELECT symbol, count(*) AS n, round(avg(fitness), 5) AS mean_fitness, round(max(fitness), 5) AS best_fitness, round(avg(CASE WHEN fitness > 0 THEN 1e0 ELSE 0e0 END), 6) AS share_positive FROM {scored} GROUP BY symbol")
query("a35_promising", "SELECT symbol, round(avg(CASE WHEN n < 3 OR place <= 5 THEN fitness END), 5) AS mean_of_best FROM (SELECT symbol, fitness, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY round(fitness, 9) DESC, cfg) AS place FROM {scored}) GROUP BY symbol")
_AXES = [("lookback", 10, 40, "int"), ("stop_mult", 1.0, 4.0, "float"), ("target_mult", 1.5, 6.0, "float"), ("hours", 12, 48, "int")]
derived("long_params", " UNION ALL ".join(f"SELECT symbol, cfg, fitness, '{p}' AS param, cast({p} AS double) AS value, {float(lo)}e0 AS lo, {float(hi)}e0 AS hi FROM {{scored}}" for p, lo, hi, _ in _AXES))
query(
    "a36_learned_ranges",
    """SELECT param, round(CASE WHEN narrow THEN greatest(lo, m - 0.15 * (hi - lo)) ELSE a END, 6) AS low, round(CASE WHEN narrow THEN least(hi, m + 0.15 * (hi - lo)) ELSE z END, 6) AS high FROM (
      SELECT *, z - a < 0.3 * (hi - lo) AS narrow FROM (SELECT param, max(lo) AS lo, max(hi) AS hi, avg(value) AS m, greatest(max(lo), percentile_cont(0.1) WITHIN GROUP (ORDER BY value)) AS a, least(max(hi), percentile_cont(0.9) WITHIN GROUP (ORDER BY value)) AS z FROM {long_params} WHERE fitness > -10 GROUP BY param))""",
)
query("a25_fitness_landscape", "SELECT param, round(value, 3) AS value, round(avg(fitness), 5) AS mean_fitness, round(max(fitness), 5) AS best_fitness, count(*) AS n FROM {long_params} GROUP BY param, round(value, 3)")
query("a46_worst_fold", "SELECT symbol, round(min(sharpe), 6) AS worst, round(avg(sharpe), 6) AS mean, sum(CASE WHEN sharpe < 0 THEN 1 ELSE 0 END) AS negative, round(sum(n) / 720e0, 6) AS activity FROM {weeks} GROUP BY symbol")
query(
    "a11_walk_forward_aggregate",
    "SELECT symbol, count(*) AS folds, round(avg(sharpe), 6) AS mean_sharpe, round(stddev_pop(sharpe), 6) AS stability, sum(n) AS trades, round(sum(net), 6) AS net, round(avg(pf), 6) AS mean_pf, round(avg(win), 6) AS mean_win_rate FROM (SELECT symbol, cast(floor(exit_hour / 168) AS bigint) AS week, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) AS sharpe, count(*) AS n, sum(net) AS net, coalesce(sum(CASE WHEN net > 0 THEN net END), 0) / nullif(-coalesce(sum(CASE WHEN net <= 0 THEN net END), 0), 0) AS pf, avg(CASE WHEN net > 0 THEN 1e0 ELSE 0e0 END) AS win FROM {taken} WHERE cfg = 'base' GROUP BY symbol, cast(floor(exit_hour / 168) AS bigint)) GROUP BY symbol",
)

# ---------------------------------------------------------------- configurations: distances, hall of fame, comparisons

_DISTANCE = "(" + " + ".join(f"abs(x.{p} - y.{p}) / {float(hi - lo)}e0" for p, lo, hi, _ in _AXES) + ") / 4"
#: Between the ten best configurations of each symbol.
derived("ten_best", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(fitness, 9) DESC, cfg) AS nth FROM {scored}) WHERE nth <= 10")
query("c07_config_distance", f"SELECT x.symbol, x.cfg AS a, y.cfg AS b, round({_DISTANCE}, 6) AS distance FROM {{ten_best}} x JOIN {{ten_best}} y ON x.symbol = y.symbol AND x.cfg < y.cfg")
APART = 0.15
#: The same choice row by row: the state is the list of what was kept.
_KEPT_SQL = f"""SELECT r.* EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(fitness, 9) DESC, cfg) AS k FROM scored) r JOIN (WITH RECURSIVE r AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY round(fitness, 9) DESC, cfg) AS k, {', '.join(f'{p}::DOUBLE AS {p}' for p, *_ in _AXES)} FROM scored),
  s(symbol, k, kept, held) AS (SELECT DISTINCT symbol, 0::BIGINT, [r]::STRUCT(symbol VARCHAR, k BIGINT, {', '.join(f'{p} DOUBLE' for p, *_ in _AXES)})[], false FROM r WHERE k = 1
    UNION ALL SELECT x.symbol, x.k, CASE WHEN x.k = 1 THEN [x] WHEN len(list_filter(s.kept, lambda y: {_DISTANCE} < {APART})) > 0 THEN s.kept ELSE list_append(s.kept, x) END, x.k = 1 OR len(list_filter(s.kept, lambda y: {_DISTANCE} < {APART})) = 0 FROM s JOIN r x ON x.symbol = s.symbol AND x.k = s.k + 1)
  SELECT symbol, k FROM s WHERE held) t ON t.symbol = r.symbol AND t.k = r.k"""
relation("distinct_best", lambda t: distinct_best(t.get("scored"), "symbol", {p: (lo, hi) for p, lo, hi, _ in _AXES}, "fitness", "cfg", APART), _KEPT_SQL, "scored")
query("j14_near_duplicate_configs", "SELECT symbol, cfg, round(fitness, 5) AS fitness FROM {distinct_best}")
query("c08_hall_of_fame", "SELECT symbol, cfg, round(fitness, 5) AS fitness, place FROM (SELECT *, row_number() OVER (ORDER BY round(fitness, 9) DESC, symbol, cfg) AS place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(fitness, 9) DESC, cfg) AS nth FROM {distinct_best}) WHERE nth <= 4) WHERE place <= 20")
query("c08_best_per_strategy", "SELECT symbol, cfg, round(fitness, 5) AS fitness, nth FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(fitness, 9) DESC, cfg) AS nth FROM {scored}) WHERE nth <= 5")
query("c25_sweep_winners", "SELECT s.symbol, s.cfg, round(s.fitness, 5) AS fitness, round(s.net_sealed, 6) AS net_sealed, round(s.median_other, 5) AS median_other FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(fitness, 9) DESC, cfg) AS nth FROM {scored}) s WHERE nth = 1")
query("c24_winner_then_sealed", "SELECT symbol, cfg, round(train, 5) AS in_sample, round(val, 5) AS sealed, n_sealed FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(train, 9) DESC, cfg) AS nth FROM {fit}) WHERE nth = 1")


def _leaderboard(t: Tables) -> DataFrame:
    """Two runs appended to one table, the scores under the base costs and under the stressed ones, read again, ranked and compared."""
    at = f"{shared_folder(t.spark)}/leaderboard-{uuid.uuid4().hex}"
    for run, cfg in enumerate(("base", "stress"), 1):
        t.get("sums").where(f"cfg = '{cfg}' AND segment = 'sealed'").selectExpr(f"{run} AS run", "symbol", "round(sharpe, 6) AS score").write.mode("append").parquet(at)
    return t.spark.read.schema("run int, symbol string, score double").parquet(at).selectExpr("run", "symbol", "score", *_PLACES)


_PLACES = ["rank() OVER (PARTITION BY run ORDER BY score DESC) AS place", "score - lag(score) OVER (PARTITION BY symbol ORDER BY run) AS change"]
computed("c22_leaderboard", _leaderboard, f"SELECT run, symbol, score, {', '.join(_PLACES)} FROM (SELECT CASE cfg WHEN 'base' THEN 1 ELSE 2 END AS run, symbol, round(sharpe, 6) AS score FROM sums WHERE cfg IN ('base', 'stress') AND segment = 'sealed')", "sums")


def judged_each(t: Tables, gates: dict[str, tuple[str, str]]) -> DataFrame:
    """(symbol, gate, passed, margin, error): each gate is run by itself; one that raises fails every candidate, with the kind of its error."""
    out = None
    for gate, (ok, margin) in gates.items():
        try:
            rows = written(t.run(f"SELECT symbol, '{gate}' AS gate, coalesce({ok}, false) AS passed, coalesce({margin}, -1e0) AS margin, CAST(NULL AS STRING) AS error FROM {{judged}} CROSS JOIN {{limits}}"), "gate")
        except Exception as e:  # whatever a gate raises is its result
            kind = getattr(e, "getCondition", lambda: None)() or type(e).__name__
            rows = t.get("judged").selectExpr("symbol", f"'{gate}' AS gate", "false AS passed", "-1e0 AS margin", f"'{kind}' AS error")
        out = rows if out is None else out.unionByName(rows)
    return out


#: The gates, and one that divides by nothing.
_WITH_BROKEN = {**GATES, "broken": ("sr / (n - n) > 0", "0e0")}
computed(
    "ud5_gates_that_fail",
    lambda t: judged_each(t, _WITH_BROKEN).selectExpr("symbol", "gate", "passed", "round(margin, 5) AS margin", "error IS NOT NULL AS crashed"),
    " UNION ALL ".join(f"SELECT symbol, '{g}' AS gate, coalesce({ok}, false) AS passed, round(coalesce({margin}, -1e0), 5) AS margin, false AS crashed FROM judged CROSS JOIN limits" for g, (ok, margin) in GATES.items()) + " UNION ALL SELECT symbol, 'broken', false, -1e0, true FROM judged",
    "judged",
    "limits",
)
derived(
    "experiments",
    """SELECT e.symbol, e.cfg, CASE WHEN b.train <> 0 THEN (e.train - b.train) / abs(b.train) * 100 WHEN e.train > 0 THEN 100e0 ELSE 0e0 END AS improvement, e.dd <= 1.5 * b.dd AND e.pf >= 0.7 * b.pf AND e.val >= CASE WHEN b.val > 0 THEN 0.7 * b.val ELSE b.val END AS guarded, NOT e.ruined AND e.pf > 1 AS robust
    FROM {fit} e JOIN {fit} b ON b.symbol = e.symbol AND b.cfg = 'base' WHERE e.cfg LIKE 'near%'""",
)
_REASON = "CASE WHEN improvement < 5 THEN 'insufficient_improvement' WHEN NOT guarded THEN 'guard_metric_degraded' WHEN NOT robust THEN 'not_robust_enough' ELSE 'accepted' END"
query("j12_experiment_verdicts", f"SELECT symbol, cfg, round(improvement, 5) AS improvement, {_REASON} AS reason FROM {{experiments}}")
query("a45_session_summary", f"SELECT symbol, count(*) AS experiments, sum(CASE WHEN {_REASON} = 'accepted' THEN 1 ELSE 0 END) AS accepted, sum(CASE WHEN {_REASON} <> 'accepted' THEN 1 ELSE 0 END) AS rejected, round(avg(CASE WHEN {_REASON} = 'accepted' THEN 1e0 ELSE 0e0 END), 6) AS rate FROM {{experiments}} GROUP BY symbol")
query("u01_both_segments", "SELECT symbol, cfg, sum(n) AS trades, round(sum(net), 6) AS net FROM (SELECT symbol, cfg, n, net FROM {sums} WHERE segment = 'in_sample' UNION ALL SELECT symbol, cfg, n, net FROM {sums} WHERE segment = 'sealed') GROUP BY symbol, cfg")
query("u03_distinct_configs", "SELECT lookback, c.hours, count(DISTINCT c.cfg) AS configurations, count(*) AS trades FROM {configs} c JOIN {taken} t ON t.cfg = c.cfg GROUP BY lookback, c.hours")
