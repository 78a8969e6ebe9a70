"""Panels of assets: books, rebalancing, costs, funding, sleeves, overlays, venues and forward scoring.

A panel row is an asset's day; `px` adds returns, funding, averages and ranks. What runs over days alone has one row per
calendar day and configuration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions.dialect import draw
from barlab.functions.layers import Layer, add_layers, full, lag, layers_sql, over, ratio
from barlab.functions.recursive import ewm_sql
from barlab.functions.series import ewms
from barlab.operators.ledger import FLOOR, REENTRY, TRIGGER, circuit_breaker
from barlab.plans.relations import derived, query, relation
from barlab.plans.strategies import normal_cdf

P = {"by": "asset", "order": "day"}
_DAY = "PARTITION BY day"
#: Funding of an asset's day: what the given table has nearest to a small signed rate.
relation(
    "funding", lambda t: t.get("t_lineitem").selectExpr("l_suppkey % 10 AS asset", "datediff(cast(l_shipdate AS date), date'1970-01-01') AS day", "l_tax").groupBy("asset", "day").agg(F.expr("(avg(l_tax) - 0.04) / 10").alias("funding")),
    "SELECT l_suppkey % 10 AS asset, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS day, (avg(l_tax) - 0.04) / 10 AS funding FROM lineitem GROUP BY ALL",
)
_BASE: list[Layer] = [
    {"lr": f"ln({ratio('close', lag('close', **P))})", "ret": f"{ratio('close', lag('close', **P))} - 1", "d": f"coalesce(close - {lag('close', **P)}, 0)"},
    {
        "gain": "greatest(d, 0)", "loss": "greatest(-d, 0)", "mom_20": f"ln({ratio(lag('close', 1, **P), lag('close', 21, **P))})", "mom_60": f"{ratio('close', lag('close', 60, **P))} - 1", "mom_90": f"{ratio('close', lag('close', 90, **P))} - 1",
        "vol": f"CASE WHEN count(lr) {over(20, **P)} >= 10 THEN stddev_pop(lr) {over(20, **P)} END", "ma_50": full("avg", "close", 50, **P), "hi_50": f"CASE WHEN count(close) {over(50, skip=1, **P)} >= 50 THEN max(close) {over(50, skip=1, **P)} END",
        "f_mean": full("avg", "funding", 7, **P), "f_sd": full("stddev_pop", "funding", 7, **P), "carry": f"-({full('avg', 'funding', 7, **P)})",
    },
    {"fz": ratio("funding - f_mean", "f_sd"), "above": "CASE WHEN ma_50 IS NULL THEN NULL WHEN close > ma_50 THEN 1e0 ELSE 0e0 END"},
]
_EMAS = {"ema_5": ("close", 2 / 6, 0), "ema_150": ("close", 2 / 151, 0), "ema_200": ("close", 2 / 201, 0), "gain_14": ("gain", 1 / 14, 14), "loss_14": ("loss", 1 / 14, 14)}
_CROSS: list[Layer] = [
    {"rsi": f"100 - 100 / (1 + {ratio('gain_14', 'loss_14')})", "breadth": f"sum(CASE WHEN above = 1 THEN 1e0 ELSE 0e0 END) OVER ({_DAY}) / count(*) OVER ({_DAY})", "lead_on": f"max(CASE WHEN asset = 0 AND close > ema_150 THEN 1 ELSE 0 END) OVER ({_DAY})", "names": f"count(mom_20) OVER ({_DAY})"},
    {"regime_on": "CASE WHEN lead_on = 1 AND breadth >= 0.3 THEN 1 ELSE 0 END", "up_rank": f"CASE WHEN mom_20 IS NOT NULL THEN row_number() OVER ({_DAY} ORDER BY mom_20 DESC NULLS LAST, asset) END", "down_rank": f"CASE WHEN mom_20 IS NOT NULL THEN row_number() OVER ({_DAY} ORDER BY mom_20 ASC NULLS LAST, asset DESC) END"},
]
#: The given prices jump by half from day to day; on a base of 1000 their returns are those of a wild market.
derived("priced", "SELECT p.asset, p.day, 1000 + p.open / 20 AS open, 1000 + p.close / 20 AS close, coalesce(funding, 0) AS funding FROM {panel} p LEFT JOIN {funding} f ON f.asset = p.asset AND f.day = p.day", write=True)
_SQL = layers_sql("SELECT * FROM priced", _BASE)
_SQL = f"SELECT *, {', '.join(f'{ewm_sql(x, a, w, **P)} AS {out}' for out, (x, a, w) in _EMAS.items())} FROM ({_SQL})"
relation("based", lambda t: add_layers(t.get("priced"), _BASE), "SELECT 1", write=True)
relation("px", lambda t: add_layers(ewms(t.get("based"), _EMAS, **P), _CROSS), layers_sql(_SQL, _CROSS), "priced", write=True)
derived("days", "SELECT day, row_number() OVER (ORDER BY day) - 1 AS di FROM (SELECT DISTINCT day FROM {panel})", write=True)
query("x04_realised_vol", "SELECT asset, day, round(vol, 8) AS vol FROM {px}")
query("x03_carry_score", "SELECT asset, day, round(carry, 10) AS carry FROM {px}")
query("p11_eligible", "SELECT asset, day, names FROM {px} WHERE mom_20 IS NOT NULL AND names >= 6")

# ---------------------------------------------------------------- book, rebalancing, costs

EVERY, COST = 7, 0.0015
derived("sides", "SELECT *, CASE WHEN up_rank <= k THEN 1 WHEN down_rank <= k THEN -1 END AS side FROM (SELECT *, greatest(1, least(3, cast(floor(names / 2) AS int))) AS k FROM {px} WHERE mom_20 IS NOT NULL AND names >= 2)")
derived(
    "weights",
    """SELECT asset, day, side, mom_20 AS score, ret, 0.5 * side / count(*) OVER (PARTITION BY day, side) AS w_equal, 0.5 * side * abs(mom_20) / nullif(sum(abs(mom_20)) OVER (PARTITION BY day, side), 0) AS w_score,
    0.5 * side * (1 / greatest(vol, 1e-6)) / nullif(sum(1 / greatest(vol, 1e-6)) OVER (PARTITION BY day, side), 0) AS w_vol FROM {sides} WHERE side IS NOT NULL AND vol IS NOT NULL""",
)
query("x07_shrinking_book", "SELECT asset, day, side, k FROM {sides} WHERE side IS NOT NULL")
query("x08_weight_modes", "SELECT asset, day, round(w_equal, 8) AS w_equal, round(w_score, 8) AS w_score, round(w_vol, 8) AS w_vol FROM {weights}")
derived("targets", f"SELECT asset, cast(floor(di / {EVERY}) AS bigint) AS period, w_vol AS w FROM {{weights}} w JOIN {{days}} d ON d.day = w.day WHERE di % {EVERY} = 0", write=True)
derived("changes", "SELECT coalesce(n.period, o.period + 1) AS period, coalesce(n.asset, o.asset) AS asset, coalesce(n.w, 0) AS w_new, coalesce(o.w, 0) AS w_old FROM {targets} n FULL OUTER JOIN {targets} o ON o.asset = n.asset AND o.period = n.period - 1")
query("j10_weight_changes", "SELECT period, asset, round(w_new, 8) AS w_new, round(w_old, 8) AS w_old, round(abs(w_new - w_old), 8) AS turnover FROM {changes}")
query("u04_names_of_both", "SELECT period, count(*) AS names, sum(CASE WHEN w_new = 0 THEN 1 ELSE 0 END) AS dropped, sum(CASE WHEN w_old = 0 THEN 1 ELSE 0 END) AS added FROM {changes} GROUP BY period")
derived("turnovers", "SELECT period, sum(abs(w_new - w_old)) AS turnover, sum(abs(w_new)) AS gross, sum(CASE WHEN abs(w_new) > 1e-9 THEN 1 ELSE 0 END) AS positions FROM {changes} GROUP BY period")
#: The days of a period are those after its rebalancing day up to the next one.
derived("held_days", f"SELECT t.period, x.day, x.asset, t.w, coalesce(x.ret, 0) AS ret, x.funding FROM {{px}} x JOIN {{days}} d ON d.day = x.day JOIN {{targets}} t ON t.asset = x.asset AND t.period = cast(floor((di - 1) / {EVERY}) AS bigint) WHERE di > 0")
query("j09_holding_intervals", "SELECT period, asset, count(*) AS days, round(w, 8) AS w, round(sum(ret), 8) AS ret, round(sum(funding), 8) AS funding FROM {held_days} GROUP BY period, asset, w")
derived("period_returns", f"SELECT t.period, turnover, gross, positions, coalesce(price, 0) AS price, coalesce(paid, 0) AS paid, -{COST} * turnover + coalesce(price, 0) - coalesce(paid, 0) AS r FROM {{turnovers}} t LEFT JOIN (SELECT period, sum(w * ret) AS price, sum(w * funding) AS paid FROM {{held_days}} GROUP BY period) h ON h.period = t.period", write=True)
query("x10_turnover_cost", f"SELECT period, round(turnover, 8) AS turnover, round({COST} * turnover, 8) AS cost FROM {{turnovers}}")
query("x11_period_returns", "SELECT period, round(r, 8) AS r, round(exp(s), 6) AS equity, min(exp(s)) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 0.1 AS ruined FROM (SELECT period, r, sum(ln(greatest(1 + r, 1e-9))) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM {period_returns})")
query("x09_held_weights", "SELECT day, asset, round(w, 8) AS w FROM {held_days}")
query("a41_portfolio_diagnostics", "SELECT round(avg(turnover), 8) AS turnover_mean, round(avg(gross), 8) AS gross_exposure, round(avg(positions), 6) AS positions, round(-sum(paid), 8) AS funding_result, round(sum(price), 6) AS price_result, count(*) AS periods FROM {period_returns}")

# ---------------------------------------------------------------- sleeves and daily backtests

#: sleeve -> (trigger, score, days that a trigger holds, whether the market gate applies)
SLEEVES = {"trend": ("close > ema_200", "mom_60", 1, False), "relative_strength": ("mom_90 IS NOT NULL", "mom_90", 1, False), "dip": ("rsi < 45 AND close > ema_150", "-rsi", 10, False), "capitulation": ("fz < -1 AND close > ema_5", "-fz", 10, True), "breakout": ("close > hi_50 AND close > ema_200", "mom_60", 15, False)}
TOP = 3
#: Parametrised sleeves: thresholds as columns of a table.
derived("sleeve_params", "SELECT 'cap_a' AS cfg, 1e0 AS z, 3e-1 AS breadth_min, 3 AS slots UNION ALL SELECT 'cap_b', 5e-1, 4e-1, 5 UNION ALL SELECT 'cap_c', 15e-1, 2e-1, 4")


def _sleeve(name: str) -> str:
    trigger, score, hold, gated = SLEEVES[name]
    held = f"max(CASE WHEN {trigger} THEN 1 ELSE 0 END) {over(hold, **P)}"
    return f"SELECT '{name}' AS cfg, asset, day, ret, {score} AS score, {held} * {'regime_on' if gated else '1'} AS held, {TOP} AS slots FROM {{px}}"


derived("sleeve_rows", " UNION ALL ".join(_sleeve(n) for n in SLEEVES) + f" UNION ALL SELECT cfg, asset, day, ret, -fz AS score, max(CASE WHEN fz < -z AND close > ema_5 THEN 1 ELSE 0 END) OVER (PARTITION BY cfg, asset ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * CASE WHEN lead_on = 1 AND breadth >= breadth_min THEN 1 ELSE 0 END AS held, slots FROM {{px}} CROSS JOIN {{sleeve_params}}")
derived("sleeve_weights", "SELECT cfg, asset, day, ret, CASE WHEN place <= slots THEN 1e0 / slots ELSE 0e0 END AS w FROM (SELECT *, CASE WHEN held = 1 AND score IS NOT NULL THEN row_number() OVER (PARTITION BY cfg, day, CASE WHEN held = 1 AND score IS NOT NULL THEN 1 ELSE 0 END ORDER BY score DESC, asset) END AS place FROM {sleeve_rows})", write=True)
query("x14_capitulation_weights", "SELECT asset, day, round(w, 8) AS w FROM {sleeve_weights} WHERE cfg = 'capitulation' AND w > 0")
query("x16_five_sleeves", "SELECT cfg, day, count(*) AS names, round(sum(w), 8) AS invested FROM {sleeve_weights} WHERE w > 0 AND cfg NOT IN ('cap_a', 'cap_b', 'cap_c') GROUP BY cfg, day")
query("x17_parametrised_sleeves", "SELECT cfg, day, count(*) AS names, round(sum(w), 8) AS invested FROM {sleeve_weights} WHERE w > 0 AND cfg IN ('cap_a', 'cap_b', 'cap_c') GROUP BY cfg, day")
#: Weights of a day earn the next day's return; turnover is paid with them.
derived(
    "sleeve_days",
    """SELECT cfg, day, sum(w1 * ret) - 0.001 * sum(abs(w1 - w2)) AS r, sum(w1) AS exposure, sum(abs(w1 - w2)) AS turnover FROM (SELECT cfg, asset, day, coalesce(ret, 0) AS ret, coalesce(lag(w) OVER (PARTITION BY cfg, asset ORDER BY day), 0) AS w1, coalesce(lag(w, 2) OVER (PARTITION BY cfg, asset ORDER BY day), 0) AS w2 FROM {sleeve_weights}) GROUP BY cfg, day""",
    write=True,
)
query("x18_sleeve_backtests", "SELECT cfg, day, round(r, 8) AS r, round(exposure, 8) AS exposure, round(turnover, 8) AS turnover FROM {sleeve_days}")
_CURVE = "exp(sum(ln(greatest(1 + r, 1e-9))) OVER (PARTITION BY cfg ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
derived("sleeve_curves", f"SELECT *, max(eq) OVER (PARTITION BY cfg ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM (SELECT *, {_CURVE} AS eq FROM {{sleeve_days}})")
query(
    "a16_daily_metrics",
    """SELECT cfg, n, round(pow(last, 365e0 / n) - 1, 6) AS cagr, round(m / nullif(sd, 0) * sqrt(365), 6) AS sharpe, round(m / nullif(dn, 0) * sqrt(365), 6) AS sortino, round(dd, 6) AS max_drawdown, round((pow(last, 365e0 / n) - 1) / nullif(dd, 0), 5) AS calmar, round(exposure, 6) AS exposure, round(active, 6) AS days_in_market FROM (
      SELECT cfg, count(*) AS n, max_by(eq, day) AS last, avg(r) AS m, stddev_samp(r) AS sd, stddev_samp(CASE WHEN r < -1e-12 THEN r END) AS dn, max(1 - eq / peak) AS dd, avg(exposure) AS exposure, avg(CASE WHEN exposure > 0 THEN 1e0 ELSE 0e0 END) AS active FROM {sleeve_curves} GROUP BY cfg)""",
)
query("a05_calmar", "SELECT cfg, round((pow(max_by(eq, day), 365e0 / count(*)) - 1) / nullif(max(1 - eq / peak), 0), 5) AS calmar FROM {sleeve_curves} GROUP BY cfg")
query("a06_cvar_by_sleeve", "SELECT cfg, round(v, 8) AS var_95, round(avg(CASE WHEN r <= v THEN r END), 8) AS cvar_95 FROM {sleeve_days} JOIN (SELECT cfg, percentile_cont(0.05) WITHIN GROUP (ORDER BY r) AS v FROM {sleeve_days} GROUP BY cfg) USING (cfg) GROUP BY cfg, v")
query("s18_cumulative_equity", "SELECT cfg, day, round(eq, 8) AS equity FROM {sleeve_curves}")
query("a40_single_asset", "SELECT asset, count(*) AS days, round(max_by(close, day) / min_by(close, day) - 1, 6) AS total FROM {priced} GROUP BY asset")
derived("ensemble", "SELECT 'ensemble' AS cfg, day, avg(r) AS r FROM {sleeve_days} WHERE cfg IN ('trend', 'relative_strength', 'dip', 'capitulation', 'breakout') GROUP BY day")
query("x19_five_sleeve_ensemble", "SELECT day, round(r, 8) AS r FROM {ensemble}")

# ---------------------------------------------------------------- overlays: what depends on the overlaid curve

DAILY_TARGET = 0.02
derived("scaled", f"SELECT cfg, day, r, coalesce(least(1e0, {DAILY_TARGET} / nullif(vol, 0)), 1e0) AS e_vol, row_number() OVER (PARTITION BY cfg ORDER BY day) AS k FROM (SELECT *, CASE WHEN count(r) OVER (PARTITION BY cfg ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 10 THEN stddev_pop(r) OVER (PARTITION BY cfg ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS vol FROM (SELECT cfg, day, r FROM {{ensemble}} UNION ALL SELECT cfg, day, r FROM {{sleeve_days}} WHERE cfg = 'capitulation'))", write=True)


_ON = f"(CASE WHEN s.engaged THEN s.eq / s.peak - 1 < {REENTRY} ELSE s.eq / s.peak - 1 <= {TRIGGER} END)"
_SCALAR = f"(n.e_vol * CASE WHEN {_ON} THEN {FLOOR} ELSE 1e0 END)"
_BREAKER = f"""SELECT * FROM (WITH RECURSIVE s(cfg, k, day, scalar, overlaid, engaged, eq, peak) AS (SELECT DISTINCT cfg, 0::BIGINT, NULL::INT, 1::DOUBLE, 0::DOUBLE, false, 1::DOUBLE, 1::DOUBLE FROM scaled
  UNION ALL SELECT n.cfg, n.k, n.day::INT, {_SCALAR}, {_SCALAR} * n.r, {_ON}, s.eq * (1 + {_SCALAR} * n.r), greatest(s.peak, s.eq * (1 + {_SCALAR} * n.r)) FROM s JOIN scaled n ON n.cfg = s.cfg AND n.k = s.k + 1) SELECT cfg, day, scalar, overlaid, engaged, eq FROM s WHERE k > 0)"""
relation("broken", lambda t: circuit_breaker(t.get("scaled")), _BREAKER, "scaled", write=True)
query("x21_circuit_breaker", "SELECT cfg, day, round(scalar, 8) AS scalar, engaged, round(overlaid, 8) AS overlaid FROM {broken}")
derived("variants", "SELECT cfg, 'raw' AS variant, day, r, 1e0 AS e FROM {scaled} UNION ALL SELECT cfg, 'voltarget', day, e_vol * r, e_vol FROM {scaled} UNION ALL SELECT cfg, 'capped', day, overlaid, scalar FROM {broken}")
query("x22_overlay_variants", "SELECT cfg, variant, count(*) AS days, round(avg(e), 6) AS mean_scalar, round(min(e), 6) AS least_scalar, round(100 * avg(CASE WHEN e < 0.999 THEN 1e0 ELSE 0e0 END), 4) AS days_derisked_pct, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(365), 6) AS sharpe FROM {variants} GROUP BY cfg, variant")

# ---------------------------------------------------------------- venues, forward scoring, portfolio configurations

_VENUE = "CASE WHEN l_linenumber % 2 = 0 THEN 'second' ELSE 'reference' END"
_CELL = [f"{_VENUE} AS venue", "l_suppkey % 10 AS asset", "datediff(cast(l_shipdate AS date), date'1970-01-01') AS day"]
_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]


def last_of_cells(items: DataFrame) -> DataFrame:
    """(venue, asset, day, last): the last line item of each venue, asset and day, with its place and price.

    Spark sorts all rows to find the greatest structure of a group, but hashes groups to find the greatest number, so the
    greatest order comes first, and only its few items are compared as structures. Cells are as many as days, whatever the items.
    """
    rows = items.selectExpr(*_CELL, *_ORDER)
    newest = rows.groupBy("venue", "asset", "day").agg(F.max("l_orderkey").alias("newest"))
    c = F.broadcast(newest.withColumnsRenamed({x: f"_{x}" for x in ("venue", "asset", "day")}))
    kept = rows.join(c, F.expr("venue = _venue AND asset <=> _asset AND day <=> _day AND l_orderkey <=> newest"), "left_semi")
    return kept.groupBy("venue", "asset", "day").agg(F.expr(f"max(struct(struct({', '.join(_ORDER)}) AS ord, l_extendedprice / l_quantity AS price)) AS last"))


relation(
    "venues", lambda t: last_of_cells(t.get("t_lineitem")).selectExpr("venue", "asset", "day", "1000 + last.price / 20 AS close"),
    f"SELECT {_VENUE} AS venue, l_suppkey % 10 AS asset, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS day, 1000 + last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) / 20 AS close FROM lineitem GROUP BY ALL",
    write=True,
)
derived("sealing", "SELECT max(day) - 365 AS cutoff FROM {venues} WHERE venue = 'reference'")
query("s08_second_venue_panel", "SELECT v.asset, v.day, round(v.close, 4) AS close FROM {venues} v JOIN (SELECT DISTINCT asset FROM {venues} WHERE venue = 'reference') u ON u.asset = v.asset CROSS JOIN {sealing} WHERE v.venue = 'second' AND v.day < cutoff")
query("s14_cross_venue_load", "SELECT venue, asset, count(*) AS days, min(day) AS first_day, max(day) AS last_day FROM {venues} WHERE asset IN (0, 1, 2) OR venue = 'reference' GROUP BY venue, asset")
derived(
    "venue_days",
    """SELECT venue, day, avg(CASE WHEN place <= 3 THEN nxt END) - avg(CASE WHEN place > names - 3 THEN nxt END) AS r FROM (SELECT *, row_number() OVER (PARTITION BY venue, day ORDER BY score DESC, asset) AS place, count(*) OVER (PARTITION BY venue, day) AS names FROM (
      SELECT venue, asset, day, close / lag(close, 5) OVER (PARTITION BY venue, asset ORDER BY day) - 1 AS score, lead(close) OVER (PARTITION BY venue, asset ORDER BY day) / close - 1 AS nxt FROM {venues}) WHERE score IS NOT NULL AND nxt IS NOT NULL) WHERE names >= 6 GROUP BY venue, day""",
)
derived("venue_parts", "SELECT venue, CASE WHEN day >= cutoff THEN 'lockbox' ELSE 'in_sample' END AS part, count(*) AS n, avg(r) / nullif(stddev_samp(r), 0) AS sharpe, avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*)) AS tstat, exp(sum(ln(greatest(1 + r, 1e-9)))) - 1 AS total FROM {venue_days} CROSS JOIN {sealing} GROUP BY venue, CASE WHEN day >= cutoff THEN 'lockbox' ELSE 'in_sample' END", write=True)
query("x23_second_venue", f"SELECT venue, part, n, round(sharpe, 6) AS sharpe, round(tstat, 6) AS tstat, round({normal_cdf('tstat')}, 5) AS one_trial_dsr FROM {{venue_parts}}")
query("u02_venue_rows", "SELECT venue, part, n, round(sharpe, 6) AS sharpe FROM {venue_parts} WHERE venue = 'reference' UNION ALL SELECT venue, part, n, round(sharpe, 6) AS sharpe FROM {venue_parts} WHERE venue <> 'reference'")
query("j15_replication", "SELECT v.venue, round(v.sharpe, 6) AS sharpe, round(v.tstat, 6) AS tstat, CASE WHEN v.sharpe > 0 AND v.tstat >= 1.5 THEN 'replicates' ELSE 'does not replicate' END AS verdict, v.sharpe * r.sharpe > 0 AS same_sign FROM {venue_parts} v JOIN {venue_parts} r ON r.venue = 'reference' AND r.part = 'lockbox' WHERE v.venue <> 'reference' AND v.part = 'lockbox'")
derived("forward", "SELECT cfg, day, r FROM {sleeve_days} WHERE day > (SELECT max(day) - 200 FROM {panel})")
query("p16_forward_only", "SELECT cfg, day, round(r, 8) AS r FROM {forward}")
query("x24_forward_scores", "SELECT cfg, count(*) AS n, round(avg(r) / nullif(stddev_samp(r), 0), 6) AS sharpe_per_obs, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*)), 6) AS tstat, round(exp(sum(ln(greatest(1 + r, 1e-9)))) - 1, 6) AS total, max(day) AS data_end FROM {forward} GROUP BY cfg")
_PICK = lambda values, stream: f"CASE cast(floor({draw(stream, 'i')} * {len(values)}) AS int) " + " ".join(f"WHEN {j} THEN {v!r}" for j, v in enumerate(values)) + " END"
_FIELDS = {"family": ["momentum", "carry", "idio"], "lookback": [5, 10, 20, 30, 60, 90], "skip": [0, 1, 2], "k": [2, 3, 4, 5], "rebalance": [1, 3, 7, 14], "mode": ["equal", "score_prop", "vol_parity"], "gross": [0.5, 1.0, 2.0], "long_only": [0, 1], "neutral": [0, 1], "vol_window": [10, 20, 30], "scaled": [0, 1], "blend": [0.0, 0.3, 0.5], "min_names": [6, 8], "cost": [5, 10, 15]}
derived("portfolio_configs", "SELECT i AS cfg, " + ", ".join(f"{_PICK(v, 20 + j)} AS {k}" for j, (k, v) in enumerate(_FIELDS.items())) + " FROM {numbers} WHERE i < 200")
#: Only those that the panel's names and days allow.
query("c02_portfolio_configs", f"SELECT cfg, {', '.join(k if k not in ('gross', 'blend') else f'cast({k} AS double) AS {k}' for k in _FIELDS)}, cast(floor(days / cast(rebalance AS double)) AS bigint) AS periods FROM {{portfolio_configs}} JOIN (SELECT count(DISTINCT asset) AS names, count(DISTINCT day) AS days FROM {{panel}}) ON names >= greatest(min_names, 2 * k) AND days >= lookback + skip")
#: Curated configurations with what the panel gives each: names with a whole look-back, rebalances, and the share of names whose momentum over it is positive.
query(
    "c26_curated_configs",
    """SELECT name, c.lookback, k, rebalance, tag, count(*) AS names, cast(floor(max(days) / max(cast(rebalance AS double))) AS bigint) AS periods, round(avg(CASE WHEN last_close > first_close THEN 1e0 ELSE 0e0 END), 6) AS rising FROM (SELECT 'carry_weekly' AS name, 7 AS lookback, 4 AS k, 7 AS rebalance, 'alpha' AS tag UNION ALL SELECT 'momentum_monthly', 30, 3, 30, 'alpha' UNION ALL SELECT 'long_only_trend', 60, 5, 7, 'beta') c
    JOIN (SELECT asset, l.lookback, max_by(close, day) AS last_close, min_by(close, day) AS first_close, count(*) AS held FROM (SELECT p.asset, p.day, p.close, max(day) OVER (PARTITION BY asset) AS newest FROM {panel} p) p JOIN (SELECT 7 AS lookback UNION ALL SELECT 30 UNION ALL SELECT 60) l ON p.day > newest - l.lookback GROUP BY asset, l.lookback) m ON m.lookback = c.lookback
    CROSS JOIN (SELECT count(DISTINCT day) AS days FROM {panel}) GROUP BY name, c.lookback, k, rebalance, tag""",
)
