"""Configurations as rows, their trades, and what is counted over them.

`configs` holds one row per configuration and cost scenario; breakout signals of all of them come from one pass over
bars: a row for each bar and look-back that it breaks, which configurations of that look-back are joined to. `trades` has every candidate trade, `taken` those of one
position at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions.dialect import draw, spark_text
from barlab.functions.features import TRUE_RANGE
from barlab.functions.layers import Layer, full, layers_sql, over
from barlab.functions.series import indexed, previous, running
from barlab.operators.ledger import RULES, barrier_exits, held_bars, one_at_a_time, sized
from barlab.operators.quantiles import exact_quantiles
from barlab.plans.frame import framed
from barlab.plans.relations import Tables, computed, derived, query, relation
from barlab.plans.signals import side_of
from barlab.plans.strategies import GK

LENGTHS = range(17, 24)


#: (parameter, kind, low, high, present value)
SPACE = [("lookback", "int", 10, 40, 20), ("stop_mult", "float", 1.0, 4.0, 2.0), ("target_mult", "float", 1.5, 6.0, 3.0), ("hours", "int", 12, 48, 24)]


def near(k: int) -> str:
    """The parameter moved by up to a tenth of its range, kept in it, rounded where it is whole."""
    _, kind, lo, hi, now = SPACE[k]
    value = f"least({hi}e0, greatest({lo}e0, {now}e0 + {(hi - lo) / 10!r}e0 * (2 * ({draw(k, 'i')}) - 1)))"
    return f"cast(round({value}) AS int)" if kind == "int" else value


_COSTS = [("base", 5.0, 1.0, 1), ("stress", 20.0, 1.5, 1), ("lag0", 5.0, 1.0, 0)] + [(f"slip_{x}", float(x), 1.0, 1) for x in (10, 20, 30, 50, 75, 100)]
_FIXED = " UNION ALL ".join(f"SELECT '{n}' AS cfg, 20 AS lookback, 2e0 AS stop_mult, 3e0 AS target_mult, 24 AS hours, {bps / 1e4!r}e0 AS slip, {1e-3 * fee!r}e0 AS fee, {lag} AS lag" for n, bps, fee, lag in _COSTS).replace("e-05e0", "e-05").replace("e-0", "e-0")
derived("configs", f"{_FIXED} UNION ALL SELECT concat('near_', cast(i AS string)), {near(0)}, {near(1)}, {near(2)}, {near(3)}, 5e-4, 1e-3, 1 FROM {{numbers}} WHERE i < 24")

_CHANNELS: list[Layer] = [
    TRUE_RANGE,
    {"atr": full("avg", "tr", 14), **{f"up_{n}": f"max(high) {over(n, skip=1)}" for n in LENGTHS}, **{f"dn_{n}": f"min(low) {over(n, skip=1)}" for n in LENGTHS}, **{f"next_{c}": f"lead({c}) OVER (PARTITION BY symbol ORDER BY hour)" for c in ("hour", "open", "close")}},
]
#: The given prices go from nothing to hundreds within hours; on a base of 100 their returns are those of a wild market.
_BASED = ["symbol", "hour", *(f"100 + {c} / 10 AS {c}" for c in ("open", "high", "low", "close")), "volume"]


relation("b", lambda t: framed(indexed(t.get("bars").selectExpr(*_BASED)), _CHANNELS, 64, 1), layers_sql(f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY hour) - 1 AS _i FROM (SELECT {', '.join(_BASED)} FROM bars)", _CHANNELS), "bars", write=True)
_SIDES_OF = ", ".join(f"CASE WHEN close > up_{n} THEN 1 WHEN close < dn_{n} THEN -1 END" for n in LENGTHS)
#: A row for each bar and look-back whose channel it breaks; configurations are joined on the look-back.
_BAR = "symbol, hour, close, next_hour, next_open, atr, _i"
_TAKES_PART = "atr > 0 AND _i > 23 AND next_open IS NOT NULL"
relation(
    "breaks",
    lambda t: t.get("b").where(_TAKES_PART).selectExpr(*_BAR.split(", "), f"posexplode(array({_SIDES_OF})) AS (k, side)").where("side IS NOT NULL").selectExpr(*_BAR.split(", "), f"k + {LENGTHS[0]} AS lookback", "side"),
    f"SELECT * FROM (SELECT {_BAR}, unnest(range({LENGTHS[0]}, {LENGTHS[-1] + 1})) AS lookback, unnest([{_SIDES_OF}]) AS side FROM b WHERE {_TAKES_PART}) WHERE side IS NOT NULL",
    "b",
)
SIGNALS = f"""SELECT symbol, cfg, CASE WHEN lag = 0 THEN hour ELSE next_hour END AS fill_hour, CASE WHEN lag = 0 THEN hour + 1 ELSE next_hour END AS from_hour, CASE WHEN lag = 0 THEN close ELSE next_open END AS fill, side, atr, hours, slip, fee,
    CASE WHEN lag = 0 THEN close ELSE next_open END - side * stop_mult * atr AS stop, CASE WHEN lag = 0 THEN close ELSE next_open END + side * target_mult * atr AS target
    FROM (SELECT x.*, c.cfg, c.stop_mult, c.target_mult, c.hours, c.slip, c.fee, c.lag FROM {{breaks}} x JOIN {{configs}} c ON c.lookback = x.lookback)"""
derived("signals", SIGNALS)

#: From exits to results on a notional of 100: slippage against the trade on both legs, commission on both, funding of one basis point a notional and eight hours.
_PRICED = "fill * (1 + side * slip) AS entry_price, exit_raw * (1 - side * slip) AS exit_price"
_BOOKED = "100 * side * (exit_price / entry_price - 1) AS gross, 200 * fee AS commission, 100 * 1e-4 * bars_held / 8 AS funding, 100 * (side * (exit_raw / fill - 1) - side * (exit_price / entry_price - 1)) AS slippage"
_NET = "gross - commission - funding AS net, (gross - commission - funding) / 100 AS ret"
_COLUMNS = "symbol, cfg, fill_hour AS entry_hour, exit_hour, side, entry_price, exit_price, exit_reason, bars_held, atr, fill, stop, target, gross, commission, funding, slippage, net, ret"


def booked(exits: DataFrame) -> DataFrame:
    return exits.selectExpr("*", *_PRICED.split(", ")).selectExpr("*", *_BOOKED.split(", ")).selectExpr("*", *_NET.split(", ")).selectExpr(*_COLUMNS.split(", "))


def booked_sql(exits: str) -> str:
    return f"SELECT {_COLUMNS} FROM (SELECT *, {_NET} FROM (SELECT *, {_BOOKED} FROM (SELECT *, {_PRICED} FROM ({exits}))))"


def exits_sql(signals: str, bars_: str, flag: str = "false") -> str:
    """Every signal with its first barrier, else the first bar at or after the time stop, else the last bar."""
    return f"""SELECT s.*, coalesce(hit.h, t.h, e.h) AS exit_hour, coalesce(hit.p, t.c, e.c) AS exit_raw, coalesce(hit.reason, CASE WHEN t.h IS NOT NULL THEN 'time_stop' ELSE 'end_of_data' END) AS exit_reason, coalesce(hit.i, t.i, e.i) - f.i AS bars_held FROM {signals} s
    JOIN (SELECT symbol AS fs, hour AS fh, _i AS i FROM {bars_}) f ON fs = s.symbol AND fh = s.fill_hour
    LEFT JOIN LATERAL (SELECT CASE WHEN r = 'signal_exit' THEN next_hour ELSE hour END AS h, r AS reason, CASE r WHEN 'stop_loss' THEN s.stop WHEN 'take_profit' THEN s.target ELSE next_open END AS p, CASE WHEN r = 'signal_exit' THEN _i + 1 ELSE _i END AS i FROM (
      SELECT x.*, CASE WHEN (s.side = 1 AND x.low <= s.stop) OR (s.side = -1 AND x.high >= s.stop) THEN 'stop_loss' WHEN (s.side = 1 AND x.high >= s.target) OR (s.side = -1 AND x.low <= s.target) THEN 'take_profit' WHEN {flag} AND next_hour IS NOT NULL THEN 'signal_exit' END AS r
      FROM {bars_} x WHERE x.symbol = s.symbol AND x.hour >= s.from_hour AND x.hour < s.fill_hour + s.hours) WHERE r IS NOT NULL ORDER BY hour LIMIT 1) hit ON true
    LEFT JOIN LATERAL (SELECT hour AS h, close AS c, _i AS i FROM {bars_} x WHERE x.symbol = s.symbol AND x.hour >= s.fill_hour + s.hours ORDER BY x.hour LIMIT 1) t ON true
    LEFT JOIN LATERAL (SELECT hour AS h, close AS c, _i AS i FROM {bars_} x WHERE x.symbol = s.symbol ORDER BY hour DESC LIMIT 1) e ON true"""


#: The chain of trades each of which is the first at or after the exit of the one before.
def taken_sql(trades: str) -> str:
    return f"""SELECT t.* FROM {trades} t JOIN (WITH RECURSIVE p AS (SELECT symbol, cfg, entry_hour, (SELECT min(y.entry_hour) FROM {trades} y WHERE y.symbol = x.symbol AND y.cfg = x.cfg AND y.entry_hour >= x.exit_hour AND y.entry_hour > x.entry_hour) AS nxt FROM {trades} x),
      c(symbol, cfg, here) AS (SELECT symbol, cfg, min(entry_hour) FROM {trades} GROUP BY symbol, cfg UNION ALL SELECT c.symbol, c.cfg, p.nxt FROM c JOIN p ON p.symbol = c.symbol AND p.cfg = c.cfg AND p.entry_hour = c.here WHERE p.nxt IS NOT NULL) SELECT * FROM c) c
    ON c.symbol = t.symbol AND c.cfg = t.cfg AND c.here = t.entry_hour"""


relation("trades", lambda t: booked(barrier_exits(t.get("b"), t.get("signals"))), booked_sql(exits_sql("signals", "b")), "b", "signals", write=True)
relation("taken", lambda t: one_at_a_time(t.get("trades")), taken_sql("trades"), "trades", write=True)

# ---------------------------------------------------------------- the ledger

query("c04_neighbours", "SELECT c.cfg, lookback, round(stop_mult, 6) AS stop_mult, round(target_mult, 6) AS target_mult, c.hours, count(t.net) AS trades, round(coalesce(sum(t.net), 0), 6) AS net FROM {configs} c LEFT JOIN {taken} t ON t.cfg = c.cfg WHERE c.cfg LIKE 'near%' GROUP BY c.cfg, lookback, stop_mult, target_mult, c.hours")
query("t09_taken_trades", "SELECT symbol, cfg, entry_hour, exit_hour, side, exit_reason, round(net, 6) AS net FROM {taken}")
query("t04_funding_accrual", "SELECT symbol, entry_hour, bars_held, round(funding, 8) AS funding FROM {taken} WHERE cfg = 'base'")
query("t15_return_on_notional", "SELECT symbol, entry_hour, side, round(ret, 8) AS ret FROM {taken} WHERE cfg = 'base'")
query("a09_holding_hours", "SELECT symbol, cfg, round(avg(exit_hour - entry_hour), 6) AS hours, count(*) AS trades FROM {taken} GROUP BY symbol, cfg")
query("a10_cost_totals", "SELECT symbol, cfg, round(sum(commission), 6) AS commission, round(sum(slippage), 6) AS slippage, round(sum(funding), 6) AS funding, round(sum(gross), 6) AS gross, round(sum(net), 6) AS net, abs(round(sum(gross) - sum(commission) - sum(funding) - sum(net), 6)) AS left_over FROM {taken} GROUP BY symbol, cfg")
query("t16_cost_scenarios", "SELECT cfg, count(*) AS trades, round(sum(net), 6) AS net, round(sum(CASE WHEN net > 0 THEN net END) / nullif(-sum(CASE WHEN net <= 0 THEN net END), 0), 6) AS profit_factor FROM {taken} WHERE cfg NOT LIKE 'near%' GROUP BY cfg")
query("a38_break_even_slippage", "SELECT symbol, min(CASE WHEN won <= lost THEN bps END) AS break_even_bps FROM (SELECT symbol, cast(CASE WHEN cfg = 'base' THEN 5e0 ELSE cast(replace(cfg, 'slip_', '') AS double) END AS int) AS bps, coalesce(sum(CASE WHEN net > 0 THEN net END), 0) AS won, -coalesce(sum(CASE WHEN net <= 0 THEN net END), 0) AS lost FROM {taken} WHERE cfg = 'base' OR cfg LIKE 'slip%' GROUP BY symbol, cfg) GROUP BY symbol")
query("j07_configs_by_symbol", "SELECT cfg, symbol, count(*) AS trades, round(sum(net), 6) AS net FROM {taken} WHERE cfg LIKE 'near%' GROUP BY cfg, symbol")

# ---------------------------------------------------------------- equity by bar

#: Capital of 1000; what is booked by a bar, and the open trade at the bar's close.
_WATCHED = "cfg IN ('base', 'stress', 'lag0') OR cfg LIKE 'near%'"


def _equity(t: Tables) -> DataFrame:
    taken, b = t.get("taken").where(_WATCHED), t.get("b")
    bars_ = taken.select("symbol", "cfg").distinct().join(b.select("symbol", "hour", "_i"), "symbol")
    done = taken.groupBy("symbol", "cfg", F.col("exit_hour").alias("hour")).agg(F.sum("net").alias("done"))
    open_ = held_bars(taken, b).selectExpr("symbol", "cfg", "p_hour AS hour", "100 * side * (p_close / entry_price - 1) AS open_result")
    rows = bars_.join(done, ["symbol", "cfg", "hour"], "left").join(open_, ["symbol", "cfg", "hour"], "left")
    return running(rows, {"booked": ("sum", "done")}, ["symbol", "cfg"], "hour").selectExpr("symbol", "cfg", "hour", "_i", "1000 + booked + coalesce(open_result, 0) AS equity")


relation(
    "equity",
    _equity,
    """SELECT symbol, cfg, hour, _i, 1000 + booked + open_result AS equity FROM (
      SELECT symbol, cfg, hour, _i, sum(coalesce(done, 0)) OVER (PARTITION BY symbol, cfg ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS booked, coalesce(open_result, 0) AS open_result FROM (
        SELECT g.symbol, g.cfg, g.hour, g._i, x.done, o.open_result FROM (SELECT symbol, cfg, hour, _i, close FROM (SELECT DISTINCT symbol, cfg FROM taken WHERE cfg IN ('base', 'stress', 'lag0') OR cfg LIKE 'near%') JOIN b USING (symbol)) g
        LEFT JOIN (SELECT symbol, cfg, exit_hour AS hour, sum(net) AS done FROM taken GROUP BY symbol, cfg, exit_hour) x ON x.symbol = g.symbol AND x.cfg = g.cfg AND x.hour = g.hour
        LEFT JOIN (SELECT p.symbol, t.cfg, p.hour, 100 * t.side * (p.close / t.entry_price - 1) AS open_result FROM taken t JOIN b p ON p.symbol = t.symbol AND p.hour >= t.entry_hour AND p.hour < t.exit_hour AND p.hour < t.entry_hour + 49) o ON o.symbol = g.symbol AND o.cfg = g.cfg AND o.hour = g.hour))""",
    "taken",
    "b",
    write=True,
)
query("t13_marked_equity", "SELECT symbol, hour, round(equity, 6) AS equity FROM {equity} WHERE cfg = 'base'")
#: The sealed part begins ten days before a symbol's last bar.


def _marked(t: Tables) -> DataFrame:
    key = ["symbol", "cfg"]
    rows = running(previous(t.get("equity"), {"_before": "equity"}, key, "hour"), {"peak": ("max", "equity")}, key, "hour")
    last = t.get("equity").groupBy("symbol").agg(F.max("hour").alias("_last"))
    return rows.join(last, "symbol").selectExpr("symbol", "cfg", "hour", "_i", "equity", "equity / _before - 1 AS r", "peak", "CASE WHEN hour >= _last - 240 THEN 'sealed' ELSE 'in_sample' END AS segment")


relation(
    "marked",
    _marked,
    """SELECT *, equity / lag(equity) OVER (PARTITION BY symbol, cfg ORDER BY hour) - 1 AS r, max(equity) OVER (PARTITION BY symbol, cfg ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak,
    CASE WHEN hour >= max(hour) OVER (PARTITION BY symbol) - 240 THEN 'sealed' ELSE 'in_sample' END AS segment FROM equity""",
    "equity",
    write=True,
)
#: Rows since the latest peak have its number; a drawdown may go over any number of chunks.
relation("since_peaks", lambda t: running(t.get("marked"), {"peaks": ("sum", "CASE WHEN equity >= peak THEN 1L ELSE 0L END")}, ["symbol", "cfg"], "hour"), "SELECT *, sum(CASE WHEN equity >= peak THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, cfg ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peaks FROM marked", "marked")
query("a04_longest_drawdown", "SELECT symbol, cfg, max(n) AS longest_drawdown_bars, round(100 * max(depth), 6) AS max_drawdown_pct FROM (SELECT symbol, cfg, peaks, count(*) - 1 AS n, max(1 - equity / peak) AS depth FROM {since_peaks} GROUP BY symbol, cfg, peaks) GROUP BY symbol, cfg")
query(
    "a01_annualised",
    """SELECT symbol, cfg, round(total, 8) AS total, round(annual, 6) AS annual_return, round(sd * sqrt(8760), 6) AS volatility, round(m / nullif(sd, 0) * sqrt(8760), 6) AS sharpe, round(m / nullif(down, 0) * sqrt(8760), 6) AS sortino, round(annual / nullif(dd, 0), 6) AS calmar
    FROM (SELECT symbol, cfg, max_by(equity, hour) / min_by(equity, hour) - 1 AS total, pow(max_by(equity, hour) / min_by(equity, hour), 8760e0 / count(r)) - 1 AS annual, avg(r) AS m, stddev_samp(r) AS sd, stddev_samp(CASE WHEN r < -1e-12 THEN r END) AS down, max(1 - equity / peak) AS dd FROM {marked} GROUP BY symbol, cfg)""",
)
relation("var_95", lambda t: exact_quantiles(t.get("marked"), ["symbol", "cfg"], "r", [0.05]).selectExpr("symbol", "cfg", "q[0] AS var_95"), "SELECT symbol, cfg, percentile_cont(0.05) WITHIN GROUP (ORDER BY r) AS var_95 FROM marked WHERE r IS NOT NULL GROUP BY symbol, cfg", "marked")
query("a06_value_at_risk", "SELECT m.symbol, m.cfg, round(var_95, 8) AS var_95, round(avg(CASE WHEN r <= var_95 + 1e-12 THEN r END), 8) AS cvar_95 FROM {marked} m JOIN {var_95} v ON v.symbol = m.symbol AND v.cfg = m.cfg GROUP BY m.symbol, m.cfg, var_95")

# ---------------------------------------------------------------- a signal's own exit, a trailing stop, sizing

_REVERSION = side_of("g02_mean_reversion")
_EXIT = f"SELECT symbol, 'reversion' AS cfg, next_hour AS fill_hour, next_hour AS from_hour, next_open AS fill, side, atr_14 AS atr, 18 AS hours, 5e-4 AS slip, 1e-3 AS fee, next_open - side * 3 * atr_14 AS stop, next_open + side * 2.5 * atr_14 AS target FROM (SELECT *, {_REVERSION} AS side FROM {{g}}) WHERE side IS NOT NULL AND next_open IS NOT NULL"
_AHEAD: Layer = {f"next_{c}": f"lead({c}) OVER (PARTITION BY symbol ORDER BY hour)" for c in ("hour", "open", "close")}
relation("g", lambda t: framed(t.get("f"), [_AHEAD], 1, 1), layers_sql("SELECT * FROM f", [_AHEAD]), "f", write=True)
_REVERTED = "coalesce(abs(ret_zscore_20) < 0.3, false)"
derived("reversions", _EXIT)
relation("reversion_trades", lambda t: booked(barrier_exits(t.get("g"), t.get("reversions"), _REVERTED)), booked_sql(exits_sql("reversions", "g", _REVERTED)), "g", "reversions")
query("t07_signal_exit", "SELECT symbol, entry_hour, exit_hour, side, exit_reason, round(net, 6) AS net FROM {reversion_trades}")
relation("open_bars", lambda t: held_bars(t.get("taken").where("cfg = 'base'").select("symbol", "entry_hour", "exit_hour", "atr", "side", "fill"), t.get("b"), last=True), "SELECT t.symbol, t.entry_hour, t.exit_hour, t.atr, t.side, t.fill, p.hour AS p_hour, p.close AS p_close, p.high AS p_high, p.low AS p_low FROM taken t JOIN b p ON p.symbol = t.symbol AND p.hour >= t.entry_hour AND p.hour <= t.exit_hour AND p.hour < t.entry_hour + 49 WHERE t.cfg = 'base'", "taken", "b")
query(
    "w54_trailing_stop",
    """SELECT symbol, entry_hour, min(hour) AS trail_hour FROM (
      SELECT *, max(CASE WHEN gain >= atr THEN gain - 1.5 * atr END) OVER (PARTITION BY symbol, entry_hour ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS trail FROM (
        SELECT symbol, entry_hour, p_hour AS hour, atr, side * (p_close - fill) AS gain, CASE WHEN side = 1 THEN p_low - fill ELSE fill - p_high END AS worst FROM {open_bars}))
    WHERE worst <= trail GROUP BY symbol, entry_hour""",
)
# ---------------------------------------------------------------- two signals with features of their own beside the frame's fourteen-bar RSI

_VOL_REGIME: list[Layer] = [*GK, {"slope": f"regr_slope(close, _i) {over(10)}", "calm": f"sum(CASE WHEN gk_z < 0 THEN 1 ELSE 0 END) {over(10, skip=1)}"}, {"side": "CASE WHEN calm >= 5 AND gk_ratio > 1.1 AND slope > 0 THEN 1 WHEN calm >= 5 AND gk_ratio > 1.1 AND slope < 0 THEN -1 WHEN gk_z > 2 AND rsi_14 < 45 THEN 1 WHEN gk_z > 2 AND rsi_14 > 55 THEN -1 END"}]
_OBV: list[Layer] = [{"past": "lag(close, 10) OVER (PARTITION BY symbol ORDER BY hour)"}, {"side": "CASE WHEN close < past AND obv_divergence > 0 AND rsi_14 < 60 THEN 1 WHEN close > past AND obv_divergence < 0 AND rsi_14 > 40 THEN -1 END"}]
for _name, _layers, _shown in (("g12_vol_regime_arb", _VOL_REGIME, ["gk_z", "gk_ratio", "rsi_14"]), ("g21_obv_divergence", _OBV, ["obv_divergence", "rsi_14"])):
    _used = "symbol, hour, _i, open, high, low, close, rsi_14, obv_divergence"
    _out = ["symbol", "hour", "side", *(f"round({c}, 6) AS {c}" for c in _shown)]
    computed(_name, lambda t, x=_layers, u=_used, o=_out: framed(t.get("f").select(*u.split(", ")), x, 128).where("side IS NOT NULL").selectExpr(*o), f"SELECT {', '.join(_out)} FROM ({layers_sql(f'SELECT {_used} FROM f', _layers)}) WHERE side IS NOT NULL", "f")

_R = RULES
_DAILY = "CASE WHEN n.entry_hour // 24 > s.day THEN 0e0 ELSE s.lost END"
_VOL = f"least({_R['cap']}e0, CASE WHEN n.atr > 0 AND n.fill > 0 THEN {_R['target_vol']}e0 / greatest(n.atr / n.fill * sqrt(365), 0.01) ELSE 0.05 END)"
_BROKEN = f"(s.broken OR (s.peak - s.equity) / s.peak * 100 >= {_R['breaker_pct']})"
_VERDICT = f"CASE WHEN {_BROKEN} THEN 'circuit_breaker' WHEN {_DAILY} < 0 AND -({_DAILY}) / s.equity * 100 >= {_R['daily_pct']} THEN 'daily_loss_limit' WHEN s.last IS NOT NULL AND n.entry_hour - s.last < {_R['hours_between']} THEN 'min_interval' ELSE 'approved' END"
_PNL = f"CASE WHEN {_VERDICT} = 'approved' THEN {_VOL} * s.equity * n.ret ELSE 0e0 END"
_LEDGER = f"""SELECT * FROM (WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY symbol, cfg ORDER BY entry_hour) AS k FROM taken WHERE cfg IN ('base', 'stress')),
  s(symbol, cfg, k, entry_hour, equity, peak, day, lost, last, broken, losses, verdict, size_fixed, size_kelly, size_volatility, pnl) AS (
    SELECT DISTINCT symbol, cfg, 0::BIGINT, NULL::BIGINT, {_R['capital']}::DOUBLE, {_R['capital']}::DOUBLE, -1::BIGINT, 0::DOUBLE, NULL::BIGINT, false, 0::BIGINT, NULL::VARCHAR, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM n
    UNION ALL SELECT n.symbol, n.cfg, n.k, n.entry_hour, s.equity + {_PNL}, greatest(s.peak, s.equity + {_PNL}), greatest(s.day, n.entry_hour // 24), {_DAILY} + {_PNL}, CASE WHEN {_VERDICT} = 'approved' THEN n.exit_hour ELSE s.last END, {_BROKEN},
      CASE WHEN {_VERDICT} <> 'approved' THEN s.losses WHEN {_PNL} < 0 THEN s.losses + 1 ELSE 0 END, {_VERDICT}, 0.1 * s.equity, {_R['kelly']} * s.equity, {_VOL} * s.equity, {_PNL} FROM s JOIN n ON n.symbol = s.symbol AND n.cfg = s.cfg AND n.k = s.k + 1)
  SELECT symbol, cfg, entry_hour, verdict, size_fixed, size_kelly, size_volatility, pnl, equity, losses FROM s WHERE k > 0)"""
relation("sized", lambda t: sized(t.get("taken").where("cfg IN ('base', 'stress')")), _LEDGER, "taken")
query("t11_position_sizes", "SELECT symbol, cfg, entry_hour, round(size_fixed, 6) AS size_fixed, round(size_kelly, 6) AS size_kelly, round(size_volatility, 6) AS size_volatility FROM {sized}")
query("t12_risk_rules", "SELECT symbol, cfg, entry_hour, verdict, round(pnl, 6) AS pnl, round(equity, 6) AS equity, losses FROM {sized}")

# ---------------------------------------------------------------- resampling

#: (method, simulation, place) -> the place drawn: a permutation by sorted draws, single trades, blocks of max(3, n / 10) trades.


def placed(rows: DataFrame, order: str) -> DataFrame:
    """Rows with their place in the symbol's order from 0, and how many it has."""
    return running(rows, {"pos": ("sum", "1L")}, ["symbol"], order, exclusive=True).join(rows.groupBy("symbol").agg(F.count("*").alias("n")), "symbol")


relation("results", lambda t: placed(t.get("taken").where("cfg = 'base'").select("symbol", "net", "entry_hour"), "entry_hour").drop("entry_hour"), "SELECT symbol, net, row_number() OVER (PARTITION BY symbol ORDER BY entry_hour) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM taken WHERE cfg = 'base'", "taken", write=True)
_SIMS = 100
_BLOCK = "greatest(3, cast(floor(n / 10) AS bigint))"
derived(
    "simulated",
    f"""SELECT d.symbol, d.method, d.sim, d.slot, r.net, d.n FROM (
      SELECT symbol, 'shuffle' AS method, sim, pos AS draw, row_number() OVER (PARTITION BY symbol, sim ORDER BY u, pos) - 1 AS slot, n FROM (SELECT symbol, pos, n, i AS sim, {draw(5, 'symbol', 'i', 'pos')} AS u FROM {{results}} CROSS JOIN {{numbers}} WHERE i < {_SIMS})
      UNION ALL SELECT symbol, 'bootstrap', i, cast(floor(({draw(7, 'symbol', 'i', 'pos')}) * n) AS bigint), pos, n FROM {{results}} CROSS JOIN {{numbers}} WHERE i < {_SIMS}
      UNION ALL SELECT symbol, 'block_bootstrap', i, cast(floor(({draw(9, 'symbol', 'i', f'cast(floor(pos / {_BLOCK}) AS bigint)')}) * greatest(1, n - {_BLOCK})) AS bigint) + pos % {_BLOCK}, pos, n FROM {{results}} CROSS JOIN {{numbers}} WHERE i < {_SIMS}) d
    JOIN {{results}} r ON r.symbol = d.symbol AND r.pos = d.draw""",
)
derived(
    "runs",
    """SELECT symbol, method, sim, sum(net) AS pnl, max(100 * (peak - equity) / peak) AS dd, avg(net) / nullif(stddev_samp(net), 0) * sqrt(2 * max(n)) AS sharpe, avg(CASE WHEN net > 0 THEN 1e0 ELSE 0e0 END) AS win_rate FROM (
      SELECT *, greatest(200e0, max(equity) OVER (PARTITION BY symbol, method, sim ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM (
        SELECT *, 200 + sum(net) OVER (PARTITION BY symbol, method, sim ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM {simulated})) GROUP BY symbol, method, sim""",
)
SUMMARY = ", ".join(
    [f"round(avg({x}), 5) AS {n}_mean, round(median({x}), 5) AS {n}_median" for x, n in (("pnl", "pnl"), ("dd", "dd"))] + ["round(stddev_pop(pnl), 5) AS pnl_std"]
    + [f"round(percentile_cont({p / 100}) WITHIN GROUP (ORDER BY pnl), 5) AS pnl_p{p}" for p in (5, 25, 75, 95)] + ["round(percentile_cont(0.95) WITHIN GROUP (ORDER BY dd), 5) AS dd_p95"]
    + [f"round(percentile_cont({p / 100}) WITHIN GROUP (ORDER BY sharpe), 5) AS sharpe_p{p}" for p in (5, 95)] + [f"round(avg(CASE WHEN {c} THEN 1e0 ELSE 0e0 END), 6) AS {n}" for c, n in (("pnl > 0", "p_profit"), ("dd > 50", "p_ruin"), ("pnl > 100", "p_target"))]
    + ["round(avg(win_rate), 6) AS win_rate_mean, round(stddev_pop(win_rate), 6) AS win_rate_std"]
)
query("t17_resampled_trades", "SELECT symbol, method, sim, round(pnl, 6) AS pnl, round(dd, 6) AS max_drawdown_pct FROM {runs}")
query("a31_simulation_summary", f"SELECT symbol, method, count(*) AS sims, {SUMMARY} FROM {{runs}} GROUP BY symbol, method")
relation("bar_returns", lambda t: placed(t.get("marked").where("cfg = 'base' AND r IS NOT NULL").select("symbol", "r", "hour"), "hour").drop("hour"), "SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY hour) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM marked WHERE cfg = 'base' AND r IS NOT NULL", "marked", write=True)
query(
    "t18_bar_bootstrap",
    f"""SELECT symbol, sim, round(200 * (exp(sum(ln(1 + r))) - 1), 5) AS pnl, count(*) AS bars FROM (SELECT d.symbol, d.sim, r.r FROM (SELECT symbol, i AS sim, cast(floor(({draw(11, 'symbol', 'i', 'pos')}) * n) AS bigint) AS draw FROM {{bar_returns}} CROSS JOIN {{numbers}} WHERE i < 20) d
    JOIN {{bar_returns}} r ON r.symbol = d.symbol AND r.pos = d.draw) GROUP BY symbol, sim""",
)


def evaluate(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Trades, result and Sharpe ratio per trade of n seeded random configurations and every symbol, in one job from bars to statistics."""
    t = Tables(spark, sf_dir)
    lo, hi = LENGTHS[0], LENGTHS[-1]
    values = [f"{a}e0 + {b - a}e0 * {draw(60 + j, 'id')} AS {name}" for j, (name, _, a, b, _) in enumerate(SPACE) if name.endswith("mult")]
    columns = ["cast(id AS string) AS cfg", f"cast({lo} + floor({hi - lo + 1} * {draw(64, 'id')}) AS int) AS lookback", *values, f"cast(12 + floor(36 * {draw(65, 'id')}) AS int) AS hours", "5e-4 AS slip", "1e-3 AS fee", "1 AS lag"]
    configs = spark.range(n).selectExpr(*map(spark_text, columns))
    trades = booked(barrier_exits(t.get("b"), spark.sql(SIGNALS, breaks=t.get("breaks"), configs=configs)))
    return one_at_a_time(trades).groupBy("symbol", "cfg").agg(F.count("*").alias("trades"), F.sum("net").alias("net"), (F.avg("ret") / F.stddev_samp("ret")).alias("sharpe"))
