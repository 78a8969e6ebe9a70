"""Splits, labels, recursive indicators, gates, resampling and overlays, with their SQL; importing this adds them to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions.features import TRUE_RANGE
from barlab.functions.layers import Layer, add_layers, full, lag, layers_sql, lead, over, ratio, rounded
from barlab.functions.recursive import ewm_sql
from barlab.functions.series import ewms
from barlab.operators.trades import DONCHIAN
from barlab.plans.registry import _DAILY_SQL, _PANEL, _SIGNAL, _TRADES_SQL, _WITH_SIG, QUERIES, SQL, P, candidates, daily_returns, layered
from barlab.sources.bars import PANEL_SQL, bars, bars_sql, panel
from barlab.streaming.bars import stream_bars_query, stream_bars_sql


def derived(name: str, source, base: str, layers: list[Layer], out: list[str], where: str | None = None, with_sql: str = "") -> None:
    """A query of shared expressions over a source that SQL states with a WITH clause."""
    layered(name, source, base, layers, out, where)
    SQL[name] = f"{with_sql} {SQL[name]}"


# ---------------------------------------------------------------- splits and labels

_NO: Layer = {"rn": "row_number() OVER (PARTITION BY asset ORDER BY day)", "n": "count(*) OVER (PARTITION BY asset)"}
_WINDOWS: list[Layer] = [_NO, {"cutoff": "max(day) OVER (PARTITION BY asset) - 365"}, {"m": "sum(CASE WHEN day < cutoff THEN 1 ELSE 0 END) OVER (PARTITION BY asset)"}]
layered("p04_named_windows", panel, PANEL_SQL, [*_WINDOWS, {"segment": "CASE WHEN day >= cutoff THEN 'lockbox' WHEN 10 * rn <= 6 * m THEN 'train' ELSE 'val' END"}], ["asset", "day", "segment"])
layered("p07_equal_folds", panel, PANEL_SQL, [_NO, {"fold": "cast(floor((rn - 61) * 5e0 / nullif(n - 60, 0)) AS int)"}], ["asset", "day", "fold"], "rn > 60")
layered("p09_row_order_split", panel, PANEL_SQL, [_NO, {"role": "CASE WHEN 100 * rn <= 70 * n THEN 'train' WHEN 100 * rn <= 85 * n THEN 'val' ELSE 'test' END"}], ["asset", "day", "role"])
layered("p10_warm_up_drop", bars, bars_sql(), [{"rn": "row_number() OVER (PARTITION BY symbol ORDER BY hour)"}], ["symbol", "hour", "round(close, 6) AS close"], "rn > 50")
_AHEAD: list[Layer] = [{f"fwd_{h}": ratio(lead("close", h), "close") + " - 1" for h in (1, 6, 12, 24)}, {f"dir_{h}": f"CASE WHEN fwd_{h} IS NULL THEN NULL WHEN fwd_{h} > 0.01 THEN 1 WHEN fwd_{h} < -0.01 THEN -1 ELSE 0 END" for h in (1, 6, 12, 24)}]
layered("m13_horizon_labels", bars, bars_sql(), _AHEAD, rounded(["symbol", "hour", *(f"dir_{h}" for h in (1, 6, 12, 24))], [f"fwd_{h}" for h in (1, 6, 12, 24)]))
QUERIES["m17_bar_spacing"] = lambda s, d: add_layers(bars(s, d), [{"gap": f"hour - {lag('hour')}"}]).groupBy("symbol").agg(F.expr("percentile(gap, 0.5)").alias("hours"), F.count("gap").alias("gaps"))
SQL["m17_bar_spacing"] = f"SELECT symbol, quantile_cont(gap, 0.5)::DOUBLE AS hours, count(gap) AS gaps FROM ({layers_sql(bars_sql(), [{'gap': f'hour - {lag("hour")}'}])}) GROUP BY symbol"
QUERIES["s04_newest_bar"] = lambda s, d: bars(s, d).groupBy("symbol").agg(F.max("hour").alias("newest")).selectExpr("symbol", "newest", "max(newest) OVER () - newest < 2 AS fresh")
SQL["s04_newest_bar"] = f"SELECT symbol, max(hour) AS newest, max(max(hour)) OVER () - max(hour) < 2 AS fresh FROM ({bars_sql()}) GROUP BY symbol"

# ---------------------------------------------------------------- recursive indicators and their signals


def averaged(name: str, layers: list[Layer], averages: dict[str, tuple[str, float, int]], after: list[Layer], out: list[str], where: str | None = None) -> None:
    """Layers, then recursive averages (column: source, alpha, warm-up), then layers that use them."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = add_layers(bars(spark, sf_dir), layers)
        df = add_layers(ewms(df, averages), after)
        return (df.where(where) if where else df).selectExpr(*out)

    QUERIES[name] = query
    base = layers_sql(bars_sql(), layers)
    base = f"SELECT *, {', '.join(f'{ewm_sql(x, alpha, warm)} AS {to}' for to, (x, alpha, warm) in averages.items())} FROM ({base})"
    SQL[name] = f"SELECT {', '.join(out)} FROM ({layers_sql(base, after)})" + (f" WHERE {where}" if where else "")


_KELTNER = ([TRUE_RANGE, {"atr": full("avg", "tr", 14)}], {"middle": ("close", 2 / 21, 20)}, [{"kc_upper": "middle + 2 * atr", "kc_lower": "middle - 2 * atr"}])
averaged("w40_keltner", *_KELTNER, rounded(["symbol", "hour"], ["middle", "kc_upper", "kc_lower"]))
averaged("g06_keltner_breakout", *_KELTNER[:2], [*_KELTNER[2], {"side": "CASE WHEN close > kc_upper THEN 1 WHEN close < kc_lower THEN -1 END"}], rounded(["symbol", "hour", "side"], ["middle"]), "side IS NOT NULL")
#: The open of a smoothed candle is the mean of the open and close before it, the first one that of its own bar.
_HEIKIN: list[Layer] = [{"ha_close": "(open + high + low + close) / 4"}, {"ha_source": f"coalesce({lag('ha_close')}, (open + close) / 2)"}]
_COLOUR: Layer = {"ha_up": "CASE WHEN ha_close > ha_open THEN 1 ELSE 0 END"}
#: Candles of the current colour in a row, counted up to 12.
_RUNS: list[Layer] = [_COLOUR, {"turned": f"CASE WHEN {lag('ha_up')} = ha_up THEN 0 ELSE 1 END"}, {f"same_{n}": f"sum(turned) {over(n)}" for n in range(1, 12)}, {"colour_run": "1" + "".join(f" + CASE WHEN same_{n} = 0 THEN 1 ELSE 0 END" for n in range(1, 12))}]
averaged("w37_heikin_ashi", _HEIKIN, {"ha_open": ("ha_source", 0.5, 0)}, _RUNS, rounded(["symbol", "hour", "ha_up", "colour_run"], ["ha_open", "ha_close"]))
averaged(
    "g16_heikin_ashi_ema", _HEIKIN, {"ha_open": ("ha_source", 0.5, 0), "fast": ("close", 2 / 10, 9), "slow": ("close", 2 / 22, 21)},
    [_COLOUR, {"up": "CASE WHEN slow IS NOT NULL THEN CASE WHEN fast > slow THEN 1 ELSE 0 END END"}, {"was_up": lag("up")}, {"side": "CASE WHEN up = 1 AND was_up = 0 AND ha_up = 1 THEN 1 WHEN up = 0 AND was_up = 1 AND ha_up = 0 THEN -1 END"}],
    rounded(["symbol", "hour", "side"], ["fast", "slow"]), "side IS NOT NULL",
)


def g22_confirmation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakout signals that the daily direction known at the bar's close does not oppose."""
    signals = add_layers(bars(spark, sf_dir), DONCHIAN).where(_SIGNAL).select("symbol", "hour", "side")
    return signals.join(QUERIES["j01_confirmation"](spark, sf_dir), ["symbol", "hour"]).where("side * conf_1d >= 0").selectExpr("symbol", "hour", "side", "conf_1d", "side = conf_1d AS agrees")


QUERIES["g22_confirmation_gate"] = g22_confirmation_gate
SQL["g22_confirmation_gate"] = f"SELECT symbol, hour, side, conf_1d, side = conf_1d AS agrees FROM (SELECT symbol, hour, side FROM ({layers_sql(bars_sql(), DONCHIAN)}) WHERE {_SIGNAL}) JOIN ({SQL['j01_confirmation']}) USING (symbol, hour) WHERE side * conf_1d >= 0"

# ---------------------------------------------------------------- equity, ruin, resampling, gates

_EQUITY: list[Layer] = [{"equity": "100 + sum(net) OVER (PARTITION BY symbol ORDER BY exit_hour, entry_hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}, {"ruined_at": "min(CASE WHEN equity <= 50 THEN exit_hour END) OVER (PARTITION BY symbol)"}]
derived("t13_realised_equity", candidates, _TRADES_SQL, _EQUITY, rounded(["symbol", "entry_hour", "exit_hour"], ["equity"]), None, _WITH_SIG)
derived("t14_ruin_floor", candidates, _TRADES_SQL, _EQUITY, rounded(["symbol", "entry_hour", "exit_hour"], ["equity"]), "ruined_at IS NULL OR exit_hour <= ruined_at", _WITH_SIG)


_SIMS = 200
_DRAWN = ["count(*) AS sims", "round(avg(CASE WHEN total > 0 THEN 1e0 ELSE 0e0 END), 6) AS p_profit", "round(avg(total), 4) AS mean_total"]
_PLACED = "row_number() OVER (PARTITION BY symbol ORDER BY entry_hour) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n"


def t19_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of trades drawn with replacement, by seeded digests, so a rerun draws the same; an equi-join on the drawn place."""
    t = candidates(spark, sf_dir).selectExpr("symbol", "net", *(x.strip() for x in _PLACED.replace("AS pos, ", "AS pos|").split("|")))
    drawn = t.selectExpr("symbol", "pos AS slot", "n", f"explode(sequence(0, {_SIMS - 1})) AS sim").selectExpr("symbol", "sim", "cast(conv(substring(md5(concat_ws(':', symbol, sim, slot)), 1, 8), 16, 10) AS bigint) % n AS pos")
    totals = drawn.join(t.select("symbol", "pos", "net"), ["symbol", "pos"]).groupBy("symbol", "sim").agg(F.sum("net").alias("total"))
    return totals.groupBy("symbol").agg(*(F.expr(x) for x in _DRAWN), F.expr("round(percentile(total, 0.05), 4) AS p5"), F.expr("round(percentile(total, 0.5), 4) AS middle"))


QUERIES["t19_bootstrap"] = t19_bootstrap
SQL["t19_bootstrap"] = f"""{_WITH_SIG}, t AS (SELECT symbol, net, {_PLACED} FROM ({_TRADES_SQL})),
    drawn AS (SELECT symbol, sim, ('0x' || substr(md5(concat_ws(':', symbol, sim, slot)), 1, 8))::BIGINT % n AS pos FROM (SELECT symbol, pos AS slot, n, unnest(range({_SIMS})) AS sim FROM t))
    SELECT symbol, {', '.join(_DRAWN)}, round(quantile_cont(total, 0.05), 4) AS p5, round(quantile_cont(total, 0.5), 4) AS middle FROM (SELECT symbol, sim, sum(net) AS total FROM drawn JOIN t USING (symbol, pos) GROUP BY ALL) GROUP BY symbol"""
_SEGMENT: list[Layer] = [{"sealed": "CASE WHEN entry_hour >= max(entry_hour) OVER (PARTITION BY symbol) - 168 THEN 1 ELSE 0 END"}]
_GATE_SUMS = [
    "sum(sealed) AS n_sealed", "avg(CASE WHEN sealed = 0 THEN net END) AS mean_in", "stddev_samp(CASE WHEN sealed = 0 THEN net END) AS sd_in", "avg(CASE WHEN sealed = 1 THEN net END) AS mean_sealed",
    "stddev_samp(CASE WHEN sealed = 1 THEN net END) AS sd_sealed", "sum(CASE WHEN sealed = 1 AND net > 0 THEN net END) AS won", "-sum(CASE WHEN sealed = 1 AND net < 0 THEN net END) AS lost", "max(net) AS best", "sum(net) AS total",
]
_GATES: list[Layer] = [
    {"sharpe_in": ratio("mean_in", "sd_in"), "sharpe_sealed": ratio("mean_sealed", "sd_sealed"), "profit_factor": ratio("won", "lost"), "concentration": ratio("best", "total")},
    {"degradation": "CASE WHEN sharpe_in <= 0 THEN 100e0 ELSE greatest(0e0, (sharpe_in - sharpe_sealed) / abs(sharpe_in) * 100) END", "t_stat": "sharpe_sealed * sqrt(n_sealed)"},
    {"g01": "coalesce(n_sealed >= 10 AND profit_factor > 1, false)", "g02": "coalesce(degradation <= 50, false)", "g10": "coalesce(t_stat >= 2, false)", "g11": "coalesce(total > 0 AND concentration <= 0.5, false)"},
    {"passed": "g01 AND g02 AND g10 AND g11", "score": "CASE WHEN g01 THEN 3 ELSE -6 END + CASE WHEN g02 THEN 2 ELSE -4 END + CASE WHEN g10 THEN 2 ELSE -4 END + CASE WHEN g11 THEN 1 ELSE -2 END"},
]
_GATE_OUT = ["symbol", "g01", "g02", "g10", "g11", "passed", "score", *(f"round({x}, 5) AS {x}" for x in ("sharpe_in", "sharpe_sealed", "profit_factor", "degradation", "t_stat", "concentration"))]
QUERIES["c10_gates"] = lambda s, d: add_layers(add_layers(candidates(s, d), _SEGMENT).groupBy("symbol").agg(*(F.expr(x) for x in _GATE_SUMS)), _GATES).selectExpr(*_GATE_OUT)
SQL["c10_gates"] = f"{_WITH_SIG} SELECT {', '.join(_GATE_OUT)} FROM ({layers_sql(f'SELECT symbol, {", ".join(_GATE_SUMS)} FROM ({layers_sql(_TRADES_SQL, _SEGMENT)}) GROUP BY symbol', _GATES)})"
_OVER_FOLDS = ["count(*) AS folds", "round(avg(sharpe), 5) AS mean_sharpe", "round(min(sharpe), 5) AS worst_sharpe", "round(stddev_pop(sharpe), 5) AS stability", "sum(CASE WHEN sharpe < 0 THEN 1 ELSE 0 END) AS negative_folds"]
QUERIES["a11_walk_forward_summary"] = lambda s, d: QUERIES["p06_walk_forward"](s, d).where("role = 'test'").groupBy("symbol").agg(*(F.expr(x) for x in _OVER_FOLDS))
SQL["a11_walk_forward_summary"] = f"SELECT symbol, {', '.join(_OVER_FOLDS)} FROM ({SQL['p06_walk_forward']}) WHERE role = 'test' GROUP BY symbol"

# ---------------------------------------------------------------- panel: rows here are days, whose number is that of the calendar

_HELD = "round(exp(sum(ln(1 + coalesce(r, 0))) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 5) AS basket"
QUERIES["a40_buy_and_hold"] = lambda s, d: add_layers(panel(s, d), _PANEL).groupBy("day").agg(F.avg("ret").alias("r")).selectExpr("day", _HELD)
SQL["a40_buy_and_hold"] = f"SELECT day, {_HELD} FROM (SELECT day, avg(ret) AS r FROM ({layers_sql(PANEL_SQL, _PANEL)}) GROUP BY day)"
_LAST20 = "OVER (ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_TARGET: list[Layer] = [{"vol": f"CASE WHEN count(r) {_LAST20} >= 20 THEN stddev_pop(r) {_LAST20} END"}, {"scale": "coalesce(least(1e0, 0.02 / nullif(vol, 0)), 1e0)"}, {"scaled": "scale * r"}]
QUERIES["x20_vol_target"] = lambda s, d: add_layers(daily_returns(s, d), _TARGET).selectExpr(*rounded(["day"], ["scale", "scaled"]))
SQL["x20_vol_target"] = f"SELECT {', '.join(rounded(['day'], ['scale', 'scaled']))} FROM ({layers_sql(_DAILY_SQL, _TARGET)})"
layered("x03_carry", QUERIES["s05_funding_daily"], SQL["s05_funding_daily"], [{"carry": f"-({full('avg', 'rate', 7, **P)})"}], ["asset", "day", "round(carry, 8) AS carry"])
layered("x09_rebalance_period", panel, PANEL_SQL, [_NO, {"period": "cast(floor((rn - 1) / 7e0) AS int)", "rebalances": "(rn - 1) % 7 = 0"}], ["asset", "day", "period", "rebalances"])

# ---------------------------------------------------------------- streaming

QUERIES["st2_stream_bars"] = stream_bars_query
SQL["st2_stream_bars"] = stream_bars_sql()
