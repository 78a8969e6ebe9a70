"""More signals, significance statistics, gates and panel sleeves, with their SQL; importing this adds them to the registry."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions.features import FEATURES, TRUE_RANGE
from barlab.functions.layers import Layer, add_layers, full, lag, layers_sql, over, ratio, rounded
from barlab.operators.trades import COMMISSION
from barlab.plans.registry import _DAILY_SQL, _DAY, _MOM, _PANEL, _TRADES_SQL, _WITH_SIG, QUERIES, SQL, P, candidates, daily_returns, layered
from barlab.sources.bars import PANEL_SQL, bars, bars_sql, panel

_ROW = "row_number() OVER (PARTITION BY symbol ORDER BY hour)"


def signal(name: str, layers: list[Layer], side: str, extra: list[str] | None = None) -> None:
    """Rows where `side` is 1 or -1."""
    layered(name, bars, bars_sql(), [*layers, {"side": side}], rounded(["symbol", "hour", "side"], extra or []), "side IS NOT NULL")


# ---------------------------------------------------------------- features

_CROSS: list[Layer] = [{"fast": full("avg", "close", 10), "slow": full("avg", "close", 50)}, {"up": "CASE WHEN slow IS NOT NULL THEN CASE WHEN fast > slow THEN 1 ELSE 0 END END"}, {"was_up": lag("up")}]
_HALVES: list[Layer] = [*FEATURES["w33_rsi2"][0], {f"{name}_{part}": f"{f}({x}) {over(10, skip=skip)}" for part, skip in (("new", 0), ("old", 10)) for name, f, x in (("low", "min", "low"), ("high", "max", "high"), ("rsi_low", "min", "rsi_2"), ("rsi_high", "max", "rsi_2"))} | {"rn": _ROW}]
GK: list[Layer] = [
    {"gk": f"0.5 * pow(ln({ratio('high', 'low')}), 2) - (2 * ln(2) - 1) * pow(ln({ratio('close', 'open')}), 2)"},
    {"gk_fast": f"sqrt(greatest({full('avg', 'gk', 5)}, 0))", "gk_slow": f"sqrt(greatest({full('avg', 'gk', 30)}, 0))"},
    {"gk_base": full("avg", "gk_fast", 50), "gk_sd": full("stddev_samp", "gk_fast", 50), "gk_ratio": ratio("gk_fast", "gk_slow")},
    {"gk_z": ratio("gk_fast - gk_base", "gk_sd")},
]
_CLIMB: list[Layer] = [*FEATURES["w14_volume"][0][:2], {"t": _ROW, "pm": full("avg", "close", 20), "vm20": full("avg", "abs(obv)", 20)}, {"price_slope": ratio(f"regr_slope(close, t) {over(20)}", "pm"), "obv_slope": ratio(f"regr_slope(obv, t) {over(20)}", "vm20")}, {"slope_gap": "obv_slope - price_slope"}]
layered("w35_ma_cross", bars, bars_sql(), _CROSS, ["symbol", "hour", "round(fast, 6) AS fast", "round(slow, 6) AS slow", "up"])
layered("w43_garman_klass_regime", bars, bars_sql(), GK, rounded(["symbol", "hour"], ["gk_fast", "gk_slow", "gk_ratio", "gk_z"]))
layered("w46_obv_slope_gap", bars, bars_sql(), _CLIMB, rounded(["symbol", "hour"], ["price_slope", "obv_slope", "slope_gap"]))
layered("w47_half_windows", bars, bars_sql(), _HALVES, rounded(["symbol", "hour"], ["low_new", "low_old", "high_new", "high_old", "rsi_low_new", "rsi_low_old"]), "rn > 20")


def _cci(deviation: str) -> list[Layer]:
    return [{"tp": "(high + low + close) / 3"}, {"tp_mean": full("avg", "tp", 20)}, {"mad": deviation}, {"cci": "CASE WHEN tp_mean IS NULL THEN NULL WHEN mad < 1e-12 THEN 0 ELSE (tp - tp_mean) / (0.015 * mad) END"}]


#: The mean absolute deviation from the current mean, in each dialect.
_CCI_SPARK = _cci(f"aggregate(collect_list(tp) {over(20)}, 0D, (a, x) -> a + abs(x - tp_mean)) / 20")
_CCI_SQL = _cci(f"list_sum(list_transform(list(tp) {over(20)}, lambda x: abs(x - tp_mean))) / 20")
QUERIES["w45_cci"] = lambda s, d: add_layers(bars(s, d), _CCI_SPARK).selectExpr("symbol", "hour", "round(cci, 4) AS cci")
SQL["w45_cci"] = f"SELECT symbol, hour, round(cci, 4) AS cci FROM ({layers_sql(bars_sql(), _CCI_SQL)})"

# ---------------------------------------------------------------- signals

_BANDS = FEATURES["w06_bollinger"][0]
_VOLUME = FEATURES["w14_volume"][0][:2]
_ATR = FEATURES["w51_expansion"][0]
_RSI = FEATURES["w33_rsi2"][0]
signal(
    "g01_volatility_breakout",
    [*_BANDS, *_VOLUME, *_ATR, {"bw_mean": full("avg", "bb_bandwidth", 50)}, {"tight": "CASE WHEN bb_bandwidth < 0.9 * bw_mean THEN 1 ELSE 0 END"}, {"tight_bars": f"sum(tight) {over(10, skip=1)}"}],
    "CASE WHEN tight_bars >= 3 AND volume_ratio > 1 AND atr_expansion > 1 AND close > bb_upper THEN 1 WHEN tight_bars >= 3 AND volume_ratio > 1 AND atr_expansion > 1 AND close < bb_lower THEN -1 END",
    ["bb_bandwidth"],
)
signal("g02_mean_reversion", [*_BANDS, *_RSI, *_VOLUME, *FEATURES["w48_spike"][0], {"z": ratio("close - bb_middle", "sd")}], "CASE WHEN spike_pct < -2 AND z < -1.5 AND bb_pct_b < 0.1 AND rsi_2 < 20 THEN 1 WHEN spike_pct > 2 AND z > 1.5 AND bb_pct_b > 0.9 AND rsi_2 > 80 THEN -1 END", ["z"])
signal("g05_dual_ma", [*_CROSS, *_VOLUME], "CASE WHEN up = 1 AND was_up = 0 AND volume_ratio > 0.8 THEN 1 WHEN up = 0 AND was_up = 1 AND volume_ratio > 0.8 THEN -1 END", ["fast", "slow"])
signal("g08_ichimoku_kumo", [*FEATURES["w38_ichimoku"][0], {"before": lag("close"), "top_before": lag("cloud_top"), "bottom_before": lag("cloud_bottom")}], "CASE WHEN close > cloud_top AND before <= top_before AND tenkan > kijun THEN 1 WHEN close < cloud_bottom AND before >= bottom_before AND tenkan < kijun THEN -1 END", ["cloud_top", "cloud_bottom"])
signal("g20_rsi_divergence", _HALVES, "CASE WHEN rn > 20 AND low_new < low_old AND rsi_low_new > rsi_low_old THEN 1 WHEN rn > 20 AND high_new > high_old AND rsi_high_new < rsi_high_old THEN -1 END")
_WILLIAMS = "CASE WHEN williams_r < -80 AND cci < -100 AND volume_ratio > 1 THEN 1 WHEN williams_r > -20 AND cci > 100 AND volume_ratio > 1 THEN -1 END AS side"


def _williams(cci: list[Layer]) -> list[Layer]:
    return [*FEATURES["w45_williams"][0], *_VOLUME, *cci]


QUERIES["g18_williams_cci"] = lambda s, d: add_layers(bars(s, d), _williams(_CCI_SPARK)).selectExpr("symbol", "hour", _WILLIAMS).where("side IS NOT NULL")
SQL["g18_williams_cci"] = f"SELECT * FROM (SELECT symbol, hour, {_WILLIAMS} FROM ({layers_sql(bars_sql(), _williams(_CCI_SQL))})) WHERE side IS NOT NULL"
layered("p18_thinned", bars, bars_sql(), [{"rn": _ROW, "n": "count(*) OVER (PARTITION BY symbol)"}], ["symbol", "hour", "round(close, 6) AS close"], "(rn - 1) % 24 = 0 OR rn = n")

# ---------------------------------------------------------------- trade stress and losing streaks

_SCENARIOS = "(VALUES (1), (2), (3)) s(cost_multiple)"
_STRESS = ["count(*) AS trades", "round(avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate", "round(sum(pnl), 4) AS total", "round(sum(CASE WHEN pnl > 0 THEN pnl END) / nullif(-sum(CASE WHEN pnl < 0 THEN pnl END), 0), 6) AS profit_factor"]
_PNL = f"gross - cost_multiple * {COMMISSION} * (entry_price + exit_price) AS pnl"


def t16_cost_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate trade under each of three cost multiples."""
    rows = candidates(spark, sf_dir).crossJoin(F.broadcast(spark.sql(f"SELECT * FROM {_SCENARIOS}"))).selectExpr("symbol", "cost_multiple", _PNL.replace(str(COMMISSION), f"{COMMISSION}D"))  # three rows
    return rows.groupBy("symbol", "cost_multiple").agg(*(F.expr(x) for x in _STRESS))


QUERIES["t16_cost_stress"] = t16_cost_stress
SQL["t16_cost_stress"] = f"{_WITH_SIG} SELECT symbol, cost_multiple, {', '.join(_STRESS)} FROM (SELECT symbol, cost_multiple, {_PNL} FROM ({_TRADES_SQL}), {_SCENARIOS}) GROUP BY symbol, cost_multiple"
_STREAKS: list[Layer] = [{"lost": "CASE WHEN net < 0 THEN 1 ELSE 0 END"}, {"run": "sum(1 - lost) OVER (PARTITION BY symbol ORDER BY entry_hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}]


def a08_losing_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_run = add_layers(candidates(spark, sf_dir), _STREAKS).groupBy("symbol", "run").agg(F.sum("lost").alias("n"))
    return per_run.groupBy("symbol").agg(F.max("n").alias("longest_loss_run"))


QUERIES["a08_losing_streak"] = a08_losing_streak
SQL["a08_losing_streak"] = f"{_WITH_SIG} SELECT symbol, max(n)::BIGINT AS longest_loss_run FROM (SELECT symbol, run, sum(lost) AS n FROM ({layers_sql(_TRADES_SQL, _STREAKS)}) GROUP BY symbol, run) GROUP BY symbol"

# ---------------------------------------------------------------- significance by year

_YEAR = "cast(floor(day / 365.25) AS int) + 1970"
_MOMENTS = ["count(*) AS n", "max(m) AS mean", "sqrt(sum(d * d) / nullif(count(*) - 1, 0)) AS sd", "avg(d * d) AS m2", "avg(d * d * d) AS m3", "avg(d * d * d * d) AS m4"]


def normal_cdf(z: str) -> str:
    """The normal distribution function by a rational approximation whose error is under 1e-7; its coefficients are fixed values."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = f"(exp(-0.5 * {z} * {z}) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"


#: Best Sharpe ratio to expect of 20 trials without skill, in standard errors: the expected maximum of normal draws by its extreme value form.
_TRIALS, _EULER = 20, 0.5772156649015329
_EXPECTED_BEST = (1 - _EULER) * NormalDist().inv_cdf(1 - 1 / _TRIALS) + _EULER * NormalDist().inv_cdf(1 - 1 / (_TRIALS * math.e))
_TESTS: list[Layer] = [
    {"sharpe": ratio("mean", "sd"), "skew": ratio("m3", "pow(m2, 1.5)"), "kurt": ratio("m4", "m2 * m2")},
    {"t_stat": "sharpe * sqrt(n)", "width": "sqrt(greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, 1e-9))"},
    {"z_psr": "sharpe * sqrt(n - 1) / width", "z_dsr": f"(sharpe - {_EXPECTED_BEST} / sqrt(n)) * sqrt(n - 1) / width"},
    {"psr": normal_cdf("z_psr"), "dsr": normal_cdf("z_dsr"), "p_value": f"1 - {normal_cdf('t_stat')}"},
    {"certified": "coalesce(dsr >= 0.95 AND sharpe > 0 AND n >= 30 AND t_stat >= 2, false)"},
]
_TEST_OUT = ["year", "n", *(f"round({x}, 5) AS {x}" for x in ("sharpe", "skew", "kurt", "t_stat", "p_value", "psr", "dsr")), "certified"]


def a23_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per year of the daily backtest: Sharpe ratio per day, its t statistic, probabilistic and deflated forms, and the certification rule."""
    r = daily_returns(spark, sf_dir).selectExpr(f"{_YEAR} AS year", "r").selectExpr("year", "r - avg(r) OVER (PARTITION BY year) AS d", "avg(r) OVER (PARTITION BY year) AS m")
    return add_layers(r.groupBy("year").agg(*(F.expr(x) for x in _MOMENTS)), _TESTS).selectExpr(*_TEST_OUT)


QUERIES["a23_significance"] = a23_significance
_CENTRED = f"SELECT year, r - avg(r) OVER (PARTITION BY year) AS d, avg(r) OVER (PARTITION BY year) AS m FROM (SELECT {_YEAR} AS year, r FROM ({_DAILY_SQL}))"
SQL["a23_significance"] = f"SELECT {', '.join(_TEST_OUT)} FROM ({layers_sql(f'SELECT year, {", ".join(_MOMENTS)} FROM ({_CENTRED}) GROUP BY year', _TESTS)})"

# ---------------------------------------------------------------- panel sleeves

_FALL: list[Layer] = [*_PANEL, {"flag": "CASE WHEN ret < -0.3 THEN 1 ELSE 0 END"}, {"held": f"max(flag) {over(5, **P)}"}]
layered("x13_sticky_hold", panel, PANEL_SQL, _FALL, ["asset", "day", "flag", "held"])
_GATE: list[Layer] = [{"ma": full("avg", "close", 50, **P)}, {"above": "CASE WHEN ma IS NULL THEN NULL WHEN close > ma THEN 1e0 ELSE 0e0 END"}, {"breadth": f"avg(above) OVER ({_DAY})", "lead": f"max(CASE WHEN asset = 0 THEN above END) OVER ({_DAY})"}, {"invested": "CASE WHEN breadth >= 0.5 AND lead = 1 THEN 1 ELSE 0 END"}]
layered("x15_cash_gate", panel, PANEL_SQL, _GATE, ["asset", "day", "round(breadth, 6) AS breadth", "invested"])
_BLEND: list[Layer] = [*_MOM, {"za": ratio(f"score - avg(score) OVER ({_DAY})", f"stddev_pop(score) OVER ({_DAY})"), "zb": ratio(f"avg(vol) OVER ({_DAY}) - vol", f"stddev_pop(vol) OVER ({_DAY})")}, {"blend": "0.7 * za + 0.3 * zb"}]
layered("x06_blend", panel, PANEL_SQL, _BLEND, ["asset", "day", "round(blend, 6) AS blend"])
_SLEEVES: list[Layer] = [*_PANEL, {"ma": full("avg", "close", 50, **P), "hi": f"max(close) {over(20, skip=1, **P)}", "prior": lag("close", 5, **P)}, {"trend": "CASE WHEN close > ma THEN 1e0 ELSE 0e0 END", "breakout": "CASE WHEN close > hi THEN 1e0 ELSE 0e0 END", "dip": "CASE WHEN close > ma AND close < prior THEN 1e0 ELSE 0e0 END"}, {f"{s}_before": f"coalesce({lag(s, **P)}, 0e0)" for s in ("trend", "breakout", "dip")}]
_SLEEVE_DAYS = [f"round(coalesce(sum({s}_before * ret) / nullif(sum({s}_before), 0), 0), 6) AS {s}" for s in ("trend", "breakout", "dip")] + ["round((" + " + ".join(f"coalesce(sum({s}_before * ret) / nullif(sum({s}_before), 0), 0)" for s in ("trend", "breakout", "dip")) + ") / 3, 6) AS ensemble"]
QUERIES["x19_sleeve_ensemble"] = lambda s, d: add_layers(panel(s, d), _SLEEVES).groupBy("day").agg(*(F.expr(x) for x in _SLEEVE_DAYS))
SQL["x19_sleeve_ensemble"] = f"SELECT day, {', '.join(_SLEEVE_DAYS)} FROM ({layers_sql(PANEL_SQL, _SLEEVES)}) GROUP BY day"
