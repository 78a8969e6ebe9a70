"""Strategies with all their conditions, as predicates on the feature frame, and the indicators that only they use.

Each query returns (symbol, hour, side) and what its rule reads. Thresholds are parameters of the named queries: the
given prices are far noisier than market bars, so some are looser than those of a market; no condition is left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions.layers import Layer, add_layers, full, lag, layers_sql, over, ratio, rounded
from barlab.functions.series import scan
from barlab.plans.frame import FRAME_SQL, frame, framed, of_frame
from barlab.plans.registry import QUERIES, SQL

#: Where regime filters apply; 'unknown' bars never signal.
ALLOWED = "regime IN ('breakout', 'trend', 'lateral', 'mean_reversion')"
OK = f"atr_14 > 0 AND {ALLOWED}"


def either(long: str, short: str) -> str:
    return f"CASE WHEN {long} THEN 1 WHEN {short} THEN -1 END"


#: name -> (side, columns to show)
SIDES: dict[str, tuple[str, list[str]]] = {
    "g02_mean_reversion": (
        either("100 * ret_5 <= -1.5 AND ret_zscore_20 <= -0.5 AND bb_pct_b <= 0.3 AND volume_ratio <= 1.1 * volume_ratio_before AND coalesce(rsi_14, 50) <= 55 AND coalesce(adx_14, 0) <= 25",
               "100 * ret_5 >= 1.5 AND ret_zscore_20 >= 0.5 AND bb_pct_b >= 0.7 AND volume_ratio <= 1.1 * volume_ratio_before AND coalesce(rsi_14, 50) >= 45 AND coalesce(adx_14, 0) <= 25"),
        ["ret_5", "ret_zscore_20", "bb_pct_b"],
    ),
    "g03_trend_following": (
        either("close > ema_50 AND bmsb_bullish = 1 AND adx_14 >= 15 AND (abs(close - hi_50 + 0.382 * (hi_50 - lo_50)) <= 0.1 * close OR abs(close - hi_50 + 0.5 * (hi_50 - lo_50)) <= 0.1 * close OR abs(close - hi_50 + 0.618 * (hi_50 - lo_50)) <= 0.1 * close) AND coalesce(volume_ratio, 1) >= 0.8 AND coalesce(rsi_14, 50) >= 34",
               "close < ema_50 AND bmsb_bullish = 0 AND adx_14 >= 15 AND (abs(close - lo_50 - 0.382 * (hi_50 - lo_50)) <= 0.1 * close OR abs(close - lo_50 - 0.5 * (hi_50 - lo_50)) <= 0.1 * close OR abs(close - lo_50 - 0.618 * (hi_50 - lo_50)) <= 0.1 * close) AND coalesce(volume_ratio, 1) >= 0.8 AND coalesce(rsi_14, 50) <= 70"),
        ["adx_14", "rsi_14"],
    ),
    "g04_donchian_filtered": (either("close > don_hi AND adx_14 >= 15 AND volume_ratio >= 0.8 AND don_hi - don_lo >= 0.7 * atr_14", "close < don_lo AND adx_14 >= 15 AND volume_ratio >= 0.8 AND don_hi - don_lo >= 0.7 * atr_14"), ["don_hi", "don_lo", "adx_14"]),
    "g05_dual_ma": (
        either("ema_12_before <= ema_26_before AND ema_12 > ema_26 AND adx_14 >= 15 AND volume_ratio >= 0.8", "ema_12_before >= ema_26_before AND ema_12 < ema_26 AND adx_14 >= 15 AND volume_ratio >= 0.8"), ["ema_12", "ema_26"],
    ),
    "g06_keltner_breakout": (either("close > ema_20 + 0.8 * atr_14 AND adx_14 >= 14.7614 AND rsi_14 >= 50.9851 AND volume_ratio >= 0.9", "close < ema_20 - 0.8 * atr_14 AND adx_14 >= 14.7614 AND rsi_14 <= 45.4013 AND volume_ratio >= 0.9"), ["ema_20 AS stop", "rsi_14"]),
    "g07_volatility_squeeze": (
        either("narrow_bars >= 3 AND NOT (bb_lower > ema_20 - 1.1686 * atr_14 AND bb_upper < ema_20 + 1.1686 * atr_14) AND volume_ratio >= 0.9 AND slope_14 > 0",
               "narrow_bars >= 3 AND NOT (bb_lower > ema_20 - 1.1686 * atr_14 AND bb_upper < ema_20 + 1.1686 * atr_14) AND volume_ratio >= 0.9 AND slope_14 < 0"),
        ["slope_14", "bb_bw_percentile"],
    ),
    "g15_momentum": (
        either("rsi_14 > 52 AND rsi_14 < 90 AND roc_12 > 0.5516 AND adx_14 >= 15 AND volume_ratio >= 0.9", "rsi_14 < 48 AND rsi_14 > 10 AND roc_12 < -0.5516 AND adx_14 >= 15 AND volume_ratio >= 0.9"), ["rsi_14", "roc_12", "adx_14"],
    ),
    "g17_connors_rsi2": (either("close > ema_200 AND rsi_2 < 10 AND adx_14 >= 15 AND _i >= 199", "close < ema_200 AND rsi_2 > 90 AND adx_14 >= 15 AND _i >= 199"), ["rsi_2", "ema_200"]),
    "g18_williams_cci": (
        either("williams_r <= -60 AND cci <= -50 AND coalesce(adx_14, 0) <= 35 AND volume_ratio >= 0.9 AND bb_bw_percentile <= 60", "williams_r >= -40 AND cci >= 50 AND coalesce(adx_14, 0) <= 35 AND volume_ratio >= 0.9 AND bb_bw_percentile <= 60"), ["williams_r", "cci"],
    ),
    "g19_vwap_reversion": (
        either("100 * (close - vwap_20) / nullif(vwap_20, 0) < -1.5 AND rsi_14 < 52 AND coalesce(adx_14, 0) <= 30 AND volume_ratio >= 0.9 AND buying_pressure >= 0.1",
               "100 * (close - vwap_20) / nullif(vwap_20, 0) > 1.5 AND rsi_14 > 48 AND coalesce(adx_14, 0) <= 30 AND volume_ratio >= 0.9 AND selling_pressure >= 0.1"),
        ["vwap_20 AS target", "rsi_14"],
    ),
    "g20_rsi_divergence": (
        either("rsi_seen = 14 AND 100 * (low_new / nullif(low_old, 0) - 1) < -0.5 AND rsi_low_new - rsi_low_old > 0.5 AND rsi_14 < 50 AND coalesce(adx_14, 0) <= 35",
               "rsi_seen = 14 AND 100 * (high_new / nullif(high_old, 0) - 1) > 0.5 AND rsi_high_old - rsi_high_new > 0.5 AND rsi_14 > 50 AND coalesce(adx_14, 0) <= 35"),
        ["rsi_low_new", "rsi_low_old", "rsi_14"],
    ),
}


def side_of(name: str) -> str:
    return f"CASE WHEN {OK} THEN {SIDES[name][0]} END"


@dataclass(frozen=True)
class Strategy:
    """A rule for a bar's side with the frame's columns that it reads, which are checked before it runs."""

    name: str
    side: str
    needs: tuple[str, ...]

    def on(self, frame_: DataFrame) -> Column:
        missing = [c for c in self.needs if c not in frame_.columns]
        if missing:
            raise ValueError(f"{self.name} needs {', '.join(missing)}")
        return F.expr(self.side)


#: Words of the rules that are no columns.
_WORDS = {"CASE", "WHEN", "THEN", "ELSE", "END", "AND", "OR", "NOT", "IS", "NULL", "IN", "abs", "coalesce", "nullif", "greatest", "least", "sign", "cast", "AS", "int", "double", "BETWEEN"}
STRATEGIES = {n: Strategy(n, side_of(n), tuple(sorted(set(re.findall(r"\b[A-Za-z_]\w*\b", re.sub(r"'[^']*'|\b\d[\w.]*", " ", side_of(n)))) - _WORDS))) for n in SIDES}


def all_signals(frame_: DataFrame) -> DataFrame:
    """(symbol, hour, strategy, side): the signals of every registered strategy, from one pass over the frame."""
    every = F.array(*(F.struct(F.lit(s.name).alias("strategy"), s.on(frame_).alias("side")) for s in STRATEGIES.values()))
    return frame_.select("symbol", "hour", F.inline(every)).where("side IS NOT NULL")


QUERIES["ud1_registered_strategies"] = lambda s, d: all_signals(frame(s, d)).groupBy("symbol", "strategy").agg(F.count("*").alias("signals"), F.sum(F.expr("CASE WHEN side = 1 THEN 1 ELSE 0 END")).alias("longs"))
SQL["ud1_registered_strategies"] = f"{FRAME_SQL} " + " UNION ALL ".join(f"SELECT symbol, '{n}' AS strategy, count(*) AS signals, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END)::BIGINT AS longs FROM (SELECT symbol, {s.side} AS side FROM f) WHERE side IS NOT NULL GROUP BY symbol" for n, s in STRATEGIES.items())
for _name, (_, _show) in SIDES.items():
    _side = side_of(_name)
    of_frame(_name, ["symbol", "hour", f"{_side} AS side", *(f"round({x.split(' AS ')[0]}, 6) AS {x.split(' AS ')[-1]}" for x in _show)], f"{_side} IS NOT NULL")

# ---------------------------------------------------------------- gates on any signal

_MOMENTUM = side_of("g15_momentum")
of_frame("p13_long_only", ["symbol", "hour", f"{_MOMENTUM} AS side"], f"{_MOMENTUM} = 1")
of_frame("p14_macro_risk_off", ["symbol", "hour", f"{_MOMENTUM} AS side", "macro_bullish"], f"{_MOMENTUM} IS NOT NULL AND NOT ({_MOMENTUM} = 1 AND macro_bullish = 0)")
of_frame("p15_regime_allow_list", ["symbol", "hour", f"{_MOMENTUM} AS side", "regime"], f"{_MOMENTUM} IS NOT NULL AND regime IN ('trend', 'breakout')")
of_frame("ud3_wrapped_signals", ["symbol", "hour", f"{_MOMENTUM} AS side", "regime", "macro_bullish"], f"{_MOMENTUM} = 1 AND macro_bullish = 1 AND regime IN ('trend', 'breakout', 'lateral')")
of_frame("w49_fibonacci_zone", ["symbol", "hour", *(f"abs(close - hi_50 + {x} * (hi_50 - lo_50)) <= 0.05 * close AS near_{str(x)[2:]}" for x in (0.382, 0.5, 0.618))], "hi_50 - lo_50 > 0")
#: Weights of the strategies that vote, the bonus of trend and volume, and the least score.
VOTES = {"g04_donchian_filtered": 1.0, "g05_dual_ma": 0.8, "g06_keltner_breakout": 1.0, "g15_momentum": 1.2, "g17_connors_rsi2": 0.7, "g20_rsi_divergence": 0.6}
_BONUS = "CASE WHEN adx_14 > 30 THEN 0.3e0 WHEN adx_14 > 20 THEN 0.15e0 ELSE 0e0 END + CASE WHEN volume_ratio > 2 THEN 0.3e0 WHEN volume_ratio > 1.5 THEN 0.15e0 ELSE 0e0 END"
_SCORE = {side: " + ".join(f"CASE WHEN {side_of(n)} = {side} THEN {w}e0 ELSE 0e0 END" for n, w in VOTES.items()) + f" + {_BONUS}" for side in (1, -1)}
_VOTE = f"CASE WHEN {_SCORE[1]} >= 1 AND {_SCORE[1]} > {_SCORE[-1]} AND close > ema_50 THEN 1 WHEN {_SCORE[-1]} >= 1 AND {_SCORE[-1]} > {_SCORE[1]} AND close < ema_50 THEN -1 END"
of_frame("w53_weighted_vote", ["symbol", "hour", f"{_VOTE} AS side", f"round({_SCORE[1]}, 6) AS long_score", f"round({_SCORE[-1]}, 6) AS short_score"], f"{_VOTE} IS NOT NULL")

# ---------------------------------------------------------------- recurrences with a coefficient of their own


def scan_sql(a: str, b: str) -> str:
    """DuckDB's form of y = a * y_prev + b with y_prev = 0 before the first row."""
    w = "OVER (PARTITION BY symbol ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"(list_reduce(list({{'y': ({b})::DOUBLE, 'a': ({a})::DOUBLE}}) {w}, lambda s, v: {{'y': v.a * s.y + v.y, 'a': v.a}})).y"


def with_layers(name: str, steps, out: list[str], where: str | None = None) -> None:
    """A query of layers over the frame; a step is layers of bounded frames or one (output, a, b) recurrence."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = frame(spark, sf_dir)
        for step in steps:
            df = scan(df, step[1], step[2], step[0]) if isinstance(step, tuple) else framed(df, step)
        return (df.where(where) if where else df).selectExpr(*out)

    sql = "SELECT * FROM f"
    for step in steps:
        sql = f"SELECT *, {scan_sql(step[1], step[2])} AS {step[0]} FROM ({sql})" if isinstance(step, tuple) else layers_sql(sql, step)
    QUERIES[name] = query
    SQL[name] = f"{FRAME_SQL} SELECT {', '.join(out)} FROM ({sql})" + (f" WHERE {where}" if where else "")


_FAST, _SLOW = 2 / 5, 2 / 27
_KAMA = [
    [{"way": f"abs(close - {lag('close', 14)})", "path": f"CASE WHEN count(d) {over(14)} >= 14 THEN sum(abs(d)) {over(14)} END"}, {"er": "CASE WHEN path IS NULL THEN NULL WHEN path = 0 THEN 0 ELSE way / path END"}, {"sc": f"pow(er * {_FAST - _SLOW!r}e0 + {_SLOW!r}e0, 2)"}],
    ("kama_raw", "CASE WHEN _i <= 14 THEN 1 ELSE 1 - sc END", "CASE WHEN _i < 14 THEN 0 WHEN _i = 14 THEN close ELSE sc * close END"),
    [{"kama": "CASE WHEN _i >= 14 THEN kama_raw END"}, {"kama_1": lag("kama"), "kama_2": lag("kama", 2), "kama_slope": f"100 * ({ratio('kama', lag('kama', 7))} - 1)"}],
]
with_layers("w39_kama", _KAMA, rounded(["symbol", "hour"], ["er", "kama", "kama_slope"]))
_KAMA_SIDE = f"CASE WHEN {OK} AND _i >= 60 AND adx_14 >= 10 THEN CASE WHEN close > kama AND kama_slope > 0.1325 AND ((kama_1 <= kama_2 AND kama > kama_1) OR (kama_slope > 0.265 AND close_before <= kama_1)) THEN 1 WHEN close < kama AND kama_slope < -0.1325 AND ((kama_1 > kama_2 AND kama <= kama_1) OR (kama_slope < -0.265 AND close_before >= kama_1)) THEN -1 END END"
with_layers("g09_kama_trend", _KAMA, [*rounded(["symbol", "hour", f"{_KAMA_SIDE} AS side"], ["kama", "kama_slope"])], f"{_KAMA_SIDE} IS NOT NULL")
_FISHER = [
    [{"hh": full("max", "high", 18), "ll": full("min", "low", 18)}, {"raw": "CASE WHEN hh IS NULL OR hh = ll THEN 0e0 ELSE greatest(-0.999, least(0.999, 2 * (((high + low) / 2 - ll) / (hh - ll) - 0.5))) END"}],
    ("fisher_value", "0.5", "0.5 * raw"),
    ("fisher", "0.5", "CASE WHEN _i < 17 THEN 0 ELSE 0.5 * ln((1 + greatest(-0.999, least(0.999, fisher_value))) / (1 - greatest(-0.999, least(0.999, fisher_value)))) END"),
    [{"fisher_signal": f"coalesce({lag('fisher')}, 0)"}],
]
with_layers("w36_fisher", _FISHER, rounded(["symbol", "hour"], ["fisher", "fisher_signal"]), "_i >= 17")
_FISHER_SIDE = f"CASE WHEN {OK} AND _i >= 60 AND coalesce(adx_14, 0) <= 35.3155 THEN CASE WHEN fisher_signal > 0.5 AND fisher < fisher_signal THEN -1 WHEN fisher_signal < -0.5 AND fisher > fisher_signal THEN 1 END END"
with_layers("g10_fisher_transform", _FISHER, rounded(["symbol", "hour", f"{_FISHER_SIDE} AS side"], ["fisher", "fisher_signal"]), f"{_FISHER_SIDE} IS NOT NULL")

# ---------------------------------------------------------------- ratcheting bands: a fold over the last 200 bars

_LOOK, _PERIOD, _MULT = 200, 14, 1.5
_TRUE = "greatest(x.h - x.l, abs(x.h - s.c), abs(x.l - s.c))"
_ATR = f"CASE WHEN s.n + 1 < {_PERIOD} THEN 0e0 WHEN s.n + 1 = {_PERIOD} THEN (s.st + {_TRUE}) / {_PERIOD} ELSE (s.atr * {_PERIOD - 1} + {_TRUE}) / {_PERIOD} END"
_UP0, _LO0 = f"((x.h + x.l) / 2 + {_MULT} * ({_ATR}))", f"((x.h + x.l) / 2 - {_MULT} * ({_ATR}))"
_UP = f"CASE WHEN s.n + 1 > {_PERIOD} AND {_UP0} > s.up AND s.c < s.up THEN s.up ELSE {_UP0} END"
_LO = f"CASE WHEN s.n + 1 > {_PERIOD} AND {_LO0} < s.lo AND s.c > s.lo THEN s.lo ELSE {_LO0} END"
_DIR = f"CASE WHEN s.n + 1 < {_PERIOD} THEN 0 WHEN s.n + 1 > {_PERIOD} AND s.dir = 1 THEN CASE WHEN x.c < ({_LO}) THEN -1 ELSE 1 END WHEN x.c > ({_UP}) THEN 1 ELSE -1 END"
_STATE = {"n": "s.n + 1", "st": f"s.st + {_TRUE}", "atr": _ATR, "up": _UP, "lo": _LO, "dir": _DIR, "pd": "s.dir", "c": "x.c", "h": "x.h", "l": "x.l"}
_TYPES = {"n": "bigint", "dir": "int", "pd": "int"}
_ROW = {"n": "0", "st": "0", "atr": "0", "up": "0", "lo": "0", "dir": "0", "pd": "0", "c": "close", "h": "high", "l": "low"}


def _struct(fields: dict[str, str], spark: bool) -> str:
    if spark:
        return "named_struct(" + ", ".join(f"'{k}', cast({v} AS {_TYPES.get(k, 'double')})" for k, v in fields.items()) + ")"
    return "{" + ", ".join(f"'{k}': CAST({v} AS {_TYPES.get(k, 'double')})" for k, v in fields.items()) + "}"


_BARS = f"OVER (PARTITION BY symbol ORDER BY hour ROWS BETWEEN {_LOOK - 1} PRECEDING AND CURRENT ROW)"


def _supertrend(spark: bool) -> list[Layer]:
    rows = f"{'collect_list' if spark else 'list'}({_struct(_ROW, spark)}) {_BARS}"
    fold = f"aggregate(slice(_l, 2, {_LOOK}), _l[0], (s, x) -> {_struct(_STATE, True)})" if spark else f"list_reduce(_l, lambda s, x: {_struct(_STATE, False)})"
    return [{"_l": rows}, {"_st": fold}, {"st_dir": f"CASE WHEN _st.n > {_PERIOD} THEN _st.dir END", "st_before": f"CASE WHEN _st.n > {_PERIOD} THEN _st.pd END", "supertrend": f"CASE WHEN _st.n > {_PERIOD} THEN CASE WHEN _st.dir = 1 THEN _st.lo ELSE _st.up END END"}]


_FLIP = f"CASE WHEN {OK} AND _i >= 60 AND adx_14 >= 10 AND volume_ratio >= 0.7 AND st_dir <> st_before THEN st_dir END"


def two_ways(name: str, layers, out: list[str], where: str | None) -> None:
    """A query whose layers differ in the two dialects: layers(True) for Spark, layers(False) for DuckDB."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = framed(frame(spark, sf_dir), layers(True))
        return (df.where(where) if where else df).selectExpr(*out)

    QUERIES[name] = query
    SQL[name] = f"{FRAME_SQL} SELECT {', '.join(out)} FROM ({layers_sql('SELECT * FROM f', layers(False))})" + (f" WHERE {where}" if where else "")


two_ways("w41_supertrend", _supertrend, ["symbol", "hour", "st_dir", "round(supertrend, 6) AS supertrend"], "st_dir IS NOT NULL")
two_ways("g14_supertrend", _supertrend, ["symbol", "hour", f"{_FLIP} AS side", "round(supertrend, 6) AS supertrend"], f"{_FLIP} IS NOT NULL")

# ---------------------------------------------------------------- rescaled range

_RETURNS = "OVER (PARTITION BY symbol ORDER BY hour ROWS BETWEEN 98 PRECEDING AND CURRENT ROW)"


def _rescaled(spark: bool) -> list[Layer]:
    """The mean rescaled range of the whole chunks of 16, 32 and 64 of the last 99 returns, and of all 99."""

    chunks = {f"{k}_{i}": (f"slice(_r, {1 + i * k}, {k})" if spark else f"_r[{1 + i * k}:{(i + 1) * k}]", k) for k in (16, 32, 64) for i in range(99 // k)} | {"all": ("_r", 99)}

    def one(chunk: str, k: int) -> str:
        if spark:  # the mean and the chunk are bound once, not worked out again for every element
            step = "named_struct('c', a.c + x - m, 'hi', greatest(a.hi, a.c + x - m), 'lo', least(a.lo, a.c + x - m), 'q', a.q + (x - m) * (x - m))"
            end = f"CASE WHEN sqrt(a.q / {k - 1}) >= 1e-12 THEN (a.hi - a.lo) / sqrt(a.q / {k - 1}) END"
            return f"element_at(transform(array(aggregate({chunk}, 0D, (a, x) -> a + x) / {k}), m -> aggregate({chunk}, named_struct('c', 0D, 'hi', -1e300D, 'lo', 1e300D, 'q', 0D), (a, x) -> {step}, a -> {end})), 1)"
        sums = f"list_transform(range(1, {k + 1}), lambda j: list_sum(({chunk})[1:j]) - j * list_avg({chunk}))"
        return f"CASE WHEN list_aggregate({chunk}, 'stddev_samp') >= 1e-12 THEN (list_max({sums}) - list_min({sums})) / list_aggregate({chunk}, 'stddev_samp') END"

    scales = {f"rs_{n}": one(c, k) for n, (c, k) in chunks.items()}
    returns = {"_r": f"CASE WHEN count(lr) {_RETURNS} >= 99 THEN {'collect_list' if spark else 'list'}(lr) {_RETURNS} END"}
    if spark:
        mean = "aggregate(filter(array({}), x -> x IS NOT NULL), named_struct('s', 0D, 'n', 0D), (a, x) -> named_struct('s', a.s + x, 'n', a.n + 1D), a -> CASE WHEN a.n > 0 THEN ln(a.s / a.n) END)"
        points = ", ".join(f"named_struct('x', ln({k}), 'y', {mean.format(', '.join(scales[f'rs_{k}_{i}'] for i in range(99 // k)))})" for k in (16, 32, 64))
        slope = f"aggregate(filter(array({points}), p -> p.y IS NOT NULL), named_struct('n', 0D, 'sx', 0D, 'sy', 0D, 'sxx', 0D, 'sxy', 0D), (a, p) -> named_struct('n', a.n + 1D, 'sx', a.sx + p.x, 'sy', a.sy + p.y, 'sxx', a.sxx + p.x * p.x, 'sxy', a.sxy + p.x * p.y), a -> CASE WHEN a.n >= 2 THEN greatest(0D, least(1D, (a.n * a.sxy - a.sx * a.sy) / (a.n * a.sxx - a.sx * a.sx))) END)"
        whole = f"element_at(transform(array({scales['rs_all']}), w -> CASE WHEN w IS NULL OR w <= 0 THEN 0.5D ELSE greatest(0D, least(1D, ln(w) / ln(99))) END), 1)"
        return [returns, {"hurst": f"CASE WHEN _r IS NOT NULL THEN coalesce({slope}, {whole}) END"}, {"fractal": "2 - hurst"}]
    mean = {f"y_{k}": f"ln(({' + '.join(f'coalesce(rs_{k}_{i}, 0)' for i in range(99 // k))}) / nullif({' + '.join(f'CASE WHEN rs_{k}_{i} IS NULL THEN 0 ELSE 1 END' for i in range(99 // k))}, 0))" for k in (16, 32, 64)}
    x = {k: f"ln({k})" for k in (16, 32, 64)}
    have = {k: f"CASE WHEN y_{k} IS NULL THEN 0 ELSE 1 END" for k in x}
    n, sx, sy = (" + ".join(parts) for parts in (have.values(), (f"{have[k]} * {x[k]}" for k in x), (f"coalesce(y_{k}, 0)" for k in x)))
    sxx, sxy = " + ".join(f"{have[k]} * {x[k]} * {x[k]}" for k in x), " + ".join(f"coalesce(y_{k}, 0) * {x[k]}" for k in x)
    slope = f"(({n}) * ({sxy}) - ({sx}) * ({sy})) / nullif(({n}) * ({sxx}) - ({sx}) * ({sx}), 0)"
    whole = "ln(rs_all) / ln(99)"
    return [
        returns, scales, mean,
        {"hurst": f"CASE WHEN _r IS NULL THEN NULL WHEN {n} >= 2 THEN greatest(0e0, least(1e0, {slope})) WHEN rs_all IS NULL OR rs_all <= 0 THEN 0.5e0 ELSE greatest(0e0, least(1e0, {whole})) END"}, {"fractal": "2 - hurst"},
    ]


two_ways("w30_hurst", _rescaled, ["symbol", "hour", "round(hurst, 6) AS hurst", "round(fractal, 6) AS fractal"], "hurst IS NOT NULL")
_CHAOS = f"CASE WHEN {OK} AND _i >= 110 AND adx_14 >= 10 AND hurst BETWEEN 0.3 AND 0.95 AND fractal <= 1.7 AND coalesce(volume_ratio, 1.2) >= 0.8 THEN CASE WHEN ema_12 > ema_26 AND slope_14 > 0 THEN 1 WHEN ema_12 < ema_26 AND slope_14 < 0 THEN -1 END END"
two_ways("g11_chaos_trend", _rescaled, ["symbol", "hour", f"{_CHAOS} AS side", "round(hurst, 6) AS hurst"], f"{_CHAOS} IS NOT NULL")

# ---------------------------------------------------------------- predictions as an input table

#: A stand-in for a table of predictions per bar: probabilities of a fall and of a rise from the bar's own features.
_PREDICTED = "1 / (1 + exp(-coalesce(ret_zscore_20, 0) - coalesce(roc_12, 0) / 200))"
PREDICTIONS = ["symbol", "hour", f"{_PREDICTED} AS p_up", f"1 - {_PREDICTED} AS p_down"]
_CONFIDENT = "CASE WHEN p_up >= p_down THEN p_up ELSE p_down END >= 0.6"
_VETO = f"NOT ({_CONFIDENT} AND ((side = 1 AND p_down > p_up) OR (side = -1 AND p_up > p_down)))"
_STRENGTH = f"CASE WHEN {_CONFIDENT} AND ((side = 1 AND p_up > p_down) OR (side = -1 AND p_down > p_up)) THEN least(1e0, 1.3 * strength) ELSE strength END"
_J06 = ["symbol", "hour", "side", f"round({_STRENGTH}, 6) AS strength"]


def j06_prediction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals joined with the predictions of their bar: those opposed with confidence go, those agreed with gain strength."""
    f = frame(spark, sf_dir)
    signals = f.selectExpr("symbol", "hour", f"{_MOMENTUM} AS side", "least(1e0, abs(rsi_14 - 50) / 30) AS strength").where("side IS NOT NULL")
    return signals.join(f.selectExpr(*PREDICTIONS), ["symbol", "hour"], "left").where(f"p_up IS NULL OR {_VETO}").selectExpr(*_J06)


QUERIES["j06_prediction_filter"] = j06_prediction_filter
SQL["j06_prediction_filter"] = f"""{FRAME_SQL}, p AS (SELECT {', '.join(PREDICTIONS)} FROM f), s AS (SELECT symbol, hour, {_MOMENTUM} AS side, least(1e0, abs(rsi_14 - 50) / 30) AS strength FROM f)
    SELECT {', '.join(_J06)} FROM (SELECT * FROM s WHERE side IS NOT NULL) LEFT JOIN p USING (symbol, hour) WHERE p_up IS NULL OR {_VETO}"""
