"""The feature frame: bars with every rolling and recursive feature and the regime, from which signals are predicates.

In Spark, bounded frames are partitioned by parts of a series with a halo and recurrences run over chunks
(functions/series.py), so a long symbol is many tasks. The SQL says the same by symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlab.functions.features import TRUE_RANGE, YEAR
from barlab.functions.layers import Layer, add_layers, full, lag, layers_sql, over, ratio, rounded, upto
from barlab.functions.recursive import ewm_sql
from barlab.functions.series import ewm_gaps, ewm_gaps_sql, ewms, indexed, with_halo, without_halo
from barlab.plans.registry import QUERIES, SQL
from barlab.plans.relations import Tables, query, relation
from barlab.sources.bars import bars, bars_sql
from barlab.sources.shared import written

#: Rows that any frame of a frame below looks back, rounded up.
HALO = 256

_FIRST: list[Layer] = [
    TRUE_RANGE,
    {
        "d": f"close - {lag('close')}", "lr": f"ln({ratio('close', lag('close'))})", "hl": f"ln({ratio('high', 'low')})", "gk": f"0.5 * pow(ln({ratio('high', 'low')}), 2) - (2 * ln(2) - 1) * pow(ln({ratio('close', 'open')}), 2)",
        "rise": f"coalesce(high - {lag('high')}, 0)", "fall": f"coalesce({lag('low')} - low, 0)", "signed": f"sign(close - coalesce({lag('close')}, close)) * volume",
        "close_location": ratio("close - low", "high - low"), "selling_pressure": ratio("high - close", "high - low"), "body_wick_ratio": ratio("abs(close - open)", "high - low"), "tp": "(high + low + close) / 3",
        **{f"ret_{n}": f"{ratio('close', lag('close', n))} - 1" for n in (1, 3, 5, 6, 12, 24)},
    },
    {
        "gain": "greatest(coalesce(d, 0), 0)", "loss": "greatest(-coalesce(d, 0), 0)", "dm_up": "CASE WHEN rise > fall AND rise > 0 THEN rise ELSE 0 END", "dm_down": "CASE WHEN fall > rise AND fall > 0 THEN fall ELSE 0 END",
        "price_acceleration": f"d - {lag('d')}", "obv_part": f"sum(signed) {upto()}",
    },
    {
        "atr_14": full("avg", "tr", 14), "atr_7": full("avg", "tr", 7), "bb_middle": full("avg", "close", 20), "bb_sd": full("stddev_samp", "close", 20), "volume_sma_20": full("avg", "volume", 20),
        "vwap_20": ratio(full("sum", "close * volume", 20), full("sum", "volume", 20)), "vm": f"CASE WHEN count(volume) {over(50)} >= 20 THEN avg(volume) {over(50)} END", "vs": f"CASE WHEN count(volume) {over(50)} >= 20 THEN stddev_samp(volume) {over(50)} END",
        "hi_close": full("max", "close", 20), "lo_close": full("min", "close", 20), "hi_50": full("max", "high", 50), "lo_50": full("min", "low", 50), "don_hi": f"max(high) {over(20, skip=1)}", "don_lo": f"min(low) {over(20, skip=1)}",
        **{f"vol_{n}": full("stddev_samp", "lr", n) for n in (5, 50)}, "ret_mean": full("avg", "ret_1", 20), "ret_sd": full("stddev_samp", "ret_1", 20), "gk_mean": full("avg", "gk", 20), "obv_mean": full("avg", "obv_part", 20),
        "gain_2": f"CASE WHEN count(d) {over(2)} >= 2 THEN avg(gain) {over(2)} END", "loss_2": f"CASE WHEN count(d) {over(2)} >= 2 THEN avg(loss) {over(2)} END", "hi_14": full("max", "high", 14), "lo_14": full("min", "low", 14), "tp_mean": full("avg", "tp", 20),
    },
    {
        "bb_upper": "bb_middle + 2 * bb_sd", "bb_lower": "bb_middle - 2 * bb_sd", "bb_bandwidth": ratio("4 * bb_sd", "bb_middle"), "bb_pct_b": ratio("close - (bb_middle - 2 * bb_sd)", "4 * bb_sd"), "volume_ratio": ratio("volume", "volume_sma_20"), "volume_zscore": ratio("volume - vm", "vs"),
        "vol_ratio": ratio("vol_5", "vol_50"), "ret_zscore_20": ratio("ret_1 - ret_mean", "ret_sd"), "roc_12": "100 * ret_12", "dist_from_high_20": f"{ratio('close', 'hi_close')} - 1", "dist_from_low_20": f"{ratio('close', 'lo_close')} - 1",
        "gk_vol": f"sqrt(greatest(gk_mean, 0)) * sqrt({YEAR})", "obv_divergence": "obv_part - obv_mean", "buying_pressure": "close_location", "pressure_imbalance": "close_location - selling_pressure",
        "rsi_2": "CASE WHEN gain_2 IS NULL THEN NULL WHEN loss_2 = 0 THEN 100 ELSE 100 - 100 / (1 + gain_2 / loss_2) END", "williams_r": "CASE WHEN hi_14 IS NULL THEN NULL WHEN hi_14 = lo_14 THEN -50 ELSE -100 * (hi_14 - close) / (hi_14 - lo_14) END",
    },
    {"held": f"count(bb_bandwidth) {over(100)}", "earlier": f"count(*) {over(100)} - 1"},
]


def _second(below: str, mad: str) -> list[Layer]:
    return [
        {"bb_bw_percentile": f"CASE WHEN held >= 20 AND bb_bandwidth IS NOT NULL THEN 100e0 * {below} / nullif(earlier, 0) END", "mad": mad},
        {"cci": "CASE WHEN tp_mean IS NULL THEN NULL WHEN mad < 1e-12 THEN 0 ELSE (tp - tp_mean) / (0.015 * mad) END", "narrow_bars": f"sum(CASE WHEN bb_bw_percentile < 35 THEN 1 ELSE 0 END) {over(4, skip=1)}"},
    ]


#: Windows of the same closes in another order have the same bandwidth but for its last bits, so one is below another by more than what rounding leaves (some 1e-14).
_SECOND_SPARK = _second(f"size(filter(collect_list(bb_bandwidth) {over(100)}, x -> x < bb_bandwidth - 1e-12))", f"aggregate(collect_list(tp) {over(20)}, 0D, (a, x) -> a + abs(x - tp_mean)) / 20")
_SECOND_SQL = _second(f"len(list_filter(list(bb_bandwidth) {over(100)}, lambda x: x < bb_bandwidth))", f"list_sum(list_transform(list(tp) {over(20)}, lambda x: abs(x - tp_mean))) / 20")
AVERAGES = {
    "gain_14": ("gain", 1 / 14, 14), "loss_14": ("loss", 1 / 14, 14), "gain_7": ("gain", 1 / 7, 7), "loss_7": ("loss", 1 / 7, 7), "e_up": ("dm_up", 2 / 15, 14), "e_down": ("dm_down", 2 / 15, 14),
    "ema_12": ("close", 2 / 13, 12), "ema_20": ("close", 2 / 21, 20), "ema_26": ("close", 2 / 27, 26), "bmsb_ema": ("close", 2 / 22, 21), "ema_50": ("close", 2 / 51, 50), "ema_200": ("close", 2 / 201, 0), "macro_ema_480": ("close", 2 / 481, 0),
}
_THIRD: list[Layer] = [
    {"rsi_14": f"100 - 100 / (1 + {ratio('gain_14', 'loss_14')})", "rsi_7": f"100 - 100 / (1 + {ratio('gain_7', 'loss_7')})", "di_up": "100 * " + ratio("e_up", "atr_14"), "di_down": "100 * " + ratio("e_down", "atr_14"), "bmsb_bullish": "CASE WHEN close > bb_middle AND close > bmsb_ema THEN 1 ELSE 0 END"},
    {"dx": "100 * " + ratio("abs(di_up - di_down)", "di_up + di_down"), "macro_bullish": "CASE WHEN close > ema_200 THEN 1 ELSE 0 END", "bmsb_macro_bullish": "CASE WHEN close > macro_ema_480 THEN 1 ELSE 0 END"},
]
#: Scores in hundredths, the labels in the order that ties go by; labels begin after the first 50 bars.
_SCORES: list[Layer] = [
    {"span": "abs(dist_from_high_20) + abs(dist_from_low_20)"},
    {
        "s_break": "CASE WHEN bb_bw_percentile < 15 THEN 30 ELSE 0 END + CASE WHEN volume_zscore > 2 THEN 20 ELSE 0 END + CASE WHEN span < 0.02 THEN 15 ELSE 0 END",
        "s_trend": "CASE WHEN adx_14 > 30 THEN 35 ELSE 0 END",
        "s_mean": "CASE WHEN bb_bw_percentile > 80 THEN 20 ELSE 0 END + CASE WHEN abs(ret_zscore_20) > 2.5 THEN 25 ELSE 0 END + CASE WHEN span > 0.1 THEN 10 ELSE 0 END",
        "s_flat": "CASE WHEN adx_14 < 20 THEN 30 ELSE 0 END + CASE WHEN abs(ret_zscore_20) < 0.5 THEN 15 ELSE 0 END + CASE WHEN span < 0.02 THEN 15 ELSE 0 END",
        "s_shock": "CASE WHEN vol_ratio > 2.5 THEN 40 ELSE 0 END + CASE WHEN abs(ret_zscore_20) > 2.5 THEN 15 ELSE 0 END",
    },
    {"top": "greatest(s_break, s_trend, s_mean, s_flat, s_shock)", "total": "s_break + s_trend + s_mean + s_flat + s_shock"},
    {
        "regime": "CASE WHEN _i < 50 THEN 'unknown' WHEN s_break = top THEN 'breakout' WHEN s_trend = top THEN 'trend' WHEN s_mean = top THEN 'mean_reversion' WHEN s_flat = top THEN 'lateral' ELSE 'exogenous_shock' END",
        "confidence": "CASE WHEN _i < 50 OR total = 0 THEN 0e0 ELSE cast(top AS double) / total END",
    },
]
#: What signals read of the bars around the current one.
_NEXT: list[Layer] = [
    {
        "macro_trend_up": f"CASE WHEN ema_200 > {lag('ema_200', 24)} THEN 1 ELSE 0 END", "fill_open": "lead(open) OVER (PARTITION BY symbol ORDER BY hour)", "fill_hour": "lead(hour) OVER (PARTITION BY symbol ORDER BY hour)",
        "ema_12_before": lag("ema_12"), "ema_26_before": lag("ema_26"), "close_before": lag("close"), "volume_ratio_before": lag("volume_ratio"), "slope_14": f"CASE WHEN count(close) {over(14)} >= 14 THEN regr_slope(close, _i) {over(14)} END",
        **{f"{n}_{part}": f"{f}({x}) {over(7, skip=skip)}" for part, skip in (("new", 0), ("old", 7)) for n, f, x in (("low", "min", "close"), ("high", "max", "close"), ("rsi_low", "min", "rsi_14"), ("rsi_high", "max", "rsi_14"))},
        "rsi_seen": f"count(rsi_14) {over(14)}",
    },
]


def framed(df: DataFrame, layers: list[Layer], halo: int = HALO, ahead: int = 0) -> DataFrame:
    """Layers of bounded frames by symbol over rows that have _i, worked out in parts with a halo."""
    return without_halo(add_layers(with_halo(df, halo, ahead), layers))


def bounded(b: DataFrame) -> DataFrame:
    """Bars with every feature of a bounded frame."""
    return framed(indexed(b), [*_FIRST, *_SECOND_SPARK]).drop("obv_part", "obv_mean", "held", "earlier")


def recursive(df: DataFrame) -> DataFrame:
    return add_layers(ewms(df, AVERAGES), _THIRD)


def labelled(df: DataFrame) -> DataFrame:
    return framed(add_layers(ewm_gaps(df, "dx", 2 / 15, "adx_14", 14), _SCORES), _NEXT, 32, 1)


#: What the regime's scores and the queries beside them read of the bounded features.
_SCORED = ["close", "atr_14", "bb_middle", "bb_bw_percentile", "volume_zscore", "vol_ratio", "ret_zscore_20", "dist_from_high_20", "dist_from_low_20"]
_REGIME = ["symbol", "hour", "_i", "close", "atr_14", "bb_middle", "regime", "confidence"]


def regimes(b: DataFrame) -> DataFrame:
    """Bars with their regime, from the columns that it needs alone: of the thirteen averages, those of the directional movement."""
    narrow = written(framed(indexed(b), [*_FIRST, *_SECOND_SPARK]).select("symbol", "hour", "_i", "dm_up", "dm_down", *_SCORED), "regime-features")
    moved = ewms(narrow, {k: AVERAGES[k] for k in ("e_up", "e_down")})
    with_dx = add_layers(moved, [{k: _THIRD[0][k] for k in ("di_up", "di_down")}, {"dx": _THIRD[1]["dx"]}]).select("symbol", "hour", "_i", "dx", *_SCORED)
    return add_layers(ewm_gaps(written(with_dx, "regime-movement"), "dx", 2 / 15, "adx_14", 14), _SCORES).select(*_REGIME)


def frame(spark: SparkSession, sf_dir: str, hours: int = 1, symbol: str = "event_type") -> DataFrame:
    """The frame of bars of any length; each step reads the one before it several times, so steps are written."""
    if (hours, symbol) == (1, "event_type"):
        return Tables(spark, sf_dir).get("f")
    b = written(bars(spark, sf_dir, hours, symbol), "bars")
    return labelled(written(recursive(written(bounded(b), "bounded")), "recursive"))


def frame_sql(hours: int = 1, symbol: str = "event_type") -> str:
    """CTEs bars0 and f: the frame in SQL."""
    base = layers_sql("SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY hour) - 1 AS _i FROM bars0", [*_FIRST, *_SECOND_SQL])
    base = layers_sql(f"SELECT *, {', '.join(f'{ewm_sql(x, a, w)} AS {out}' for out, (x, a, w) in AVERAGES.items())} FROM ({base})", _THIRD)
    base = layers_sql(f"SELECT *, {ewm_gaps_sql('dx', 2 / 15, 14)} AS adx_14 FROM ({base})", [*_SCORES, *_NEXT])
    return f"WITH RECURSIVE bars0 AS MATERIALIZED ({bars_sql(hours, symbol)}), f AS MATERIALIZED ({base})"


def body_sql() -> str:
    """The frame over a relation bars0."""
    return frame_sql().split(", f AS MATERIALIZED (", 1)[1][:-1]


FRAME_SQL = frame_sql()
_ALL = [
    "atr_14", "atr_7", "rsi_14", "rsi_7", "adx_14", "bb_middle", "bb_upper", "bb_lower", "bb_bandwidth", "bb_pct_b", "bb_bw_percentile", "vol_ratio", "gk_vol", "volume_ratio", "vwap_20", "obv_divergence", "volume_zscore",
    "ret_1", "ret_3", "ret_6", "ret_12", "ret_24", "ret_zscore_20", "roc_12", "dist_from_high_20", "dist_from_low_20", "close_location", "buying_pressure", "selling_pressure", "pressure_imbalance", "price_acceleration", "body_wick_ratio",
    "bmsb_ema", "ema_200", "macro_ema_480", "cci", "williams_r",
]
_FLAGS = ["bmsb_bullish", "macro_bullish", "bmsb_macro_bullish", "macro_trend_up", "regime"]


def of_frame(name: str, out: list[str], where: str | None = None, hours: int = 1, symbol: str = "event_type") -> None:
    """A query of one selection from the frame."""
    QUERIES[name] = lambda s, d: frame(s, d, hours, symbol).where(where or "true").selectExpr(*out)
    SQL[name] = f"{FRAME_SQL if (hours, symbol) == (1, 'event_type') else frame_sql(hours, symbol)} SELECT {', '.join(out)} FROM f" + (f" WHERE {where}" if where else "")


of_frame("w26_all_features", [*rounded(["symbol", "hour", *_FLAGS], _ALL)])
of_frame("s09_snapshot_by_user", rounded(["symbol", "hour", "regime", "hour >= max(hour) OVER (PARTITION BY symbol) - 240 AS sealed"], ["close", "rsi_14", "adx_14", "bb_bw_percentile"]), None, 4, "user_id")
of_frame("w04_rsi", rounded(["symbol", "hour"], ["rsi_14", "rsi_7"]))
of_frame("w05_adx", ["symbol", "hour", "round(dx, 5) AS dx", "round(adx_14, 5) AS adx"])
of_frame("w25_macro_trend", rounded(["symbol", "hour", "macro_bullish", "bmsb_macro_bullish", "macro_trend_up"], ["ema_200", "macro_ema_480"]))
relation("bounded", lambda t: bounded(t.get("bars")), "SELECT 1", write=True)
relation("recursive", lambda t: recursive(t.get("bounded")), "SELECT 1", write=True)
relation("f", lambda t: labelled(t.get("recursive")), body_sql(), "bars0", write=True)
relation("rg", lambda t: regimes(t.get("bars")), f"SELECT {', '.join(_REGIME)} FROM f", "f", write=True)
query("r01_regime", "SELECT symbol, hour, regime, round(confidence, 6) AS confidence FROM {rg}")
