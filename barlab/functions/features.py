"""Rolling features of bars, as layers of built-in window expressions."""

from __future__ import annotations

from barlab.functions.layers import Layer, full, lag, over, ratio, upto

YEAR = 252 * 24

TRUE_RANGE: Layer = {"tr": f"greatest(high - low, abs(high - coalesce({lag('close')}, close)), abs(low - coalesce({lag('close')}, close)))"}

#: query name -> layers and the columns to return
FEATURES: dict[str, tuple[list[Layer], list[str]]] = {
    "w01_sma": ([{f"sma_{n}": full("avg", "close", n) for n in (10, 20, 50)}], ["sma_10", "sma_20", "sma_50"]),
    "w03_atr": ([TRUE_RANGE, {"atr_14": full("avg", "tr", 14), "atr_7": full("avg", "tr", 7)}], ["tr", "atr_14", "atr_7"]),
    "w06_bollinger": (
        [
            {"bb_middle": full("avg", "close", 20), "sd": full("stddev_samp", "close", 20)},
            {"bb_upper": "bb_middle + 2 * sd", "bb_lower": "bb_middle - 2 * sd"},
            {"bb_bandwidth": ratio("bb_upper - bb_lower", "bb_middle"), "bb_pct_b": ratio("close - bb_lower", "bb_upper - bb_lower")},
        ],
        ["bb_middle", "bb_upper", "bb_lower", "bb_bandwidth", "bb_pct_b"],
    ),
    "w08_fibonacci": (
        [
            {"hi": full("max", "high", 50), "lo": full("min", "low", 50)},
            {"fib_range": "hi - lo"},
            {f"fib_{str(x).replace('0.', '')}_{d}": (f"hi - {x} * fib_range" if d == "up" else f"lo + {x} * fib_range") for x in (0.236, 0.382, 0.5, 0.618, 0.786) for d in ("up", "dn")},
        ],
        ["fib_range", *(f"fib_{x}_{d}" for x in ("236", "382", "5", "618", "786") for d in ("up", "dn"))],
    ),
    "w10_volatility": (
        [
            {"lr": f"ln({ratio('close', lag('close'))})", "hl": f"ln({ratio('high', 'low')})"},
            {**{f"realized_vol_{n}": f"({full('stddev_samp', 'lr', n)}) * sqrt({YEAR})" for n in (5, 10, 20, 50)}, **{f"range_vol_{n}": full("avg", "hl", n) for n in (5, 10, 20, 50)}},
            {"vol_ratio": ratio("realized_vol_5", "realized_vol_50"), "gk": f"0.5 * hl * hl - (2 * ln(2) - 1) * pow(ln({ratio('close', 'open')}), 2)"},
            {"gk_vol": f"sqrt(greatest({full('avg', 'gk', 20)}, 0)) * sqrt({YEAR})"},
        ],
        [*(f"realized_vol_{n}" for n in (5, 10, 20, 50)), *(f"range_vol_{n}" for n in (5, 10, 20, 50)), "vol_ratio", "gk_vol"],
    ),
    "w14_volume": (
        [
            {
                "volume_sma_20": full("avg", "volume", 20),
                "vwap_20": ratio(full("sum", "close * volume", 20), full("sum", "volume", 20)),
                "signed": f"sign(close - coalesce({lag('close')}, close)) * volume",
                "vm": f"CASE WHEN count(volume) {over(50)} >= 20 THEN avg(volume) {over(50)} END",
                "vs": f"CASE WHEN count(volume) {over(50)} >= 20 THEN stddev_samp(volume) {over(50)} END",
            },
            {"volume_ratio": ratio("volume", "volume_sma_20"), "obv": f"sum(signed) {upto()}", "volume_zscore": ratio("volume - vm", "vs")},
            {"obv_sma": full("avg", "obv", 20)},
            {"obv_divergence": "obv - obv_sma"},
        ],
        ["volume_sma_20", "volume_ratio", "vwap_20", "obv", "obv_sma", "obv_divergence", "volume_zscore"],
    ),
    "w18_returns": (
        [
            {f"ret_{n}": f"{ratio('close', lag('close', n))} - 1" for n in (1, 3, 6, 12, 24)} | {"hi20": full("max", "close", 20), "lo20": full("min", "close", 20)},
            {"rm": full("avg", "ret_1", 20), "rs": full("stddev_samp", "ret_1", 20)},
            {"ret_zscore_20": ratio("ret_1 - rm", "rs"), "roc_12": "ret_12 * 100", "dist_from_high_20": f"{ratio('close', 'hi20')} - 1", "dist_from_low_20": f"{ratio('close', 'lo20')} - 1"},
        ],
        ["ret_1", "ret_3", "ret_6", "ret_12", "ret_24", "ret_zscore_20", "roc_12", "dist_from_high_20", "dist_from_low_20"],
    ),
    "w22_pressure": (
        [
            TRUE_RANGE,
            {"atr_14": full("avg", "tr", 14), "close_location": ratio("close - low", "high - low"), "d1": f"close - {lag('close')}", "d0": f"{lag('close')} - {lag('close', 2)}"},
            {"buying_pressure": "close_location", "selling_pressure": ratio("high - close", "high - low"), "range_atr_ratio": ratio("high - low", "atr_14"), "price_acceleration": "d1 - d0", "body_wick_ratio": ratio("abs(close - open)", "high - low")},
            {"pressure_imbalance": "buying_pressure - selling_pressure"},
            {"pressure_imbalance_ma": full("avg", "pressure_imbalance", 10)},
        ],
        ["close_location", "buying_pressure", "selling_pressure", "pressure_imbalance", "pressure_imbalance_ma", "range_atr_ratio", "price_acceleration", "body_wick_ratio"],
    ),
    "w33_rsi2": (
        [
            {"d": f"close - {lag('close')}"},
            {"g": f"CASE WHEN count(d) {over(2)} >= 2 THEN avg(greatest(d, 0)) {over(2)} END", "l": f"CASE WHEN count(d) {over(2)} >= 2 THEN avg(greatest(-d, 0)) {over(2)} END"},
            {"rsi_2": "CASE WHEN g IS NULL THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END"},
        ],
        ["rsi_2"],
    ),
    "w34_donchian": ([{"upper": f"max(high) {over(20, skip=1)}", "lower": f"min(low) {over(20, skip=1)}"}], ["upper", "lower"]),
    "w38_ichimoku": (
        [
            {"tenkan": f"({full('max', 'high', 9)} + {full('min', 'low', 9)}) / 2", "kijun": f"({full('max', 'high', 26)} + {full('min', 'low', 26)}) / 2", "span": f"({full('max', 'high', 52)} + {full('min', 'low', 52)}) / 2"},
            {"senkou_a": lag("(tenkan + kijun) / 2", 26), "senkou_b": lag("span", 26), "chikou": lag("close", 26)},
            {"cloud_top": "greatest(senkou_a, senkou_b)", "cloud_bottom": "least(senkou_a, senkou_b)"},
        ],
        ["tenkan", "kijun", "senkou_a", "senkou_b", "chikou"],
    ),
    "w42_squeeze": (
        [
            TRUE_RANGE,
            {"m": full("avg", "close", 20), "sd": full("stddev_samp", "close", 20), "atr": full("avg", "tr", 20)},
            {"squeezed": "CASE WHEN m IS NULL THEN NULL WHEN 2 * sd < 1.5 * atr THEN 1 ELSE 0 END"},
            {"squeezed_bars": f"coalesce(sum(squeezed) {over(6, skip=1)}, 0)"},
        ],
        ["squeezed", "squeezed_bars"],
    ),
    "w45_williams": ([{"h": full("max", "high", 14), "l": full("min", "low", 14)}, {"williams_r": "CASE WHEN h IS NULL THEN NULL WHEN h = l THEN -50 ELSE -100 * (h - close) / (h - l) END"}], ["williams_r"]),
    "w32_slope": ([{"t": "row_number() OVER (PARTITION BY symbol ORDER BY hour)"}, {"slope_10": f"CASE WHEN count(close) {over(11)} >= 11 THEN regr_slope(close, t) {over(11)} END"}], ["slope_10"]),
    "w51_expansion": ([TRUE_RANGE, {"atr_14": full("avg", "tr", 14)}, {"atr_expansion": ratio("atr_14", lag("atr_14", 5))}], ["atr_expansion"]),
    "w48_spike": ([{"spike_pct": f"100 * ({ratio('close', lag('close', 3))} - 1)"}], ["spike_pct"]),
}
