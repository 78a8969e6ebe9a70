"""Guards, splits, context rules, configuration rows, sources and joins that are tables of their own."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions.dialect import draw, duck_text
from barlab.operators.joins import asof
from barlab.plans.ledger import SPACE
from barlab.plans.relations import computed, derived, query, relation
from barlab.plans.signals import side_of
from barlab.sources.bars import bars, bars_sql
from barlab.sources.shared import shared_folder
from barlab.sources.store import add_batch, book_summary, order_book, stored_bars

# ---------------------------------------------------------------- guards and splits

derived("split_bars", "SELECT b.symbol, b.hour, b._i, b.close, CASE WHEN b.hour >= c.cutoff THEN 'lockbox' ELSE 'in_sample' END AS segment, c.cutoff FROM {b} b JOIN {cutoffs} c ON c.symbol = b.symbol")
query("p03_leakage_check", "SELECT symbol, max(CASE WHEN segment = 'in_sample' THEN hour END) AS newest_in_sample, max(cutoff) AS cutoff, max(CASE WHEN segment = 'in_sample' THEN hour END) < max(cutoff) AS sealed FROM {split_bars} GROUP BY symbol")
query("p02_tail_cutoffs", "SELECT symbol, segment, count(*) AS bars, min(hour) AS first_hour, max(hour) AS last_hour FROM {split_bars} GROUP BY symbol, segment")


def split_by_age(days: int, as_of: str = "SELECT max(hour) + 1 FROM {bars}") -> str:
    """Bars of the last `days` days before as_of (an hour, or a query of one; by default just after the newest bar) are the test part."""
    part = f"CASE WHEN hour >= as_of - {24 * days} THEN 'test' ELSE 'train' END"
    return f"SELECT symbol, {part} AS part, count(*) AS bars, max(as_of) AS as_of FROM {{bars}} CROSS JOIN (SELECT ({as_of}) AS as_of) WHERE hour < as_of GROUP BY symbol, {part}"


query("p05_split_by_age", split_by_age(7))
derived("series_sizes", "SELECT symbol, count(*) AS n FROM {b} GROUP BY symbol")
#: Folds of 200 training, 60 validation and 40 test rows without a gap, sliding by the test rows, as many as a symbol's rows hold.
#: A row lies in the folds that begin up to 299 rows before it, the last of which has all its rows.
_FIRST_FOLD, _LAST_FOLD = "cast(greatest(0, ceil((_i - 299) / 40e0)) AS bigint)", "cast(least(floor(_i / 40e0), floor((n - 300) / 40e0)) AS bigint)"
derived(
    "label_folds",
    f"""SELECT symbol, fold, CASE WHEN _i - 40 * fold < 200 THEN 'train' WHEN _i - 40 * fold < 260 THEN 'val' ELSE 'test' END AS role, hour, close FROM (
      SELECT b.symbol, b.hour, b.close, b._i, <each>{_FIRST_FOLD}, {_LAST_FOLD}</each> AS fold FROM {{b}} b JOIN {{series_sizes}} s ON s.symbol = b.symbol WHERE n >= 300 AND {_FIRST_FOLD} <= {_LAST_FOLD})""",
)
query("p08_label_folds", "SELECT symbol, fold, role, count(*) AS bars, min(hour) AS first_hour, max(hour) AS last_hour FROM {label_folds} GROUP BY symbol, fold, role")
query("j03_bars_in_folds", "SELECT symbol, fold, role, hour FROM {label_folds}")
query("u05_fold_leakage", "SELECT symbol, fold, count(*) AS shared FROM (SELECT symbol, fold, hour FROM {label_folds} WHERE role = 'train' INTERSECT SELECT symbol, fold, hour FROM {label_folds} WHERE role = 'test') GROUP BY symbol, fold UNION ALL SELECT symbol, -1, count(*) FROM (SELECT symbol, hour FROM {b} EXCEPT SELECT symbol, hour FROM {label_folds}) GROUP BY symbol")
_WANTED = ["rsi_14", "adx_14", "atr_14", "vol_ratio", "volume_ratio", "bb_pct_b", "roc_12", "ret_1", "ret_6", "cci", "williams_r", "no_such_feature"]


def _selected(t):
    have = t.get("f")
    names = [c for c in _WANTED if c in have.columns]
    if len(names) < 10:
        raise ValueError(f"only {len(names)} of the wanted features are there")
    return have.selectExpr("symbol", "hour", *(f"round({c}, 6) AS {c}" for c in names))


computed("p19_feature_intersection", _selected, f"SELECT symbol, hour, {', '.join(f'round({c}, 6) AS {c}' for c in _WANTED[:-1])} FROM f", "f")

# ---------------------------------------------------------------- sources



def _stored(t):
    """Two batches of events in the store, the second after the first; what is read is two symbols' partitions from one hour on."""
    at = f"{shared_folder(t.spark)}/bars-{uuid.uuid4().hex}"
    events = t.get("t_events").select("event_id", "ts", "event_type", "value")
    add_batch(at, 0, events.where("event_id % 5 < 4"))
    add_batch(at, 1, events.where("event_id % 5 = 4"))
    return stored_bars(t.spark, at, 1, ["click", "view"], 473500).selectExpr("symbol", "hour", "round(open, 6) AS open", "round(close, 6) AS close", "volume")


computed("s01_cached_candles", _stored, "SELECT symbol, hour, round(open, 6) AS open, round(close, 6) AS close, volume FROM bars WHERE symbol IN ('click', 'view') AND hour >= 473500", "bars")
_ORDERS = "l_partkey % 50 AS book, l_linenumber % 2 = 1 AS is_bid, l_extendedprice / l_quantity AS price, l_quantity AS size"
_BOOK_SQL = f"""SELECT book, coalesce(bids, []) AS bids, coalesce(asks, []) AS asks FROM (SELECT book, list({{'price': price, 'size': size}} ORDER BY price DESC) FILTER (is_bid)[:20] AS bids, list({{'price': price, 'size': size}} ORDER BY price) FILTER (NOT is_bid)[:20] AS asks FROM (
  SELECT book, is_bid, price, sum(size) AS size FROM (SELECT {_ORDERS} FROM lineitem) GROUP BY ALL) GROUP BY book)"""
relation("books", lambda t: order_book(t.get("t_lineitem").selectExpr(*_ORDERS.split(", ")), "book"), _BOOK_SQL)
computed("s13_book_summary", lambda t: book_summary(t.get("books"), "book").selectExpr("book", "round(bid_volume, 4) AS bid_volume", "round(ask_volume, 4) AS ask_volume", "round(spread_bps, 4) AS spread_bps"), "SELECT book, round(coalesce(list_sum(list_transform(bids, lambda x: x.size)), 0), 4) AS bid_volume, round(coalesce(list_sum(list_transform(asks, lambda x: x.size)), 0), 4) AS ask_volume, round(1e4 * (asks[1].price - bids[1].price) / nullif(bids[1].price, 0), 4) AS spread_bps FROM books", "books")
_LINE = "md5(concat_ws('|', symbol, hour, cast(round(open * 1e4) AS bigint), cast(round(high * 1e4) AS bigint), cast(round(low * 1e4) AS bigint), cast(round(close * 1e4) AS bigint), cast(round(volume * 1e4) AS bigint)))"
#: A day's digest is the hash of its sorted row hashes, a symbol's that of its days': no symbol is gathered row by row.


def _manifest(t):
    rows = t.get("bars").selectExpr("symbol", "cast(floor(hour / 24) AS bigint) AS day", f"{_LINE} AS line", "hour")
    days = rows.groupBy("symbol", "day").agg(F.expr("sha2(array_join(sort_array(collect_list(line)), ''), 256)").alias("digest"), F.count("*").alias("n"), F.min("hour").alias("a"), F.max("hour").alias("z"))
    return days.groupBy("symbol").agg(F.sum("n").alias("bars"), F.min("a").alias("first_hour"), F.max("z").alias("last_hour"), F.expr("sha2(array_join(transform(sort_array(collect_list(struct(day, digest))), x -> x.digest), ''), 256)").alias("content"))


_MANIFEST_SQL = f"""SELECT symbol, sum(n)::BIGINT AS bars, min(a) AS first_hour, max(z) AS last_hour, sha256(string_agg(digest, '' ORDER BY day)) AS content FROM (
  SELECT symbol, day, count(*) AS n, min(hour) AS a, max(hour) AS z, sha256(string_agg(line, '' ORDER BY line)) AS digest FROM (SELECT symbol, cast(floor(hour / 24) AS bigint) AS day, hour, {_LINE} AS line FROM bars) GROUP BY symbol, day) GROUP BY symbol"""
relation("manifest", _manifest, _MANIFEST_SQL, "bars")
query("s10_content_manifest", "SELECT symbol, bars, first_hour, last_hour, content FROM {manifest}")
#: A snapshot whose last symbol lost a bar: what verification must refuse.
query("s11_integrity_check", "SELECT coalesce(m.symbol, s.symbol) AS symbol, CASE WHEN s.symbol IS NULL THEN 'missing' WHEN m.symbol IS NULL THEN 'unexpected' WHEN m.bars <> s.bars THEN 'rows differ' WHEN m.first_hour <> s.first_hour OR m.last_hour <> s.last_hour THEN 'range differs' ELSE 'ok' END AS verdict FROM {manifest} m FULL OUTER JOIN (SELECT symbol, count(*) AS bars, min(hour) AS first_hour, max(hour) AS last_hour FROM (SELECT symbol, hour, max(hour) OVER (PARTITION BY symbol) AS newest, max(symbol) OVER (PARTITION BY 1) AS last_symbol FROM {bars}) WHERE NOT (symbol = last_symbol AND hour = newest) GROUP BY symbol) s ON s.symbol = m.symbol")
_REGISTRATION = "SELECT cfg, digest, bars FROM (SELECT cfg, <sha>concat_ws('|', cfg, lookback, cast(round(stop_mult * 1e6) AS bigint), cast(round(target_mult * 1e6) AS bigint), hours, lag)</sha> AS digest FROM {configs}) CROSS JOIN (SELECT count(*) AS bars FROM {bars})"
relation("registration", lambda t: t.run(_REGISTRATION), duck_text(_REGISTRATION.format(configs="configs", bars="bars")), "configs", "bars")


def preregister(rows: DataFrame, path: str) -> None:
    """Writes a registration once: what stands at the path is never overwritten or added to."""
    rows.write.mode("errorifexists").parquet(path)


def _registered(t) -> DataFrame:
    """The registration as it was written first, after an attempt to replace it that was refused."""
    at = f"{shared_folder(t.spark)}/registration-{uuid.uuid4().hex}"
    preregister(t.get("registration"), at)
    try:
        preregister(t.get("registration").limit(1), at)
    except AnalysisException:
        refused = True
    else:
        refused = False
    return t.spark.read.parquet(at).withColumn("overwrite_refused", F.lit(refused))


computed("c28_preregistration", _registered, "SELECT cfg, digest, bars, true AS overwrite_refused FROM registration", "registration")
query("c06_run_fingerprint", "SELECT symbol, substr(<sha>concat_ws('|', symbol, content, 'seed=7', 'spec=1')</sha>, 1, 16) AS run_id FROM {manifest}")

# ---------------------------------------------------------------- confirmation by higher timeframes

for _h in (4, 24):
    _w = "OVER (PARTITION BY symbol ORDER BY hour)"
    relation(f"bars_{_h}", lambda t, h=_h: bars(t.spark, t.sf_dir, h), bars_sql(_h))
    derived(f"trend_{_h}", f"SELECT symbol, hour + {_h} AS close_time, CASE WHEN close > m AND m > lag(m) {_w} THEN 1 WHEN close < m AND m < lag(m) {_w} THEN -1 ELSE 0 END AS dir FROM (SELECT symbol, hour, close, avg(close) OVER (PARTITION BY symbol ORDER BY hour ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM {{bars_{_h}}})")
_CONF = "SELECT b.symbol, b.hour, coalesce(x.dir, 0)::INT AS conf_4h, coalesce(y.dir, 0)::INT AS conf_1d FROM bars b ASOF LEFT JOIN trend_4 x ON b.symbol = x.symbol AND b.hour + 1 >= x.close_time ASOF LEFT JOIN trend_24 y ON b.symbol = y.symbol AND b.hour + 1 >= y.close_time"


def _confirmed(t):
    df = t.get("bars").selectExpr("symbol", "hour", "hour + 1 AS close_time")
    for h, out in ((4, "conf_4h"), (24, "conf_1d")):
        df = asof(df, t.get(f"trend_{h}").withColumnRenamed("dir", out), "symbol", "close_time", "close_time", out)
    return df.selectExpr("symbol", "hour", "cast(conf_4h AS int) AS conf_4h", "cast(conf_1d AS int) AS conf_1d")


relation("confirmed", _confirmed, _CONF, "bars", "trend_4", "trend_24", write=True)
query("j02_confirmations", "SELECT symbol, hour, conf_4h, conf_1d FROM {confirmed}")
derived("momentum_signals", f"SELECT symbol, hour, {side_of('g15_momentum')} AS side FROM {{f}} WHERE {side_of('g15_momentum')} IS NOT NULL")
query("g22_two_timeframes", "SELECT s.symbol, s.hour, s.side, s.side * conf_4h >= 0 AND s.side * conf_1d >= 0 AS no_oppose, s.side = conf_4h AND s.side = conf_1d AS all_agree FROM {momentum_signals} s JOIN {confirmed} c ON c.symbol = s.symbol AND c.hour = s.hour")
query("w52_trend_direction", "SELECT symbol, hour, CASE WHEN close > ema_50 AND ema_50 > lag(ema_50) OVER (PARTITION BY symbol ORDER BY hour) THEN 1 WHEN close < ema_50 AND ema_50 < lag(ema_50) OVER (PARTITION BY symbol ORDER BY hour) THEN -1 ELSE 0 END AS dir FROM {f}")
query("w35_ema_cross", "SELECT symbol, hour, round(ema_12, 6) AS fast, round(ema_26, 6) AS slow, CASE WHEN ema_12_before <= ema_26_before AND ema_12 > ema_26 THEN 'golden' WHEN ema_12_before >= ema_26_before AND ema_12 < ema_26 THEN 'death' END AS cross_kind FROM {f} WHERE ema_26 IS NOT NULL")
query("w44_compression_bars", "SELECT symbol, hour, sum(CASE WHEN bb_bw_percentile < 35 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY hour ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING) AS compressed FROM {f}")

# ---------------------------------------------------------------- scenarios, recommendations, hypotheses, consensus

#: (regime, scenario, probability, direction, multiple of the range, strategy, status); fixed values of the scenario rules.
SCENARIOS = [
    ("breakout", "upside_breakout", 0.35, "up", 2.0, "volatility_breakout", "ACTIVE"), ("breakout", "upside_breakout", 0.35, "up", 2.0, "mean_reversion", "AVOID"), ("breakout", "upside_breakout", 0.35, "up", 2.0, "trend_following", "STANDBY"),
    ("breakout", "downside_breakout", 0.30, "down", 2.0, "volatility_breakout", "ACTIVE"), ("breakout", "whipsaw", 0.35, "flat", 1.0, "volatility_breakout", "CAUTION"), ("breakout", "whipsaw", 0.35, "flat", 1.0, "trend_following", "AVOID"),
    ("trend", "continuation", 0.50, "with", 2.0, "trend_following", "ACTIVE"), ("trend", "continuation", 0.50, "with", 2.0, "mean_reversion", "AVOID"), ("trend", "exhaustion", 0.25, "against", 1.5, "mean_reversion", "POSSIBLE"), ("trend", "consolidation", 0.25, "flat", 0.5, "trend_following", "STANDBY"),
    ("mean_reversion", "reversion", 0.45, "against", 1.5, "mean_reversion", "ACTIVE"), ("mean_reversion", "reversion", 0.45, "against", 1.5, "volatility_breakout", "AVOID"), ("mean_reversion", "continued_extreme", 0.30, "with", 2.0, "trend_following", "POSSIBLE"),
    ("lateral", "range", 0.55, "flat", 0.5, "mean_reversion", "ACTIVE"), ("lateral", "range", 0.55, "flat", 0.5, "trend_following", "AVOID"), ("lateral", "range_break", 0.45, "up", 1.5, "volatility_breakout", "STANDBY"),
    ("exogenous_shock", "aftershock", 0.50, "down", 3.0, "volatility_breakout", "CAUTION"), ("exogenous_shock", "aftershock", 0.50, "down", 3.0, "trend_following", "AVOID"), ("exogenous_shock", "snap_back", 0.50, "up", 2.0, "mean_reversion", "POSSIBLE"),
]
derived("scenarios", " UNION ALL ".join(f"SELECT '{r}' AS regime, '{s}' AS scenario, {p!r}e0 AS probability, '{d}' AS direction, {m!r}e0 AS multiple, '{st}' AS strategy, '{x}' AS status" for r, s, p, d, m, st, x in SCENARIOS))
derived("latest", "SELECT * FROM (SELECT *, max(hour) OVER (PARTITION BY symbol) AS newest FROM {f}) WHERE hour = newest", write=True)
query("r04_scenario_table", "SELECT DISTINCT f.symbol, f.hour, f.regime, scenario, probability, direction, round(multiple * 100 * atr_14 / close, 6) AS magnitude_pct FROM {rg} f JOIN {scenarios} s ON s.regime = f.regime")
query("j16_strategy_status", "SELECT f.symbol, f.hour, strategy, status, max(probability) AS probability FROM {rg} f JOIN {scenarios} s ON s.regime = f.regime GROUP BY f.symbol, f.hour, strategy, status")
query("r05_recommended", "SELECT f.symbol, f.hour, strategy, max(CASE WHEN status = 'ACTIVE' THEN 1 ELSE 0 END) = 1 AS recommended, max(CASE WHEN status = 'AVOID' THEN 1 ELSE 0 END) = 1 AS avoided, max(CASE WHEN f.regime = 'exogenous_shock' THEN 1 ELSE 0 END) = 1 AS shock_flag, max(CASE WHEN confidence < 0.3 THEN 1 ELSE 0 END) = 1 AS low_confidence_flag FROM {rg} f JOIN {scenarios} s ON s.regime = f.regime WHERE probability > 0.3 GROUP BY f.symbol, f.hour, strategy")
#: (regime, hypothesis, strategy or 'all', parameter, value)
HYPOTHESES = [(r, h, s, p, v) for r, h, s, p, vs in (("breakout", "volume_surge", "volatility_breakout", "volume_threshold", (1.5, 2.0, 2.5)), ("breakout", "confirmation", "volatility_breakout", "confirmation_bars", (1, 2, 3)), ("mean_reversion", "z_score", "mean_reversion", "zscore_entry", (2.0, 2.5, 3.0)), ("trend", "adx_floor", "trend_following", "adx_min", (20, 25, 30)), ("lateral", "stops", "all", "stop_mult", (1.5, 2.0, 2.5))) for v in vs]
derived("hypotheses", " UNION ALL ".join(f"SELECT '{r}' AS regime, '{h}' AS hypothesis, '{s}' AS strategy, '{p}' AS param, {float(v)!r}e0 AS value" for r, h, s, p, v in HYPOTHESES))
query("r06_hypotheses", "SELECT f.regime, hypothesis, strategy, param, value, count(*) AS bars FROM {rg} f JOIN {hypotheses} h ON h.regime = f.regime GROUP BY f.regime, hypothesis, strategy, param, value")
query("j13_hypothesis_matches", "SELECT s.strategy AS name, hypothesis, param, value, bars FROM (SELECT DISTINCT strategy FROM {scenarios}) s JOIN {hypotheses} h ON h.strategy = s.strategy OR h.strategy = 'all' JOIN (SELECT regime, count(*) AS bars FROM {rg} GROUP BY regime) r ON r.regime = h.regime")
query("c05_perturbed_configs", f"SELECT symbol, hypothesis, strategy, param, i AS trial, round(value * (0.7 + 0.6 * {draw(31, 'symbol', 'hypothesis', 'param', 'value', 'i')}), 6) AS value FROM (SELECT symbol, regime, count(*) AS bars FROM {{rg}} GROUP BY symbol, regime) r JOIN {{hypotheses}} h ON h.regime = r.regime CROSS JOIN (SELECT i FROM {{numbers}} WHERE i < 5) WHERE bars >= 20")
_VOTES = {
    "whale": ("ret_1 < -0.02", "ret_1 > 0.03"), "momentum": ("regime = 'trend' AND ret_1 > 0", "regime = 'trend' AND ret_1 <= 0"), "reversion": ("rsi_14 < 25", "rsi_14 > 75"), "retail": ("ret_1 > 0.03 AND volume_ratio > 2", "ret_1 < -0.03"),
    "market_maker": ("false", "false"), "institutional": ("adx_14 > 30 AND ret_1 > 0", "adx_14 > 30 AND ret_1 <= 0"),
}
_FOR, _AGAINST = (" + ".join(f"CASE WHEN {v[k]} THEN 1 ELSE 0 END" for v in _VOTES.values()) for k in (0, 1))
query("a33_consensus", f"SELECT symbol, hour, bullish, bearish, 6 - bullish - bearish AS neutral, round((bullish - bearish) / 6e0, 6) AS net_sentiment FROM (SELECT symbol, hour, {_FOR} AS bullish, {_AGAINST} AS bearish FROM {{f}} WHERE ret_1 IS NOT NULL)")
query("a30_regime_distribution", "SELECT regime, count(*) AS bars, round(count(*) / max(n), 6) AS share FROM {rg} CROSS JOIN (SELECT cast(count(*) AS double) AS n FROM {rg}) GROUP BY regime")

# ---------------------------------------------------------------- configurations

#: Of every symbol; a look-back takes at most a tenth of its bars, stop and target are also given in prices by its mean range.
_RANDOM = ", ".join(f"cast(floor({lo} + ({hi} - {lo} + 1) * {draw(40 + j, 'symbol', 'i')}) AS int) AS {p}" if kind == "int" else f"{lo} + ({hi - lo}) * {draw(40 + j, 'symbol', 'i')} AS {p}" for j, (p, kind, lo, hi, _) in enumerate(SPACE))
query(
    "c01_random_configs",
    f"""SELECT symbol, cfg, cast(greatest(2, least(lookback, floor(bars / 10e0))) AS int) AS lookback, round(stop_mult, 6) AS stop_mult, round(target_mult, 6) AS target_mult, hours, round(stop_mult * mean_range, 5) AS stop_distance, round(target_mult * mean_range, 5) AS target_distance FROM (
      SELECT symbol, cfg, bars, mean_range, lookback, stop_mult, CASE WHEN target_mult <= stop_mult THEN stop_mult * 1.5 ELSE target_mult END AS target_mult, hours FROM (
        SELECT symbol, i AS cfg, bars, mean_range, {_RANDOM} FROM (SELECT symbol, count(*) AS bars, avg(high - low) AS mean_range FROM {{bars}} GROUP BY symbol) CROSS JOIN {{numbers}} WHERE i < 500))""",
)
_GRIDS = {
    "wide": {"lookback": (10, 20, 40), "stop_mult": (2.0,), "target_mult": (3.0, 4.0, 5.0)}, "stops": {"lookback": (15, 20, 25), "stop_mult": (1.5, 2.0, 2.5, 3.0, 3.5), "target_mult": (3.0, 5.0)},
    "targets": {"lookback": (20, 30), "stop_mult": (2.0, 2.5), "target_mult": (2.5, 3.0, 4.0, 5.0, 6.0, 8.0)}, "fine": {"lookback": (18, 20, 22, 24), "stop_mult": (1.8, 2.0, 2.2), "target_mult": (2.8, 3.0, 3.2, 4.0)},
}


def _axis(name: str, values: tuple) -> str:
    return "(" + " UNION ALL ".join(f"SELECT {float(v)!r}e0 AS {name}" for v in values) + ")"


derived("grids", " UNION ALL ".join(f"SELECT '{g}' AS phase, lookback, stop_mult, target_mult FROM " + " CROSS JOIN ".join(_axis(k, v) for k, v in axes.items()) for g, axes in _GRIDS.items()))
query("c03_grid_phases", "SELECT symbol, lookback, stop_mult, target_mult, count(*) AS phases, min(phase) AS first_phase FROM {grids} JOIN (SELECT symbol, count(*) AS bars FROM {bars} GROUP BY symbol) ON bars >= 3 * lookback GROUP BY symbol, lookback, stop_mult, target_mult")
#: The grid against the bars: a configuration's signals are the breaks of its look-back, counted once a look-back before the grid is joined.
derived("breaks_by_lookback", "SELECT symbol, lookback, count(*) AS signals, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS longs, avg(atr) AS mean_atr FROM {breaks} GROUP BY symbol, lookback")
derived("grid_signals", "SELECT symbol, phase, g.lookback, stop_mult, target_mult, signals, longs, mean_atr FROM {grids} g JOIN {breaks_by_lookback} x ON x.lookback = g.lookback")
query("j08_grid_by_symbol", "SELECT symbol, phase, lookback, stop_mult, target_mult, signals, longs, round(stop_mult * mean_atr, 6) AS mean_stop, round(target_mult * mean_atr, 6) AS mean_target FROM {grid_signals}")
query("u03_grid_dedupe", "SELECT symbol, count(*) AS rows_before, count(DISTINCT concat_ws('|', lookback, stop_mult, target_mult)) AS rows_after, sum(signals) AS signals FROM {grid_signals} GROUP BY symbol")
query("p15_regime_allowed", "SELECT symbol, hour, regime FROM {rg} WHERE regime IN ('trend', 'breakout') AND close > bb_middle")

# ---------------------------------------------------------------- maps, types, sinks, scores by family

computed("f08_config_json", lambda t: t.get("configs").selectExpr("cfg", "to_json(named_struct('hours', hours, 'lookback', lookback)) AS params", "cast(get_json_object(to_json(named_struct('hours', hours, 'lookback', lookback)), '$.lookback') AS int) AS lookback").join(t.get("taken").groupBy("cfg").agg(F.count("*").alias("trades")), "cfg"), "SELECT cfg, to_json({'hours': hours, 'lookback': lookback})::VARCHAR AS params, lookback, trades FROM configs JOIN (SELECT cfg, count(*) AS trades FROM taken GROUP BY cfg) USING (cfg)", "configs", "taken")
query("s16_downcast", "SELECT symbol, hour, round(cast(cast(close AS float) AS double), 3) AS close FROM {bars}")
query("ud4_family_scores", "SELECT asset, day, family, round(CASE family WHEN 'momentum' THEN mom_20 WHEN 'carry' THEN carry ELSE mom_20 - avg(mom_20) OVER (PARTITION BY day, family) END, 10) AS score FROM {px} CROSS JOIN (SELECT 'momentum' AS family UNION ALL SELECT 'carry' UNION ALL SELECT 'idiosyncratic')")


def _sinks(t):
    """The leaderboard appended as JSON and as CSV in the shared folder, and read again from both."""
    at = f"{shared_folder(t.spark)}/sinks-{uuid.uuid4().hex}"
    rows = t.run("SELECT symbol, count(*) AS trades, round(sum(net), 4) AS net FROM {taken} WHERE cfg = 'base' GROUP BY symbol")
    schema = "symbol string, trades long, net double"
    rows.write.mode("append").json(f"{at}/json")
    rows.write.mode("append").option("header", True).csv(f"{at}/csv")
    kinds = t.spark.read.schema(schema).json(f"{at}/json").selectExpr("'json' AS sink", "*").unionByName(t.spark.read.schema(schema).option("header", True).csv(f"{at}/csv").selectExpr("'csv' AS sink", "*"))
    return kinds


computed("s17_sinks", _sinks, "SELECT sink, symbol, trades, net FROM (SELECT symbol, count(*) AS trades, round(sum(net), 4) AS net FROM taken WHERE cfg = 'base' GROUP BY symbol) CROSS JOIN (SELECT 'json' AS sink UNION ALL SELECT 'csv')", "taken")
