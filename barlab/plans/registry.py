"""Queries by operator id, and for each the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions.features import FEATURES
from barlab.functions.layers import Layer, add_layers, full, lag, layers_sql, over, ratio, rounded
from barlab.functions.recursive import ewm, ewm_sql
from barlab.functions.series import ewms
from barlab.operators.joins import asof
from barlab.operators.trades import COMMISSION, DONCHIAN, HOURS, SLIPPAGE, STOP, TARGET, barrier_trades, non_overlapping, trade_stats
from barlab.sources.bars import PANEL_SQL, bars, bars_sql, panel, table
from barlab.sources.shared import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def layered(name: str, source: Callable[[SparkSession, str], DataFrame], base: str, layers: list[Layer], out: list[str], where: str | None = None) -> None:
    """A query whose expressions mean the same in both dialects."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = add_layers(source(spark, sf_dir), layers)
        return (df.where(where) if where else df).selectExpr(*out)

    QUERIES[name] = query
    SQL[name] = f"SELECT {', '.join(out)} FROM ({layers_sql(base, layers)})" + (f" WHERE {where}" if where else "")


# ---------------------------------------------------------------- sources, features

layered("s03_bars", bars, bars_sql(), [], ["symbol", "hour", "open", "high", "low", "close", "volume"])
layered("s03_bars_4h_by_user", lambda s, d: bars(s, d, 4, "user_id"), bars_sql(4, "user_id"), [], ["symbol", "hour", "open", "high", "low", "close", "volume"])
layered("s06_panel", panel, PANEL_SQL, [], ["asset", "day", "round(open, 6) AS open", "round(close, 6) AS close"])
for _name, (_layers, _out) in FEATURES.items():
    layered(_name, bars, bars_sql(), _layers, rounded(["symbol", "hour"], _out))

# ---------------------------------------------------------------- recursive averages


def w02_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = {f"ema_{n}": ("close", 2 / (n + 1), n if n < 200 else 0) for n in (12, 26, 50, 200)}
    return ewms(bars(spark, sf_dir), spans).selectExpr(*rounded(["symbol", "hour"], list(spans)))


QUERIES["w02_ema"] = w02_ema
SQL["w02_ema"] = f"SELECT symbol, hour, {', '.join(f'round({ewm_sql("close", 2 / (n + 1), n if n < 200 else 0)}, 6) AS ema_{n}' for n in (12, 26, 50, 200))} FROM ({bars_sql()})"

_BAND: list[Layer] = [{"bmsb_sma": full("avg", "close", 20)}]


def w09_support_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ewm(add_layers(bars(spark, sf_dir), _BAND), "close", 2 / 22, "bmsb_ema", warm=21)
    return df.selectExpr("symbol", "hour", "round(bmsb_sma, 6) AS bmsb_sma", "round(bmsb_ema, 6) AS bmsb_ema", "coalesce(close > bmsb_sma AND close > bmsb_ema, false) AS bmsb_bullish", "round((bmsb_ema - bmsb_sma) / nullif(bmsb_sma, 0), 6) AS bmsb_spread")


QUERIES["w09_support_band"] = w09_support_band
SQL["w09_support_band"] = f"""SELECT symbol, hour, round(bmsb_sma, 6) AS bmsb_sma, round(e, 6) AS bmsb_ema, coalesce(close > bmsb_sma AND close > e, false) AS bmsb_bullish, round((e - bmsb_sma) / nullif(bmsb_sma, 0), 6) AS bmsb_spread
    FROM (SELECT *, {ewm_sql('close', 2 / 22, 21)} AS e FROM ({layers_sql(bars_sql(), _BAND)}))"""

# ---------------------------------------------------------------- joins and folds

_DAILY_TREND: list[Layer] = [{"mean": full("avg", "close", 5)}, {"dir": f"CASE WHEN close > mean AND mean > {lag('mean')} THEN 1 WHEN close < mean AND mean < {lag('mean')} THEN -1 ELSE 0 END", "close_time": "hour + 24"}]


def j01_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = bars(spark, sf_dir).selectExpr("symbol", "hour", "hour + 1 AS close_time")
    high = add_layers(bars(spark, sf_dir, 24), _DAILY_TREND).select("symbol", "close_time", "dir")
    return asof(low, high, "symbol", "close_time", "close_time", "dir").selectExpr("symbol", "hour", "cast(dir AS int) AS conf_1d")


QUERIES["j01_confirmation"] = j01_confirmation
SQL["j01_confirmation"] = f"""SELECT b.symbol, b.hour, coalesce(h.dir, 0)::INT AS conf_1d FROM ({bars_sql()}) b ASOF LEFT JOIN (SELECT symbol, close_time, dir FROM ({layers_sql(bars_sql(24), _DAILY_TREND)})) h
    ON b.symbol = h.symbol AND b.hour + 1 >= h.close_time"""

_NUMBERED: list[Layer] = [{"rn": "row_number() OVER (PARTITION BY symbol ORDER BY hour) - 1", "ret": f"{ratio('close', lag('close'))} - 1"}]
_LENGTHS: list[Layer] = [*_NUMBERED, {"n": "count(*) OVER (PARTITION BY symbol)"}]
_FOLD_STATS = ["count(*) AS bars", "round(avg(ret), 6) AS mean_ret", "round(avg(ret) / nullif(stddev_samp(ret), 0), 6) AS sharpe"]


def walk_forward(df: DataFrame, train: int = 200, gap: int = 12, val: int = 60, test: int = 60) -> DataFrame:
    """Statistics per symbol, fold and role, for every whole fold that a symbol's own number of rows holds."""
    size = train + gap + val + gap + test
    first, last = f"greatest(0, (rn - {size} + {test}) div {test})", f"least(rn div {test}, (n - {size}) div {test})"
    folds = add_layers(df, _LENGTHS).where(f"n >= {size} AND {first} <= {last}").selectExpr("symbol", "ret", "rn", f"explode(sequence({first}, {last})) AS fold")
    role = f"CASE WHEN at >= 0 AND at < {train} THEN 'train' WHEN at >= {train + gap} AND at < {train + gap + val} THEN 'val' WHEN at >= {size - test} AND at < {size} THEN 'test' END"
    rows = folds.withColumn("at", F.expr(f"rn - fold * {test}")).selectExpr("symbol", "cast(fold AS int) AS fold", f"{role} AS role", "ret").where("role IS NOT NULL")
    return rows.groupBy("symbol", "fold", "role").agg(*(F.expr(x) for x in _FOLD_STATS))


_FOLD_SQL = f"""WITH b AS ({layers_sql(bars_sql(), _LENGTHS)}), f AS (SELECT symbol, unnest(range(CASE WHEN max(n) >= 344 THEN (max(n) - 344) // 60 + 1 ELSE 0 END)) AS fold FROM b GROUP BY symbol)
    SELECT symbol, fold::INT AS fold, role, {', '.join(_FOLD_STATS)} FROM b JOIN f USING (symbol) JOIN (VALUES ('train', 0, 200), ('val', 212, 272), ('test', 284, 344)) t(role, lo, hi) ON rn >= fold * 60 + lo AND rn < fold * 60 + hi GROUP BY symbol, fold, role"""
for _name in ("p06_walk_forward", "p06_walk_forward_by_length"):
    QUERIES[_name] = lambda s, d: walk_forward(bars(s, d))
    SQL[_name] = _FOLD_SQL

layered("p01_lockbox_split", bars, bars_sql(), [{"cutoff": "max(hour) OVER (PARTITION BY symbol) - 168"}, {"segment": "CASE WHEN hour < cutoff THEN 'in_sample' ELSE 'lockbox' END"}], ["symbol", "hour", "segment"])

# ---------------------------------------------------------------- signals, trades, metrics

_SIGNAL = "side IS NOT NULL AND atr > 0 AND fill_open IS NOT NULL"
layered("g04_donchian_breakout", bars, bars_sql(), DONCHIAN, ["symbol", "hour", "side", "fill_hour", "round(fill_open, 6) AS fill_open", f"round(close - side * {STOP} * atr, 6) AS stop", f"round(close + side * {TARGET} * atr, 6) AS target"], _SIGNAL)
_MOMENTUM: list[Layer] = [*FEATURES["w33_rsi2"][0], *FEATURES["w14_volume"][0][:2], {"roc": f"100 * ({ratio('close', lag('close', 12))} - 1)"}]
layered("g15_momentum", bars, bars_sql(), [*_MOMENTUM, {"side": "CASE WHEN rsi_2 BETWEEN 50 AND 95 AND roc > 2 AND volume_ratio > 1 THEN 1 WHEN rsi_2 BETWEEN 5 AND 50 AND roc < -2 AND volume_ratio > 1 THEN -1 END"}], ["symbol", "hour", "side", "round(roc, 6) AS roc"], "side IS NOT NULL")
layered("g17_connors_rsi2", bars, bars_sql(), [*FEATURES["w33_rsi2"][0], {"trend": full("avg", "close", 100)}, {"side": "CASE WHEN close > trend AND rsi_2 < 10 THEN 1 WHEN close < trend AND rsi_2 > 90 THEN -1 END"}], ["symbol", "hour", "side", "round(rsi_2, 6) AS rsi_2"], "side IS NOT NULL")
layered("g19_vwap_reversion", bars, bars_sql(), [*FEATURES["w14_volume"][0][:1], {"away": f"{ratio('close', 'vwap_20')} - 1"}, {"side": "CASE WHEN away < -0.015 THEN 1 WHEN away > 0.015 THEN -1 END"}], ["symbol", "hour", "side", "round(vwap_20, 6) AS target"], "side IS NOT NULL")
layered("g07_volatility_squeeze", bars, bars_sql(), [*FEATURES["w42_squeeze"][0], {"t": "row_number() OVER (PARTITION BY symbol ORDER BY hour)"}, {"slope": f"regr_slope(close, t) {over(11)}"}, {"side": "CASE WHEN squeezed = 0 AND squeezed_bars >= 3 THEN cast(sign(slope) AS int) END"}], ["symbol", "hour", "side"], "side IS NOT NULL AND side <> 0")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every breakout signal's trade; bars are written once, as signals, hits and time stops all read them."""
    b = written(bars(spark, sf_dir), "bars")
    return barrier_trades(b, add_layers(b, DONCHIAN).where(_SIGNAL).select("symbol", "fill_hour", "fill_open", "side", "atr"))


def t06_barrier_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).selectExpr("symbol", "entry_hour", "exit_hour", "side", "exit_reason", "round(entry_price, 6) AS entry_price", "round(exit_price, 6) AS exit_price", "round(gross, 6) AS gross", "round(net, 6) AS net")


_TRADES_SQL = f"""
SELECT *, gross - {COMMISSION} * (entry_price + exit_price) AS net FROM (SELECT *, side * (exit_price - entry_price) AS gross FROM (
  SELECT symbol, fill_hour AS entry_hour, coalesce(hit.h, t.h, e.h) AS exit_hour, side, coalesce(hit.reason, CASE WHEN t.h IS NOT NULL THEN 'time_stop' ELSE 'end_of_data' END) AS exit_reason,
    fill_open * (1 + side * {SLIPPAGE}) AS entry_price,
    (CASE hit.reason WHEN 'stop_loss' THEN fill_open - side * {STOP} * atr WHEN 'take_profit' THEN fill_open + side * {TARGET} * atr ELSE coalesce(t.c, e.c) END) * (1 - side * {SLIPPAGE}) AS exit_price
  FROM sig s
  LEFT JOIN LATERAL (SELECT hour AS h, CASE WHEN (side = 1 AND low <= fill_open - 2 * atr) OR (side = -1 AND high >= fill_open + 2 * atr) THEN 'stop_loss' ELSE 'take_profit' END AS reason FROM bars b
    WHERE b.symbol = s.symbol AND hour >= fill_hour AND hour < fill_hour + {HOURS} AND ((side = 1 AND (low <= fill_open - 2 * atr OR high >= fill_open + 3 * atr)) OR (side = -1 AND (high >= fill_open + 2 * atr OR low <= fill_open - 3 * atr))) ORDER BY hour LIMIT 1) hit ON true
  LEFT JOIN LATERAL (SELECT hour AS h, close AS c FROM bars b WHERE b.symbol = s.symbol AND hour >= fill_hour + {HOURS} ORDER BY hour LIMIT 1) t ON true
  LEFT JOIN LATERAL (SELECT hour AS h, close AS c FROM bars b WHERE b.symbol = s.symbol ORDER BY hour DESC LIMIT 1) e ON true))
"""
_WITH_SIG = f"WITH bars AS ({bars_sql()}), sig AS (SELECT symbol, fill_hour, fill_open, side, atr FROM ({layers_sql('SELECT * FROM bars', DONCHIAN)}) WHERE {_SIGNAL})"
QUERIES["t06_barrier_exit"] = t06_barrier_exit
SQL["t06_barrier_exit"] = f"{_WITH_SIG} SELECT symbol, entry_hour, exit_hour, side, exit_reason, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, round(gross, 6) AS gross, round(net, 6) AS net FROM ({_TRADES_SQL})"
QUERIES["t09_non_overlap"] = lambda s, d: non_overlapping(candidates(s, d)).selectExpr("symbol", "entry_hour", "exit_hour", "side", "exit_reason", "round(net, 6) AS net")
_STATS_SQL = """round(avg((net > 0)::DOUBLE), 6) AS win_rate, round(sum(net) FILTER (net > 0) / nullif(-sum(net) FILTER (net < 0), 0), 6) AS profit_factor, round(avg(net), 6) AS expectancy,
    round(avg(net) FILTER (net > 0), 6) AS avg_win, round(avg(net) FILTER (net < 0), 6) AS avg_loss, round(sum(net), 4) AS total, round(max(net) / nullif(sum(net), 0), 6) AS concentration"""
QUERIES["a07_trade_stats"] = lambda s, d: trade_stats(candidates(s, d))
SQL["a07_trade_stats"] = f"{_WITH_SIG} SELECT symbol, count(*) AS trades, {_STATS_SQL} FROM ({_TRADES_SQL}) GROUP BY symbol"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to bars, features, breakout signals, trades one at a time, and their statistics, for every symbol."""
    b = bars(spark, sf_dir)
    return b.select("symbol").distinct().join(trade_stats(non_overlapping(candidates(spark, sf_dir))), "symbol", "left")


QUERIES["slice1_breakout_trades"] = flagship
#: In SQL, the chain of trades each of which is the first at or after the exit of the one before.
_TAKEN_SQL = f"""{_WITH_SIG.replace("WITH ", "WITH RECURSIVE ", 1)}, t AS MATERIALIZED ({_TRADES_SQL}), nx AS (SELECT x.symbol, x.entry_hour, min(y.entry_hour) AS nxt FROM t x LEFT JOIN t y ON y.symbol = x.symbol AND y.entry_hour >= x.exit_hour AND y.entry_hour > x.entry_hour GROUP BY ALL),
  c(symbol, entry_hour) AS (SELECT symbol, min(entry_hour) FROM t GROUP BY symbol UNION ALL SELECT nx.symbol, nx.nxt FROM c JOIN nx USING (symbol, entry_hour) WHERE nxt IS NOT NULL), taken AS MATERIALIZED (SELECT t.* FROM t JOIN c USING (symbol, entry_hour))"""
SQL["t09_non_overlap"] = f"{_TAKEN_SQL} SELECT symbol, entry_hour, exit_hour, side, exit_reason, round(net, 6) AS net FROM taken"
SQL["slice1_breakout_trades"] = f"{_TAKEN_SQL} SELECT symbol, trades, win_rate, profit_factor, expectancy, avg_win, avg_loss, total, concentration FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN (SELECT symbol, count(*) AS trades, {_STATS_SQL} FROM taken GROUP BY symbol) USING (symbol)"

# ---------------------------------------------------------------- panel

P = {"by": "asset", "order": "day"}
_PANEL: list[Layer] = [{"lr": f"ln({ratio('close', lag('close', **P))})", "ret": f"{ratio('close', lag('close', **P))} - 1"}]
_MOM: list[Layer] = [*_PANEL, {"score": f"ln({ratio(lag('close', 1, **P), lag('close', 21, **P))})", "vol": full("stddev_pop", "lr", 20, **P)}]
_DAY = "PARTITION BY day"
_RANKED: list[Layer] = [*_MOM, {"zs": ratio(f"score - avg(score) OVER ({_DAY})", f"stddev_pop(score) OVER ({_DAY})")}, {"rk": f"CASE WHEN zs IS NOT NULL THEN row_number() OVER ({_DAY} ORDER BY zs DESC NULLS LAST, asset) END", "names": f"count(zs) OVER ({_DAY})"}]
layered("x01_momentum", panel, PANEL_SQL, _MOM, ["asset", "day", "round(score, 6) AS score", "round(vol, 6) AS vol"])
layered("x02_idiosyncratic", panel, PANEL_SQL, [*_PANEL, {"idio": f"lr - avg(lr) OVER ({_DAY})"}, {"cum": "sum(idio) OVER (PARTITION BY asset ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}, {"score": f"cum - {lag('cum', 20, **P)}"}], ["asset", "day", "round(score, 6) AS score"])
layered("x05_zscore", panel, PANEL_SQL, _RANKED, ["asset", "day", "round(zs, 6) AS zscore"])
_BOOK: list[Layer] = [*_RANKED, {"side": "CASE WHEN names >= 6 AND rk <= 3 THEN 1 WHEN names >= 6 AND rk > names - 3 THEN -1 ELSE 0 END"}, {"w": f"CASE WHEN side <> 0 THEN side * 0.5 * {ratio('1 / nullif(vol, 0)', f'sum(CASE WHEN side <> 0 THEN 1 / nullif(vol, 0) END) OVER ({_DAY}, side)')} ELSE 0 END"}]
layered("x07_long_short_book", panel, PANEL_SQL, _BOOK, ["asset", "day", "side", "round(w, 6) AS w"], "side <> 0")
_TOP: list[Layer] = [*_RANKED, {"w": "CASE WHEN rk <= 3 THEN 1e0 / 3 ELSE 0e0 END"}, {"w_prev": f"coalesce({lag('w', **P)}, 0e0)", "w_prev2": f"coalesce({lag('w', 2, **P)}, 0e0)"}]
_DAYS = ["sum(w_prev * coalesce(ret, 0e0)) - 1e-3 * sum(abs(w_prev - w_prev2)) AS r", "sum(w_prev) AS exposure", "avg(ret) AS market", "sum(abs(w_prev - w_prev2)) AS turnover"]


def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_layers(panel(spark, sf_dir), _TOP).groupBy("day").agg(*(F.expr(x) for x in _DAYS))


_DAILY_SQL = f"SELECT day, {', '.join(_DAYS)} FROM ({layers_sql(PANEL_SQL, _TOP)}) GROUP BY day"
QUERIES["x18_daily_backtest"] = lambda s, d: daily_returns(s, d).selectExpr(*rounded(["day"], ["r", "exposure", "market", "turnover"]))
SQL["x18_daily_backtest"] = f"SELECT {', '.join(rounded(['day'], ['r', 'exposure', 'market', 'turnover']))} FROM ({_DAILY_SQL})"
_YEAR = "cast(floor(day / 365.25) AS int) + 1970"
_METRICS = [
    "count(*) AS n", "round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(365), 6) AS sharpe", "round(stddev_samp(r) * sqrt(365), 6) AS volatility",
    "round(avg(r) / nullif(stddev_samp(CASE WHEN r < 0 THEN r END), 0) * sqrt(365), 6) AS sortino", "round(exp(sum(ln(greatest(1 + r, 1e-9)))) - 1, 6) AS total_return", "round(avg(exposure), 6) AS exposure",
]
QUERIES["a16_daily_metrics_by_year"] = lambda s, d: daily_returns(s, d).withColumn("year", F.expr(_YEAR)).groupBy("year").agg(*(F.expr(x) for x in _METRICS))
SQL["a16_daily_metrics_by_year"] = f"SELECT {_YEAR} AS year, {', '.join(_METRICS)} FROM ({_DAILY_SQL}) GROUP BY 1"
QUERIES["a06_tail_risk"] = lambda s, d: daily_returns(s, d).withColumn("year", F.expr(_YEAR)).groupBy("year").agg(F.count("*").alias("n"), F.expr("round(percentile(r, 0.05), 6) AS var_95"), F.expr("round(percentile(r, 0.95), 6) AS upper_95"), F.expr("round(percentile(r, 0.5), 6) AS middle"))
SQL["a06_tail_risk"] = f"SELECT {_YEAR} AS year, count(*) AS n, round(quantile_cont(r, 0.05), 6) AS var_95, round(quantile_cont(r, 0.95), 6) AS upper_95, round(quantile_cont(r, 0.5), 6) AS middle FROM ({_DAILY_SQL}) GROUP BY 1"


def a04_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per asset: the largest fall of the close below its running maximum."""
    df = panel(spark, sf_dir).selectExpr("asset", "day", "close", "max(close) OVER (PARTITION BY asset ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak")
    return df.groupBy("asset").agg(F.expr("round(max(1 - close / peak), 6) AS max_drawdown"), F.count("*").alias("days"))


QUERIES["a04_drawdown"] = a04_drawdown
SQL["a04_drawdown"] = f"SELECT asset, round(max(1 - close / peak), 6) AS max_drawdown, count(*) AS days FROM (SELECT *, max(close) OVER (PARTITION BY asset ORDER BY day) AS peak FROM ({PANEL_SQL})) GROUP BY asset"
layered("a42_breadth_flags", panel, PANEL_SQL, [{"mean": full("avg", "close", 50, **P)}, {"above": "CASE WHEN mean IS NULL THEN NULL WHEN close > mean THEN 1e0 ELSE 0e0 END"}, {"breadth": f"avg(above) OVER ({_DAY})"}], ["asset", "day", "round(breadth, 6) AS breadth"])

# ---------------------------------------------------------------- other tables

_PNL = "(SELECT o_orderpriority AS symbol, o_totalprice - avg(o_totalprice) OVER () AS net FROM orders)"


def a07_pnl_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    mean = o.agg(F.avg("o_totalprice").alias("m"))
    return trade_stats(o.crossJoin(F.broadcast(mean)).selectExpr("o_orderpriority AS symbol", "o_totalprice - m AS net"))  # one row


QUERIES["a07_pnl_by_priority"] = a07_pnl_by_priority
SQL["a07_pnl_by_priority"] = f"SELECT symbol, count(*) AS trades, {_STATS_SQL} FROM {_PNL} GROUP BY symbol"
QUERIES["a28_confusion"] = lambda s, d: table(s, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n")).selectExpr("quality", "toxic", "n", "round(n / sum(n) OVER (PARTITION BY quality), 6) AS recall", "round(n / sum(n) OVER (PARTITION BY toxic), 6) AS precision")
SQL["a28_confusion"] = "SELECT quality, toxic, n, round(n / sum(n) OVER (PARTITION BY quality), 6) AS recall, round(n / sum(n) OVER (PARTITION BY toxic), 6) AS precision FROM (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL)"
QUERIES["a29_class_weights"] = lambda s, d: table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")).selectExpr("label", "n", "round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight")
SQL["a29_class_weights"] = "SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY ALL)"
QUERIES["s05_funding_daily"] = lambda s, d: table(s, d, "events").selectExpr("event_type AS asset", "datediff(cast(ts AS date), date'1970-01-01') AS day", "(cast(get_json_object(props, '$.k') AS double) - 50) / 1e5 AS rate").groupBy("asset", "day").agg(F.expr("round(sum(rate), 8) AS rate"), F.count("*").alias("n"))
SQL["s05_funding_daily"] = "SELECT event_type AS asset, date_diff('day', DATE '1970-01-01', ts::DATE) AS day, round(sum(((props->>'$.k')::DOUBLE - 50) / 1e5), 8) AS rate, count(*) AS n FROM events GROUP BY ALL"
_GRID = "SELECT * FROM (VALUES (10), (20), (40)) a(lookback) CROSS JOIN (VALUES (1.0), (1.5), (2.0)) b(stop_mult)"


def c03_grid_breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakout counts for every configuration of a grid: thresholds are columns of a broadcast table, lengths are enumerated."""
    df = add_layers(bars(spark, sf_dir), [{f"up_{n}": f"max(high) {over(n, skip=1)}" for n in (10, 20, 40)} | {"tr_mean": f"avg(high - low) {over(20, skip=1)}"}])
    grid = F.broadcast(spark.sql(_GRID))  # nine rows
    hit = F.expr("CASE lookback WHEN 10 THEN up_10 WHEN 20 THEN up_20 ELSE up_40 END + stop_mult * tr_mean")
    return df.crossJoin(grid).groupBy("symbol", "lookback", F.col("stop_mult").cast("double").alias("stop_mult")).agg(F.sum((F.col("close") > hit).cast("int")).alias("breakouts"))


QUERIES["c03_grid_breakouts"] = c03_grid_breakouts
SQL["c03_grid_breakouts"] = f"""SELECT symbol, lookback, stop_mult::DOUBLE AS stop_mult, sum((close > CASE lookback WHEN 10 THEN up_10 WHEN 20 THEN up_20 ELSE up_40 END + stop_mult * tr_mean)::INT) AS breakouts
    FROM (SELECT *, max(high) {over(10, skip=1)} AS up_10, max(high) {over(20, skip=1)} AS up_20, max(high) {over(40, skip=1)} AS up_40, avg(high - low) {over(20, skip=1)} AS tr_mean FROM ({bars_sql()})) CROSS JOIN ({_GRID}) GROUP BY ALL"""
