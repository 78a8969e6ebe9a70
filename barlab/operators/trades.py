"""Signals to trades: next-open fills, barrier exits, non-overlap, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions.features import TRUE_RANGE
from barlab.functions.layers import Layer, full, lead, over
from barlab.operators.joins import next_at_or_after
from barlab.operators.ledger import gated, one_at_a_time

#: Breakout of the prior 20 bars with a long or short side; stop and target in multiples of the average true range.
DONCHIAN: list[Layer] = [
    TRUE_RANGE,
    {"atr": full("avg", "tr", 14), "upper": f"max(high) {over(20, skip=1)}", "lower": f"min(low) {over(20, skip=1)}", "rn": "row_number() OVER (PARTITION BY symbol ORDER BY hour)", "fill_open": lead("open"), "fill_hour": lead("hour")},
    {"side": "CASE WHEN rn > 20 AND close > upper THEN 1 WHEN rn > 20 AND close < lower THEN -1 END"},
]
STOP, TARGET, HOURS, SLIPPAGE, COMMISSION = 2.0, 3.0, 24, 5e-4, 1e-3


def barrier_trades(bars: DataFrame, signals: DataFrame, hours: int = HOURS, slip: float = SLIPPAGE, fee: float = COMMISSION) -> DataFrame:
    """One candidate trade per signal: (symbol, entry_hour, exit_hour, side, entry_price, exit_price, exit_reason, gross, net).

    signals: (symbol, fill_hour, fill_open, side, atr). The stop is tested before the target, from the entry bar on; the
    time stop counts elapsed hours, and the last bar closes what is open. Bars join signals by buckets of the time stop's
    width, so the join is an equi-join with a bounded residual; a gap wider than that falls to the next bar.
    """
    s = signals.withColumns({"stop": F.expr(f"fill_open - side * {STOP}D * atr"), "target": F.expr(f"fill_open + side * {TARGET}D * atr")}).withColumn("bucket", F.expr(f"explode(sequence(fill_hour div {hours}, fill_hour div {hours} + 1))"))
    b = bars.selectExpr("symbol AS s2", "hour", "high", "low", "close", f"hour div {hours} AS b2")
    inside = (F.col("symbol") == F.col("s2")) & (F.col("bucket") == F.col("b2")) & (F.col("hour") >= F.col("fill_hour")) & (F.col("hour") < F.col("fill_hour") + hours)
    reason = F.expr("CASE WHEN (side = 1 AND low <= stop) OR (side = -1 AND high >= stop) THEN 'stop_loss' WHEN (side = 1 AND high >= target) OR (side = -1 AND low <= target) THEN 'take_profit' END")
    hit = s.join(b, inside).withColumn("reason", reason).where("reason IS NOT NULL")
    first = hit.groupBy("symbol", "fill_hour").agg(F.min(F.struct("hour", "reason")).alias("x")).selectExpr("symbol", "fill_hour", "x.hour AS hit_hour", "x.reason AS reason")
    timed = _next_bar(signals.withColumn("due", F.col("fill_hour") + hours), bars)
    t = timed.join(first, ["symbol", "fill_hour"], "left")
    raw = F.expr(f"CASE WHEN reason = 'stop_loss' THEN fill_open - side * {STOP}D * atr WHEN reason = 'take_profit' THEN fill_open + side * {TARGET}D * atr ELSE time_close END")
    t = t.withColumns({"exit_raw": raw, "exit_hour": F.coalesce("hit_hour", "time_hour"), "exit_reason": F.coalesce("reason", F.when(F.col("time_hour") >= F.col("due"), "time_stop").otherwise("end_of_data"))})
    t = t.withColumns({"entry_price": F.expr(f"fill_open * (1 + side * {slip}D)"), "exit_price": F.expr(f"exit_raw * (1 - side * {slip}D)")})
    t = t.withColumn("gross", F.expr("side * (exit_price - entry_price)"))
    return t.withColumn("net", F.expr(f"gross - {fee}D * (entry_price + exit_price)")).select("symbol", F.col("fill_hour").alias("entry_hour"), "exit_hour", "side", "entry_price", "exit_price", "exit_reason", "gross", "net")


def _next_bar(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """rows with the first bar at or after `due`, or the symbol's last bar: time_hour, time_close."""
    last = bars.groupBy("symbol").agg(F.max_by(F.struct("hour", "close"), "hour").alias("_last"))
    found = next_at_or_after(rows, bars, ["symbol"], "due", "hour", ["hour", "close"], "_next").join(last, "symbol")
    return found.select(*rows.columns, F.expr("coalesce(_next, _last).hour").alias("time_hour"), F.expr("coalesce(_next, _last).close").alias("time_close"))


def non_overlapping(trades: DataFrame) -> DataFrame:
    """Trades taken one at a time per symbol: the next entry is at or after the last exit."""
    return one_at_a_time(trades.withColumn("cfg", F.lit(""))).drop("cfg")


def risk_gate(trades: DataFrame, capital: float = 1000.0, drawdown: float = 0.2, daily_loss: float = 0.05, hours_between: int = 2) -> DataFrame:
    """The trades that pass the risk rules, taken in order of entry per symbol.

    A fall of the running equity by `drawdown` below its peak stops all later trades; a day (of 24 hours from 1970) whose
    taken trades lost `daily_loss` of the capital takes no more; entries are at least `hours_between` apart.
    """
    return gated(trades, capital, drawdown, daily_loss * capital, hours_between)


def trade_stats(trades: DataFrame, by: str = "symbol", pnl: str = "net") -> DataFrame:
    """Count, win rate, profit factor, averages and best-trade concentration."""
    p = F.col(pnl)
    return trades.groupBy(by).agg(
        F.count("*").alias("trades"), F.avg((p > 0).cast("double")).alias("win_rate"), F.sum(F.when(p > 0, p)).alias("won"), F.sum(F.when(p < 0, -p)).alias("lost"),
        F.avg(p).alias("expectancy"), F.avg(F.when(p > 0, p)).alias("avg_win"), F.avg(F.when(p < 0, p)).alias("avg_loss"), F.sum(p).alias("total"), F.max(p).alias("best"),
    ).selectExpr(by, "trades", "round(win_rate, 6) AS win_rate", "round(won / nullif(lost, 0), 6) AS profit_factor", "round(expectancy, 6) AS expectancy", "round(avg_win, 6) AS avg_win", "round(avg_loss, 6) AS avg_loss", "round(total, 4) AS total", "round(best / nullif(total, 0), 6) AS concentration")
