"""Trades of many configurations at once: barriers per row, one position at a time, sized ledgers.

Keys are (symbol, cfg). Nothing gathers a symbol's trades or passes over all of them in one task: non-overlap folds islands
of trades that can touch each other, risk rules fold stretches that do not bear on each other, and equities, peaks and
breakers are running values in chunks. The breaker of overlays runs down a configuration's days, as its own state scales
what it sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions.series import running
from barlab.operators.joins import next_at_or_after
from barlab.sources.shared import written

#: Hours of a bucket in which bars and open trades meet.
WIDTH = 48
KEY = ["symbol", "cfg"]


def barrier_exits(bars: DataFrame, signals: DataFrame, flag: str = "false") -> DataFrame:
    """signals with exit_hour, exit_price (before slippage), exit_reason and bars_held.

    signals: KEY, fill_hour, from_hour, fill, side, stop, target, hours. bars: symbol, hour, _i, open, high, low, close,
    next_hour, next_open, next_close. From from_hour on, a bar before the time stop that reaches the stop or else the
    target closes the trade there; a bar with `flag` closes it at the next open; otherwise the first bar at or after the
    time stop, or the symbol's last bar. Bars and trades meet in buckets of time, each trade in those it can last.
    """
    s = signals.withColumn("due", F.col("fill_hour") + F.col("hours")).withColumn("bucket", F.expr(f"explode(sequence(fill_hour div {WIDTH}, (due - 1) div {WIDTH}))"))
    b = bars.selectExpr("symbol AS s2", "hour", "_i", "high", "low", "close", "next_hour", "next_open", "next_close", f"hour div {WIDTH} AS b2", f"{flag} AS flag")
    met = s.join(b, (F.col("symbol") == F.col("s2")) & (F.col("bucket") == F.col("b2")) & (F.col("hour") >= F.col("fill_hour")) & (F.col("hour") < F.col("due")))
    reason = "CASE WHEN hour < from_hour THEN NULL WHEN (side = 1 AND low <= stop) OR (side = -1 AND high >= stop) THEN 'stop_loss' WHEN (side = 1 AND high >= target) OR (side = -1 AND low <= target) THEN 'take_profit' WHEN flag AND next_hour IS NOT NULL THEN 'signal_exit' END"
    met = met.withColumn("reason", F.expr(reason))
    when = "CASE WHEN reason IS NOT NULL THEN struct(hour AS at, reason, CASE reason WHEN 'stop_loss' THEN stop WHEN 'take_profit' THEN target ELSE next_open END AS price, CASE WHEN reason = 'signal_exit' THEN next_hour ELSE hour END AS hour, CASE WHEN reason = 'signal_exit' THEN _i + 1 ELSE _i END AS i) END"
    ends = met.groupBy(*KEY, "fill_hour").agg(F.expr(f"min({when})").alias("hit"), F.expr("max(struct(hour, close, next_hour, next_close, _i))").alias("last"), F.min("_i").alias("first_i"))
    out = signals.join(ends, [*KEY, "fill_hour"]).withColumns({
        "exit_hour": F.expr("coalesce(hit.hour, last.next_hour, last.hour)"), "exit_raw": F.expr("coalesce(hit.price, last.next_close, last.close)"),
        "exit_reason": F.expr("coalesce(hit.reason, CASE WHEN last.next_hour IS NOT NULL THEN 'time_stop' ELSE 'end_of_data' END)"), "bars_held": F.expr("coalesce(hit.i, CASE WHEN last.next_hour IS NOT NULL THEN last._i + 1 ELSE last._i END) - first_i"),
    })
    return out.drop("hit", "last", "first_i")


def one_at_a_time(trades: DataFrame, fold_rows: int = 2048) -> DataFrame:
    """Trades taken so that each enters at or after the exit of the one taken before it, in order of (entry_hour), which differs within a key.

    An island begins where every earlier trade has ended, so its first trade is always taken and islands do not touch.
    Islands of up to fold_rows trades are folded alone; in larger ones every trade points to the first that it lets in, and
    what the first trade leads to is found by doubling the pointers: joins of narrow rows, as many as the logarithm of the
    longest chain, and no island in one task.
    """
    columns = trades.columns
    trades = written(trades, "candidate-trades")
    marked = running(trades, {"_busy": ("max", "exit_hour")}, KEY, "entry_hour", exclusive=True)
    islands = written(running(marked, {"_island": ("max", "CASE WHEN coalesce(entry_hour >= _busy, true) THEN entry_hour END")}, KEY, "entry_hour").drop("_busy"), "islands")
    key = [*KEY, "_island"]
    large = islands.groupBy(*key).count().where(F.col("count") > fold_rows).drop("count")
    if large.isEmpty():
        return _folded(islands, columns)
    large = written(large, "large-islands")
    return _folded(islands.join(large, key, "left_anti"), columns).unionByName(_doubled(islands.join(large, key, "left_semi"), key).select(*columns))


def _folded(islands: DataFrame, columns: list[str]) -> DataFrame:
    row = F.struct("entry_hour", *(c for c in columns if c != "entry_hour"))
    folded = islands.groupBy(*KEY, "_island").agg(F.sort_array(F.collect_list(row)).alias("_all")).selectExpr(
        "inline(aggregate(_all, named_struct('free', -9223372036854775808L, 'taken', filter(_all, x -> false)), (a, x) -> if(x.entry_hour >= a.free, named_struct('free', x.exit_hour, 'taken', concat(a.taken, array(x))), a)).taken)"
    )
    return folded.select(*columns)


def _doubled(islands: DataFrame, key: list[str]) -> DataFrame:
    """The trades that each island's first one leads to."""
    trades = islands.select(*key, "entry_hour", F.greatest(F.col("exit_hour"), F.col("entry_hour") + 1).alias("free"))
    jumps = written(next_at_or_after(trades, trades, key, "free", "entry_hour", ["entry_hour"], "_next").selectExpr(*key, "entry_hour AS here", "_next.entry_hour AS there").where("there IS NOT NULL"), "jumps")
    reached = written(trades.select(*key, F.col("_island").alias("here")).distinct(), "reached")
    while not jumps.isEmpty():
        reached = written(reached.unionByName(reached.join(jumps, [*key, "here"]).select(*key, F.col("there").alias("here"))), "reached")
        jumps = written(jumps.join(jumps.select(*key, F.col("here").alias("there"), F.col("there").alias("_to")), [*key, "there"]).select(*key, "here", F.col("_to").alias("there")), "jumps")
    return islands.join(reached.withColumnRenamed("here", "entry_hour"), [*key, "entry_hour"], "left_semi")


def held_bars(trades: DataFrame, bars: DataFrame, most: int = 49, last: bool = False) -> DataFrame:
    """Trades with the bars (p_hour, p_close, p_high, p_low) from their entry to before their exit (or with it), `most` hours at most; they meet in buckets of time."""
    end = F.least(F.col("exit_hour") + F.lit(1 if last else 0), F.col("entry_hour") + most)
    t = trades.withColumn("_end", end).where("_end > entry_hour").withColumn("_bucket", F.expr(f"explode(sequence(entry_hour div {WIDTH}, (_end - 1) div {WIDTH}))"))
    b = bars.selectExpr("symbol", "hour AS p_hour", "close AS p_close", "high AS p_high", "low AS p_low", f"hour div {WIDTH} AS _bucket")
    return t.join(b, ["symbol", "_bucket"]).where("p_hour >= entry_hour AND p_hour < _end").drop("_bucket", "_end")


#: Capital, daily loss and drawdown limits in percent, hours between an exit and the next entry, Kelly fraction, target of yearly volatility, cap of a position.
RULES = {"capital": 1000.0, "breaker_pct": 12.0, "daily_pct": 2.0, "hours_between": 2.0, "kelly": 0.125, "target_vol": 0.5, "cap": 0.15}


def _stretches(trades: DataFrame, key: list[str], last: str, hours_between: float) -> DataFrame:
    """Adds _day and _stretch: a stretch begins on a new day whose first entry is `hours_between` after every earlier `last`, so nothing of the days before bears on it."""
    t = running(trades.withColumn("_day", F.expr("entry_hour div 24")), {"_last": ("max", last), "_before": ("max", "_day")}, key, "entry_hour", exclusive=True)
    begins = f"_last IS NULL OR (_day > _before AND entry_hour - _last >= {hours_between})"
    return running(t, {"_stretch": ("max", f"CASE WHEN {begins} THEN entry_hour END")}, key, "entry_hour").drop("_last", "_before")


def _judged(trades: DataFrame, key: list[str], fields: list[str], state: str, step: str) -> DataFrame:
    """Folds each stretch in order of entry; `step` makes the next state s from s and a trade x, and puts what it says of x to s.out."""
    row = F.struct("entry_hour", *fields)
    folded = trades.groupBy(*key, "_stretch").agg(F.sort_array(F.collect_list(row)).alias("_all"))
    return folded.selectExpr(*key, f"inline(aggregate(_all, {state}, (s, x) -> {step}).out)")


def _first_break(judged: DataFrame, key: list[str], broken: str) -> DataFrame:
    """Adds _broken: whether a row or one before it is broken."""
    first = judged.where(broken).groupBy(*key).agg(F.min("entry_hour").alias("_first"))
    return judged.join(first, key, "left").withColumn("_broken", F.expr("coalesce(entry_hour >= _first, false)")).drop("_first")


def sized(trades: DataFrame, rules: dict[str, float] | None = None) -> DataFrame:
    """Every taken trade with the verdict of the risk rules, the sizes it may have, its result at volatility-scaled size and the equity after it.

    Sizes are shares of the equity, so an approved trade multiplies it, and what the rules compare are ratios of equities.
    The day's loss and the least interval can thus be judged in stretches that do not bear on each other, each folded
    alone from an equity of one. The equity is then a running product and its peak a running maximum, both in chunks, and
    the breaker falls for good at the first trade before which they are too far apart: nothing before it depends on it.
    """
    r = rules or RULES
    vol = f"least({r['cap']}D, CASE WHEN atr > 0 AND fill > 0 THEN {r['target_vol']}D / greatest(atr / fill * sqrt(365), 0.01D) ELSE 0.05D END)"
    t = _stretches(trades.selectExpr(*KEY, "entry_hour", "exit_hour", f"{vol} AS vol", "ret"), KEY, "exit_hour", r["hours_between"])
    lost = "if(x._day > s.day, 0D, s.lost)"
    verdict = f"CASE WHEN {lost} < 0 AND -({lost}) / s.e * 100 >= {r['daily_pct']}D THEN 'daily_loss_limit' WHEN s.last IS NOT NULL AND x.entry_hour - s.last < {r['hours_between']} THEN 'min_interval' ELSE 'approved' END"
    pnl = f"if({verdict} = 'approved', x.vol * s.e * x.ret, 0D)"
    state = "named_struct('e', 1D, 'day', -1L, 'lost', 0D, 'last', cast(NULL AS bigint), 'out', cast(array() AS array<struct<entry_hour:bigint,vol:double,ret:double,verdict:string>>))"
    step = f"named_struct('e', s.e + {pnl}, 'day', greatest(s.day, x._day), 'lost', {lost} + {pnl}, 'last', if({verdict} = 'approved', x.exit_hour, s.last), 'out', concat(s.out, array(named_struct('entry_hour', x.entry_hour, 'vol', x.vol, 'ret', x.ret, 'verdict', {verdict}))))"
    judged = _judged(t, KEY, ["exit_hour", "_day", "vol", "ret"], state, step).withColumn("_g", F.expr("if(verdict = 'approved', ln(greatest(1 + vol * ret, 1e-300D)), 0D)"))
    before = running(written(judged, "judged-trades"), {"_log": ("sum", "_g")}, KEY, "entry_hour", exclusive=True)
    before = running(before, {"_peak": ("max", "_log + _g")}, KEY, "entry_hour", exclusive=True).withColumn("_peak", F.expr("greatest(0D, _peak)"))
    broken = _first_break(before, KEY, f"100 * (1 - exp(_log - _peak)) >= {r['breaker_pct']}D")
    # behind the break nothing is taken, so the equity stays
    broken = broken.withColumn("verdict", F.expr("if(_broken, 'circuit_breaker', verdict)")).withColumn("_g", F.expr("if(_broken, 0D, _g)"))
    e = running(broken.drop("_log"), {"_log": ("sum", "_g")}, KEY, "entry_hour", exclusive=True).withColumn("_e", F.expr(f"{r['capital']}D * exp(_log)"))
    e = e.withColumn("pnl", F.expr("if(verdict = 'approved', vol * _e * ret, 0D)"))
    e = running(e, {"_lost": ("sum", "CASE WHEN verdict = 'approved' AND pnl < 0 THEN 1L ELSE 0L END")}, KEY, "entry_hour")
    e = running(e, {"_won": ("max", "CASE WHEN verdict = 'approved' AND pnl >= 0 THEN _lost END")}, KEY, "entry_hour")
    sizes = {"fixed": "0.1D", "kelly": f"{r['kelly']}D", "volatility": "vol"}
    return e.selectExpr(*KEY, "entry_hour", "verdict", *(f"least({x}, {r['cap']}D) * _e AS size_{n}" for n, x in sizes.items()), "pnl", "_e + pnl AS equity", "_lost - coalesce(_won, 0) AS losses")


def gated(trades: DataFrame, capital: float, drawdown: float, loss: float, hours_between: int) -> DataFrame:
    """(symbol, entry_hour, exit_hour, side, net) of the trades that the breaker, the day's loss and the least interval between entries let through.

    As for `sized`, stretches are folded alone; the equity is a running sum, its peak a running maximum, and the breaker
    ends what comes after the first trade before which they are too far apart.
    """
    key = ["symbol"]
    t = _stretches(trades.select("symbol", "entry_hour", "exit_hour", "side", "net"), key, "entry_hour", hours_between)
    lost = "if(x._day > s.day, 0D, s.lost)"
    ok = f"({lost} > -{loss!r}D AND (s.last IS NULL OR x.entry_hour - s.last >= {hours_between}))"
    state = "named_struct('day', -1L, 'lost', 0D, 'last', cast(NULL AS bigint), 'out', cast(array() AS array<struct<entry_hour:bigint,exit_hour:bigint,side:int,net:double,ok:boolean>>))"
    step = f"named_struct('day', greatest(s.day, x._day), 'lost', {lost} + if({ok}, x.net, 0D), 'last', if({ok}, x.entry_hour, s.last), 'out', concat(s.out, array(named_struct('entry_hour', x.entry_hour, 'exit_hour', x.exit_hour, 'side', x.side, 'net', x.net, 'ok', {ok}))))"
    judged = _judged(t.withColumn("side", F.col("side").cast("int")), key, ["exit_hour", "_day", "side", "net"], state, step).where("ok")
    before = running(written(judged, "judged-trades"), {"_sum": ("sum", "net")}, key, "entry_hour", exclusive=True)
    before = running(before, {"_peak": ("max", "_sum + net")}, key, "entry_hour", exclusive=True).withColumn("_peak", F.expr("greatest(0D, _peak)"))
    broken = _first_break(before, key, f"NOT ({capital!r}D + _sum > ({capital!r}D + _peak) * {1 - drawdown!r}D)")
    return broken.where("NOT _broken").select("symbol", "entry_hour", "exit_hour", "side", "net")


#: Fall from its peak at which an overlaid curve is de-risked, fall above which it is not any more, and the share kept meanwhile.
TRIGGER, REENTRY, FLOOR = -0.15, -0.07, 0.25


def _break(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exposure of each day, from the state of the day before it; rows come sorted by configuration and day."""
    cfg, eq, peak, engaged = None, 1.0, 1.0, False
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            if r.cfg != cfg:
                cfg, eq, peak, engaged = r.cfg, 1.0, 1.0, False
            fall = eq / peak - 1
            engaged = fall < REENTRY if engaged else fall <= TRIGGER
            scalar = r.e_vol * (FLOOR if engaged else 1.0)
            eq *= 1 + scalar * r.r
            peak = max(peak, eq)
            out.append((r.cfg, r.day, scalar, scalar * r.r, engaged, eq))
        yield pd.DataFrame(out, columns=["cfg", "day", "scalar", "overlaid", "engaged", "eq"])


def circuit_breaker(scaled: DataFrame) -> DataFrame:
    """Daily returns (cfg, day, r, e_vol) under the breaker: one state a configuration runs down its days."""
    return scaled.select("cfg", "day", "r", "e_vol").repartition("cfg").sortWithinPartitions("cfg", "day").mapInPandas(_break, "cfg string, day int, scalar double, overlaid double, engaged boolean, eq double")
