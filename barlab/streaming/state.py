"""Jobs that run on: scores that grow by batches, a risk gate with state, profiles that decay.

Each takes a stream; the named queries read the files of the events table as one, some files a batch, until what is there
has been read. Results and progress are in the shared folder. A batch writes its own part under its number, and writes the
same part again if it is run again, so a restart counts nothing twice; results do not depend on how rows fall into batches.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barlab.sources.shared import shared_folder

FILES_A_BATCH = 64


def event_stream(spark: SparkSession, sf_dir: str, files: int = FILES_A_BATCH) -> DataFrame:
    """The events table as a stream of its own files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as a stream takes a plain path for a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/events.parque[t]").selectExpr("event_id", "event_type", "value", "cast(ts AS timestamp_ntz) AS ts")


def _run(stream: DataFrame, at: str, each) -> None:
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()


def sums_of_batches(stream: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """(keys, n, s, ss) of a stream's x: what count, mean and spread follow from; every batch adds its sums once, under its number."""

    def each(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss")).write.mode("overwrite").parquet(f"{at}/sums/batch={number}")

    _run(stream, at, each)
    return stream.sparkSession.read.parquet(f"{at}/sums").groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))


def forward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol, the score of all values so far."""
    at = f"{shared_folder(spark)}/forward-{uuid.uuid4().hex}"
    sums = sums_of_batches(event_stream(spark, sf_dir).selectExpr("event_type AS symbol", "(value - 50) / 100 AS x"), at, ["symbol"])
    return sums.selectExpr("symbol", "n", "round(s / n, 8) AS mean", "round((s / n) / nullif(sqrt((ss - s * s / n) / (n - 1)), 0) * sqrt(n), 5) AS tstat")


FORWARD_SQL = "SELECT event_type AS symbol, count(*) AS n, round(avg((value - 50) / 100), 8) AS mean, round(avg((value - 50) / 100) / nullif(stddev_samp((value - 50) / 100), 0) * sqrt(count(*)), 5) AS tstat FROM events GROUP BY event_type"

#: Capital, drawdown that stops a symbol for good and loss of a day that stops it until midnight, in percent; hours that events may be late.
CAPITAL, BREAKER, DAILY, DELAY_HOURS = 1000.0, 20.0, 3.0, 2
_HOUR = 3_600_000
#: Rows of a batch that Python holds before they wait in the state, and how one is packed.
WAITING_ROWS = 1 << 17
_PACKED, _ROW = "<qqd", np.dtype([("ms", "<i8"), ("event_id", "<i8"), ("pnl", "<f8")])
_STATE = "equity double, peak double, day long, lost double, broken boolean, taken long, refused long"


def risk_gate() -> StatefulProcessor:
    """The processor, of a class that is sent by value, as the process that drives a state's timers imports no package of ours."""

    class RiskGate(StatefulProcessor):
        """Takes a symbol's results in order of time: rows wait until the watermark has passed their hour, then go through the gate.

        The gate's state is one value of seven numbers; a timer stands at the end of the earliest hour that waits. Rows later
        than the watermark never arrive here. Rows wait by hour, packed, and hours go through one at a time, so what Python
        holds is WAITING_ROWS of a batch, or one hour.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.gate = handle.getValueState("gate", _STATE)
            self.parts = handle.getValueState("parts", "n long")
            self.waiting = handle.getMapState("waiting", "hour long, part long", "packed binary")

        def _timer(self, hour: int) -> None:
            self.handle.registerTimer((hour + 1) * _HOUR)

        def _wait(self, held: dict[int, bytearray]) -> None:
            part = self.parts.get()[0] if self.parts.exists() else 0
            for hour, packed in held.items():
                self.waiting.updateValue((hour, part), (bytes(packed),))
            self.parts.update((part + 1,))
            self._timer(min(held))

        def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
            held: dict[int, bytearray] = {}
            n = 0
            for r in rows:
                held.setdefault(r.ms // _HOUR, bytearray()).extend(struct.pack(_PACKED, r.ms, r.event_id, r.pnl))
                n += 1
                if n == WAITING_ROWS:
                    self._wait(held)
                    held, n = {}, 0
            if held:
                self._wait(held)
            return iter(())

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
            until = timerValues.getCurrentWatermarkInMs() // _HOUR
            parts: dict[int, list[int]] = {}
            for hour, part in self.waiting.keys():
                parts.setdefault(hour, []).append(part)
            rest = [h for h in parts if h >= until]
            if rest:
                self._timer(min(rest))
            due = sorted(h for h in parts if h < until)
            if not due:
                return
            equity, peak, day, lost, broken, taken, refused = self.gate.get() if self.gate.exists() else (CAPITAL, CAPITAL, -1, 0.0, False, 0, 0)
            for hour in due:
                rows = np.concatenate([np.frombuffer(self.waiting.getValue((hour, part))[0], _ROW) for part in parts[hour]])
                rows = rows[np.lexsort((rows["pnl"], rows["event_id"], rows["ms"]))]
                if hour // 24 > day:
                    day, lost = hour // 24, 0.0
                for at in range(0, len(rows), WAITING_ROWS):
                    for pnl in rows["pnl"][at : at + WAITING_ROWS].tolist():
                        broken = broken or (peak - equity) / peak * 100 >= BREAKER
                        if broken or (lost < 0 and -lost / equity * 100 >= DAILY):
                            refused += 1
                            continue
                        equity, lost, taken = equity + pnl, lost + pnl, taken + 1
                        peak = max(peak, equity)
                for part in parts[hour]:
                    self.waiting.removeKey((hour, part))
            self.gate.update((equity, peak, day, lost, broken, taken, refused))
            yield Row(symbol=key[0], equity=equity, broken=broken, taken=taken, refused=refused)

        def close(self) -> None:
            pass

    return RiskGate()


GATE_OUT = "symbol string, equity double, broken boolean, taken long, refused long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def risk_gate_stream(stream: DataFrame, delay_hours: int = DELAY_HOURS) -> DataFrame:
    """Whenever hours of a symbol have passed, its equity and how many of its results so far the gate took and refused."""
    rows = stream.selectExpr("event_type AS symbol", "event_id", "cast(ts AS timestamp) AS at", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000 AS ms", "(value - 50) / 10 AS pnl").withWatermark("at", f"{delay_hours} hours")
    return rows.groupBy("symbol").transformWithState(risk_gate(), GATE_OUT, "Append", "EventTime")


def run_risk_gate(stream: DataFrame, at: str) -> None:
    """Runs the gate over what is there; rows and progress go to `at`, and a later run goes on from there."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # the one that keeps several values a key, and timers
    try:
        out = risk_gate_stream(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/progress").outputMode("append").trigger(availableNow=True).start()
        out.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def latest_of_gate(spark: SparkSession, at: str) -> DataFrame:
    done = spark.read.schema(GATE_OUT).parquet(f"{at}/out")
    return done.groupBy("symbol").agg(F.max_by(F.struct("equity", "broken", "taken", "refused"), F.col("taken") + F.col("refused")).alias("x")).selectExpr("symbol", "round(x.equity, 5) AS equity", "x.broken", "x.taken", "x.refused")


def risk_gate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_folder(spark)}/gate-{uuid.uuid4().hex}"
    run_risk_gate(event_stream(spark, sf_dir), at)
    return latest_of_gate(spark, at)


_NEW_DAY = "CASE WHEN e.ms // 86400000 > s.day THEN 0::DOUBLE ELSE s.lost END"
_STOPPED = f"(s.broken OR (s.peak - s.equity) / s.peak * 100 >= {BREAKER})"
_REFUSED = f"({_STOPPED} OR (({_NEW_DAY}) < 0 AND -({_NEW_DAY}) / s.equity * 100 >= {DAILY}))"
GATE_SQL = f"""WITH RECURSIVE e AS (SELECT event_type AS symbol, epoch_ms(ts) AS ms, (value - 50) / 10 AS pnl, row_number() OVER (PARTITION BY event_type ORDER BY epoch_ms(ts), event_id) AS k FROM events WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) - {DELAY_HOURS} * 3600000 FROM events) // 3600000 * 3600000),
  s(symbol, k, equity, peak, day, lost, broken, taken, refused) AS (SELECT DISTINCT symbol, 0::BIGINT, {CAPITAL}::DOUBLE, {CAPITAL}::DOUBLE, -1::BIGINT, 0::DOUBLE, false, 0::BIGINT, 0::BIGINT FROM e
    UNION ALL SELECT e.symbol, e.k, CASE WHEN {_REFUSED} THEN s.equity ELSE s.equity + e.pnl END, CASE WHEN {_REFUSED} THEN s.peak ELSE greatest(s.peak, s.equity + e.pnl) END, greatest(s.day, e.ms // 86400000), ({_NEW_DAY}) + CASE WHEN {_REFUSED} THEN 0 ELSE e.pnl END, {_STOPPED},
      s.taken + CASE WHEN {_REFUSED} THEN 0 ELSE 1 END, s.refused + CASE WHEN {_REFUSED} THEN 1 ELSE 0 END FROM s JOIN e ON e.symbol = s.symbol AND e.k = s.k + 1)
  SELECT symbol, round(equity, 5) AS equity, broken, taken, refused FROM (SELECT *, max(k) OVER (PARTITION BY symbol) AS last FROM s) WHERE k = last"""

OLD, NEW, LEAST = 0.85, 0.15, 3


def decayed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per symbol, mean and spread of its first day, blended with those of each later day in turn; a day of fewer than LEAST values changes nothing.

    Batches add to the sums of days; days of a symbol are folded in order, a row each.
    """
    at = f"{shared_folder(spark)}/profiles-{uuid.uuid4().hex}"
    days = sums_of_batches(event_stream(spark, sf_dir).selectExpr("event_type AS symbol", "datediff(cast(ts AS date), date'1970-01-01') AS day", "value AS x"), at, ["symbol", "day"])
    days = days.selectExpr("symbol", "n", "struct(day, n, s / n AS mean, sqrt(greatest(ss / n - (s / n) * (s / n), 0)) AS sd) AS d")
    blend = ", ".join(f"{OLD}D * a.{c} + {NEW}D * x.{c} AS {c}" for c in ("mean", "sd"))
    folded = days.groupBy("symbol").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("d")).alias("d")).selectExpr("symbol", "n", f"aggregate(slice(d, 2, size(d)), struct(d[0].mean AS mean, d[0].sd AS sd), (a, x) -> if(x.n < {LEAST}, a, struct({blend}))) AS p")
    return folded.selectExpr("symbol", "n", "round(p.mean, 6) AS mean", "round(p.sd, 6) AS sd")


_FOLDED = f"list_reduce(list({{'n': n, 'v': %s}} ORDER BY day), lambda a, x: CASE WHEN x.n < {LEAST} THEN a ELSE {{'n': x.n, 'v': {OLD}::DOUBLE * a.v + {NEW}::DOUBLE * x.v}} END).v"
PROFILE_SQL = f"""WITH q AS (SELECT event_type AS symbol, ts::DATE AS day, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM events GROUP BY ALL)
  SELECT symbol, sum(n)::BIGINT AS n, round({_FOLDED % 'mean'}, 6) AS mean, round({_FOLDED % 'sd'}, 6) AS sd FROM q GROUP BY symbol"""
