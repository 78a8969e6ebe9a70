"""Bars and panels from the event and line item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))"
#: DuckDB's epoch_ms: rounded, halves away from zero.
MILLIS = f"round({MICROS}, -3) div 1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_bars(ticks: DataFrame, hours: int = 1, symbol: str = "event_type", price: str = "value", order: str = "event_id") -> DataFrame:
    """(symbol, hour, open, high, low, close, volume): bars of `hours` hours; hour counts from 1970. Prices of 0 or less are no ticks; equal times are ordered by `order`, then by the price."""
    ticks = ticks.where(F.col(price) > 0).withColumn("us", F.expr(MICROS))
    when = F.struct("us", order, price)
    return ticks.groupBy(F.col(symbol).cast("string").alias("symbol"), F.expr(f"us div {3_600_000_000 * hours} * {hours}").alias("hour")).agg(
        F.min_by(price, when).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, when).alias("close"), F.count("*").cast("double").alias("volume")
    )


def bars(spark: SparkSession, sf_dir: str, hours: int = 1, symbol: str = "event_type") -> DataFrame:
    return build_bars(table(spark, sf_dir, "events").select("event_id", "ts", symbol, "value"), hours, symbol)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, day, open, close): the first and last price of each asset and day; days count from 1970."""
    t = table(spark, sf_dir, "lineitem").select(
        F.expr("l_suppkey % 10").alias("asset"), F.expr("datediff(cast(l_shipdate AS date), date'1970-01-01')").alias("day"),
        F.expr("l_extendedprice / l_quantity").alias("price"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("ord"),
    )
    return t.groupBy("asset", "day").agg(F.min_by("price", "ord").alias("open"), F.max_by("price", "ord").alias("close"))


def bars_sql(hours: int = 1, symbol: str = "event_type") -> str:
    """Hours from microseconds, as in Spark: DuckDB's epoch_ms rounds, which puts the last half millisecond of an hour into the next. No order of ticks is left to chance."""
    return f"""SELECT {symbol}::VARCHAR AS symbol, (epoch_us(ts) // {3_600_000_000 * hours}) * {hours} AS hour, first(value ORDER BY ts, event_id, value) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id, value) AS close, count(*)::DOUBLE AS volume FROM events WHERE value > 0 GROUP BY ALL"""


_ORD = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"
PANEL_SQL = f"""SELECT l_suppkey % 10 AS asset, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS day, first(l_extendedprice / l_quantity ORDER BY {_ORD}) AS open,
    last(l_extendedprice / l_quantity ORDER BY {_ORD}) AS close FROM lineitem GROUP BY ALL"""
