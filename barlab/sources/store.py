"""Stored bars: a table partitioned by timeframe and symbol that grows by batches of events.

A batch adds partial bars in a folder of its own, with the times of their first and last tick, so a batch that is run
again replaces what it wrote and parts of a bar from several batches combine exactly. Files are sorted by hour and cover
spans of it: a read of some symbols and hours lists their partitions alone and skips row groups by their hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.sources.bars import MICROS

#: Bars a file spans at most.
SPAN = 8192


def _merged() -> list[Column]:
    """Parts of a bar as one."""
    return [F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last").alias("close"), F.sum("volume").alias("volume")]


def add_batch(root: str, batch: int, events: DataFrame, timeframes: tuple[int, ...] = (1, 4, 24), symbol: str = "event_type", price: str = "value") -> None:
    """Adds the bars of a batch's events (event_id, ts, symbol, price), in hours of each timeframe."""
    ticks = events.where(F.col(price) > 0).select(F.col(symbol).cast("string").alias("symbol"), F.expr(MICROS).alias("us"), "event_id", F.col(price).alias("price"))
    when = F.struct("us", "event_id", "price")
    hourly = ticks.groupBy("symbol", F.expr("us div 3600000000").alias("hour")).agg(
        F.min_by("price", when).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", when).alias("close"), F.count("*").cast("double").alias("volume"), F.min(when).alias("first"), F.max(when).alias("last")
    )
    each = hourly.withColumn("tf", F.explode(F.array(*map(F.lit, timeframes)))).withColumn("hour", F.expr("hour div tf * tf"))
    parts = each.groupBy("tf", "symbol", "hour").agg(*_merged(), F.min("first").alias("first"), F.max("last").alias("last")).withColumn("batch", F.lit(batch))
    files = parts.repartition("tf", "symbol", F.expr(f"hour div (tf * {SPAN})")).sortWithinPartitions("tf", "symbol", "hour")
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tf", "symbol", "batch").parquet(root)


def stored_bars(spark: SparkSession, root: str, timeframe: int, symbols: list[str] | None = None, since: int | None = None) -> DataFrame:
    """(symbol, hour, open, high, low, close, volume) of a timeframe, of these symbols and from this hour on."""
    rows = spark.read.parquet(root).where(F.col("tf") == timeframe)
    rows = rows if symbols is None else rows.where(F.col("symbol").isin(symbols))
    rows = rows if since is None else rows.where(F.col("hour") >= since)
    return rows.groupBy(F.col("symbol").cast("string").alias("symbol"), "hour").agg(*_merged())


def newest(spark: SparkSession, root: str, timeframe: int) -> DataFrame:
    """(symbol, hour): the newest stored bar of each symbol."""
    return spark.read.parquet(root).where(F.col("tf") == timeframe).groupBy(F.col("symbol").cast("string").alias("symbol")).agg(F.max("hour").alias("hour"))


def order_book(orders: DataFrame, by: str, depth: int = 20) -> DataFrame:
    """(by, bids, asks) from (by, is_bid, price, size): the best `depth` prices of each side, best first, as arrays of (price, size).

    Sizes of a price are added first; each task passes on `depth` prices a book and side at most. A side without orders
    is an empty array.
    """
    levels = orders.groupBy(by, "is_bid", "price").agg(F.sum("size").alias("size")).withColumn("_best", F.when(F.col("is_bid"), -F.col("price")).otherwise(F.col("price")))
    best = levels.withColumn("_n", F.row_number().over(Window.partitionBy(by, "is_bid").orderBy("_best"))).where(F.col("_n") <= depth)
    level = F.struct("_n", F.struct("price", "size").alias("l"))
    sides = best.groupBy(by).agg(*(F.transform(F.sort_array(F.collect_list(F.when(c, level))), lambda x: x.l).alias(out) for c, out in ((F.col("is_bid"), "bids"), (~F.col("is_bid"), "asks"))))
    return sides


def book_summary(books: DataFrame, by: str) -> DataFrame:
    """(by, bid_volume, ask_volume, spread_bps): volumes of the kept levels, and the spread of the best prices where both sides have one."""
    volume = "aggregate({}, 0D, (a, x) -> a + x.size)"
    spread = "CASE WHEN size(bids) > 0 AND size(asks) > 0 THEN 1e4 * (asks[0].price - bids[0].price) / nullif(bids[0].price, 0) END"
    return books.selectExpr(by, f"{volume.format('bids')} AS bid_volume", f"{volume.format('asks')} AS ask_volume", f"{spread} AS spread_bps")
