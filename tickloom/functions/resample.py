"""Resampling and normalising bars and trades."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def resolution_seconds(text: str) -> int:
    """Seconds of a resolution such as 5, 30s, 4h, 1D: a bare number is minutes, a capital M is not understood."""
    m = re.fullmatch(r"(\d+)([smhdwSHDW]?)", text.strip())
    if not m or int(m[1]) == 0:
        raise ValueError(f"not a resolution: {text!r}")
    return int(m[1]) * UNITS[(m[2] or "m").lower()]


def bucket(seconds: int, origin: int = 0):
    return F.floor((F.col("time") - F.lit(origin)) / F.lit(seconds)).cast("long")


def ohlcv_from_trades(trades: DataFrame, seconds: int, origin: int = 0) -> DataFrame:
    """Bars of symbol, time, price, volume, micros, id; a bar's time is its first trade's."""
    order = F.struct("micros", "id")
    return (
        trades.groupBy("symbol", bucket(seconds, origin).alias("bucket"))
        .agg(F.min("time").alias("time"), F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
        .drop("bucket")
    )


def resample(bars: DataFrame, seconds: int, origin: int = 0) -> DataFrame:
    """Coarser bars. A bar's time is its first member's; volume is null only if no member has one; empty buckets are absent."""
    return (
        bars.groupBy("symbol", bucket(seconds, origin).alias("bucket"))
        .agg(F.min("time").alias("time"), F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"))
        .drop("bucket")
    )


def keep_last(bars: DataFrame, sequence: str) -> DataFrame:
    """One bar for each symbol and time, the one that came last in `sequence`."""
    cols = [c for c in bars.columns if c not in ("symbol", "time")]
    last = F.max_by(F.struct(*cols), sequence).alias("row")
    return bars.groupBy("symbol", "time").agg(last).select("symbol", "time", "row.*")


def out_of_order(bars: DataFrame, sequence: str) -> DataFrame:
    """Bars whose time is before that of the bar received just before, which a strict reader refuses."""
    before = F.lag("time").over(Window.partitionBy("symbol").orderBy(sequence))
    return bars.withColumn("before", before).where("time < before")


def page(bars: DataFrame, start: int | None = None, end: int | None = None, count_back: int | None = None) -> DataFrame:
    """Bars with start <= time <= end; of those the last `count_back` of each symbol."""
    if start is not None:
        bars = bars.where(F.col("time") >= start)
    if end is not None:
        bars = bars.where(F.col("time") <= end)
    if count_back is None:
        return bars
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("time")))
    return bars.withColumn("_rank", rank).where(F.col("_rank") <= count_back).drop("_rank")
