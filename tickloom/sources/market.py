"""Market views over the driver's tables, and readers for bars of one's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.resample import ohlcv_from_trades

BAR_SECONDS = 21600


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, time (whole seconds, UTC), micros, price, volume, aggressor_side, id of the events table.

    Volume and side are rules of ours: 1 + event_id modulo 10, and buy for even ids.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.col("event_type").alias("symbol"),
        F.floor(micros / 1_000_000).alias("time"),
        micros.alias("micros"),
        F.round("value", 2).alias("price"),
        (1 + F.col("event_id") % 10).cast("double").alias("volume"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("aggressor_side"),
        F.col("event_id").alias("id"),
    )


def bars(spark: SparkSession, sf_dir: str, seconds: int = BAR_SECONDS) -> DataFrame:
    return ohlcv_from_trades(ticks(spark, sf_dir), seconds)


TICKS_SQL = """
SELECT event_type AS symbol, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS time, epoch_us(ts) AS micros, round(value, 2) AS price,
       CAST(1 + event_id % 10 AS DOUBLE) AS volume, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS aggressor_side, event_id AS id
FROM events"""


def bars_sql(seconds: int = BAR_SECONDS) -> str:
    return f"""
SELECT symbol, min(time) AS time, arg_min(price, (micros, id)) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, (micros, id)) AS close, sum(volume) AS volume
FROM ({TICKS_SQL}) GROUP BY symbol, CAST(floor(time / {seconds}) AS BIGINT)"""
