"""Readers and writers of bars, trades and symbols of one's own, in any format that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BARS = "symbol string, time long, open double, high double, low double, close double, volume double"
TRADES = "symbol string, time long, price double, volume double, aggressor_side string, id string, sequence long"
SYMBOLS = "symbol string, name string, zone string, tick double, lot double"


def read(spark: SparkSession, path: str, schema: str = BARS, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table under a fixed schema; nothing is inferred."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def stream(spark: SparkSession, path: str, schema: str = BARS, fmt: str = "parquet", **options: str) -> DataFrame:
    """The same as a stream of the files that arrive in a folder."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def write(bars: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", span: int = 86400 * 30) -> None:
    """Bars in folders by stretch of time, sorted by symbol and time within: range filters skip files and row groups."""
    folder = F.floor(F.col("time") / span).cast("long")
    bars.withColumn("span", folder).repartitionByRange("span", "symbol", "time").sortWithinPartitions("span", "symbol", "time").write.mode(mode).partitionBy("span").format(fmt).save(path)


def with_symbol(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows with the columns of their symbol; unknown symbols have nulls."""
    return rows.join(symbols, "symbol", "left")


def faulty(bars: DataFrame) -> DataFrame:
    """Bars that break the rules of a bar, with the reason: prices present and finite, low and high around the others."""
    prices = ("open", "high", "low", "close")
    finite = F.lit(True)
    for c in prices:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    around = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))
    reason = F.when(F.col("symbol").isNull() | F.col("time").isNull(), "no symbol or time").when(~finite, "a price is missing").when(~around, "high and low do not hold the others").when(F.col("volume") < 0, "volume is negative")
    return bars.withColumn("reason", reason).where("reason is not null")
