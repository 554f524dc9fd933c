"""Live series on Structured Streaming: bars, footprints, stateful studies, upserts and corrections."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.calendar import KINDS, with_session
from tickloom.operators.compare import upserted
from tickloom.operators.derived import figure_steps, renko_steps
from tickloom.operators.folds import Average, Machine
from tickloom.operators.orderflow import tick_of
from tickloom.ship import ship


def live_bars(trades: DataFrame, interval: str, lateness: str = "1 minute", offset: str = "0 seconds") -> DataFrame:
    """Bars of a stream of trades (symbol, ts, price, volume, id): fixed buckets with an origin.

    Trades later than the watermark are dropped. In update mode the open bar is revised as trades come, in
    append mode a bar is given once, when the watermark has passed its end. Order within a bar is (ts, id).
    """
    order = F.struct("ts", "id")
    return (
        trades.withWatermark("ts", lateness)
        .groupBy(F.window("ts", interval, interval, offset), "symbol")
        .agg(F.min("ts").alias("time"), F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", F.col("window.start").alias("start"), "time", "open", "high", "low", "close", "volume")
    )


def live_session_bars(trades: DataFrame, table: DataFrame, kinds: tuple[str, ...] = KINDS, lateness: str = "1 minute") -> DataFrame:
    """Bars of whole trading sessions (`calendar.sessions`) of trades (symbol, ts, price, volume, id), a stream or a table.

    A trade opens a window that ends when its session closes, and windows of one session merge; in append mode a bar is given
    once, when the watermark has passed the close, and trades that come later still are dropped. Trades outside every
    session have no part in any bar. Opens and closes are the table's, so sessions of a zone follow its clock changes.
    """
    order = F.struct("ts", "id")
    timed = trades.withWatermark("ts", lateness).select("symbol", "ts", "price", "volume", "id", F.unix_seconds("ts").alias("time"))
    placed = with_session(timed, table, kinds).where("session is not null")
    left = F.concat((F.col("session_close") * 1_000_000 - F.unix_micros("ts")).cast("string"), F.lit(" microseconds"))
    return (
        placed.groupBy(F.session_window("ts", left).alias("window"), "symbol", "session", "kind", "session_open", "session_close")
        .agg(F.min("time").alias("time"), F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("trade_count"))
        .drop("window")
    )


def live_footprint(trades: DataFrame, interval: str, size: float, lateness: str = "1 minute") -> DataFrame:
    """Bid and ask volume by bar and tick. A trade id that comes again within the watermark counts once."""
    side = lambda s: F.sum(F.when(F.col("aggressor_side") == s, F.col("volume")).otherwise(0.0))
    return (
        trades.withWatermark("ts", lateness)
        .dropDuplicatesWithinWatermark(["symbol", "id"])
        .groupBy(F.window("ts", interval), "symbol", tick_of("price", size).alias("tick"))
        .agg(side("sell").alias("bid_volume"), side("buy").alias("ask_volume"), F.count("*").alias("trade_count"))
        .select("symbol", F.col("window.start").alias("start"), "tick", "bid_volume", "ask_volume", "trade_count")
    )


def live_study(bars: DataFrame, study: Machine | Average) -> DataFrame:
    """A stateful study over a stream of bars (symbol, time, its inputs): symbol, time, outputs, final.

    The latest bar of a symbol is a preview: another bar with its time replaces it and leaves the state
    alone; a later bar makes it final. A bar older than that is ignored. Rows of a micro-batch come in no order: of two with
    one time the higher `version` counts, where the bars have that column. The state is what the batch
    machine keeps, so stream and batch agree. For whole plans see `studies.LiveStudy`.
    """
    machine = study.machine() if isinstance(study, Average) else study
    outs = ", ".join(f"{k} {v}" for k, v in machine.outs.items())
    ship(bars.sparkSession)

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, pending = (json.loads(state.get[0]), json.loads(state.get[1])) if state.exists else ({}, None)
        rows: dict[int, tuple] = {}

        def emit(bar: list, kept: dict, final: bool) -> None:
            made = machine.advance(kept, *bar[1:], **machine.params)
            rows[bar[0]] = (key[0], bar[0], *(made or (None,) * len(machine.outs)), final)

        rows_ = pd.concat(list(parts))
        for bar in rows_.sort_values([c for c in ("time", "version") if c in rows_], kind="stable").itertuples():
            now = [int(bar.time), *(None if pd.isna(getattr(bar, c)) else float(getattr(bar, c)) for c in machine.reads)]
            if pending and now[0] < pending[0]:
                continue
            if pending and now[0] > pending[0]:
                emit(pending, done, True)
            pending = now
        if pending:
            emit(pending, json.loads(json.dumps(done)), False)
        state.update((json.dumps(done), json.dumps(pending)))
        yield pd.DataFrame(list(rows.values()), columns=["symbol", "time", *machine.outs, "final"])

    return bars.groupBy("symbol").applyInPandasWithState(advance, f"symbol string, time long, {outs}, final boolean", "done string, pending string", "update", GroupStateTimeout.NoTimeout)


def live_renko(bars: DataFrame, box: float) -> DataFrame:
    """What each bar of a stream moves a Renko chart of this box; the latest is a preview, as in `live_study`.

    Keep the rows by `into_steps` and read the bricks of all bars so far with `derived.renko_of(held(spark, folder), box)`.
    """
    return live_study(bars.withColumn("box", F.lit(float(box))), renko_steps())


def live_figure(bars: DataFrame, box: float, reversal: float = 2.0) -> DataFrame:
    """The same for the columns of a Point and Figure chart, which `derived.figure_of` draws."""
    return live_study(bars.withColumn("box", F.lit(float(box))), figure_steps(reversal))


def into_steps(folder: str, seconds: int = 86400):
    """A foreachBatch function that keeps, of every bar, what the latest micro-batch says: a preview gives way to its revision."""
    put = upsert_into(folder, seconds)
    return lambda batch, number: put(batch.withColumn("version", F.lit(number).cast("long")), number)


def folder_of(symbol: str) -> Column:
    """The partition of a symbol; null and empty ones, which Spark would put into one default folder and read back as null, have a name."""
    return F.when(F.col(symbol).isNull(), "(null)").when(F.col(symbol) == "", "(empty)").otherwise(F.col(symbol))


def upsert_into(folder: str, seconds: int = 86400):
    """A foreachBatch function that keeps the newest version of each (symbol, time) under `folder`.

    The table is partitioned by symbol and stretch of `seconds`, and a batch rewrites only the partitions it touches.
    These are merged aside first and then put in place; the newest version wins however often a batch is run, so a
    retry changes nothing, and a new checkpoint goes on with the table as it is.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = [folder_of("symbol").alias("_symbol"), F.floor(F.col("time") / seconds).alias("_stretch")]
        fresh = upserted(batch.limit(0), batch).select("*", *part)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/table")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            touched = fresh.select("_symbol", "_stretch").distinct()
            held = spark.read.parquet(str(path)).join(touched, ["_symbol", "_stretch"], "left_semi").select(*batch.columns)
            fresh = upserted(held, batch.select(*held.columns)).select("*", *part)
        fresh.write.mode("overwrite").parquet(f"{folder}/aside")
        merged = spark.read.parquet(f"{folder}/aside")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_symbol", "_stretch").parquet(str(path))

    return run


def held(spark: SparkSession, folder: str) -> DataFrame:
    """The table that `upsert_into` keeps."""
    return spark.read.parquet(f"{folder}/table").drop("_symbol", "_stretch")


def corrected(history: DataFrame, corrections: DataFrame, study, version: str = "version") -> DataFrame:
    """Study rows that a correction of past bars changes: of the symbols concerned, from the first corrected time on.

    `study` maps bars to rows with symbol and time. Recursive studies read the symbol's history from its
    start, so the result is what a full recomputation gives.
    """
    since = corrections.groupBy("symbol").agg(F.min("time").alias("_since"))
    bars = upserted(history, corrections, version).join(since.select("symbol"), "symbol", "left_semi")
    return study(bars).join(since, "symbol").where("time >= _since").drop("_since")
