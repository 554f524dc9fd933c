"""Comparing and navigating series: rebasing, alignment, as-of joins, overviews, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.calendar import projected
from tickloom.functions.scalars import valid
from tickloom.operators.stretches import SPAN, bucketed, numbered


def relative(bars: DataFrame, value: Column, kind: str = "percentage", start: int | None = None, end: int | None = None) -> DataFrame:
    """symbol, time, base, relative: each value against the first positive one in the range, else of all."""
    rows = bars.select("symbol", "time", value.cast("double").alias("value"))
    good = F.when(valid(F.col("value")) & (F.col("value") > 0), F.col("value"))
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("time") >= start)
    if end is not None:
        inside = inside & (F.col("time") <= end)
    marks = rows.where(good.isNotNull())
    base = marks.groupBy("symbol").agg(F.coalesce(F.min_by("value", F.when(inside, F.col("time"))), F.min_by("value", "time")).alias("base"))
    share = F.col("value") / F.nullif(F.col("base"), F.lit(0.0))
    return rows.join(base, "symbol", "left").select("symbol", "time", "base", ((share - 1) * 100 if kind == "percentage" else share * 100).alias("relative"))


def aligned(series: dict[str, DataFrame]) -> DataFrame:
    """time and one column for each named series (time, value); times of any of them, gaps null."""
    long = None
    for name, df in series.items():
        part = df.select("time", F.lit(name).alias("name"), F.col("value").cast("double").alias("value"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy("time").pivot("name", list(series)).agg(F.max("value"))


def aligned_on_sessions(series: dict[str, DataFrame], table: DataFrame, kinds: tuple[str, ...] = ("regular",)) -> DataFrame:
    """trading_time and one column for each named series (time, value): all of them on the calendar of one, given by its sessions.

    The seconds that these sessions have been open are the common clock, so hours in which the others trade and this one does
    not take no room: what they have there stands where its next session opens. Of several samples of one series that
    come to stand in one place the latest counts (of equal times the greatest). What comes after the last session has no place and is left out.
    """
    long = None
    for name, df in series.items():
        part = df.select("time", F.lit(name).alias("name"), F.col("value").cast("double").alias("value"))
        long = part if long is None else long.unionByName(part)
    placed = projected(long, table, kinds).where("trading_time is not null")
    return placed.groupBy("trading_time").pivot("name", list(series)).agg(F.max_by("value", F.struct("time", "value")))


def exact(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows with the right row of the same symbol and time, else nulls."""
    return left.join(right, ["symbol", "time"], "left")


def as_of(left: DataFrame, right: DataFrame, value: str, how: str = "nearest", long: DataFrame | None = None) -> DataFrame:
    """Left rows (symbol, time) with the right value at the nearest time (ties: the earlier), or the last at or
    before (`left`), or the first at or after (`right`). Of right rows with one time, the largest value counts looking back and
    the smallest looking ahead. Both sides are sorted by symbol and time, forwards and back; no pairs.

    `long` (`stretches.long_symbols` of both sides' rows) spreads its symbols over buckets of their times: each bucket is sorted
    on its own, and what lies before and after it comes from the first and last marks of the other buckets.
    """
    mark = F.struct(F.col("time").alias("t"), F.col(value).alias("v"))
    both = left.withColumn("_mark", F.lit(None).cast(right.select(mark).schema[0].dataType)).withColumn("_left", F.lit(True)).unionByName(right.select("symbol", "time", mark.alias("_mark"), F.lit(False).alias("_left")), allowMissingColumns=True)
    keys = ["symbol"] if long is None else ["symbol", "_bucket"]
    both = both if long is None else bucketed(both, long)
    # the way back is a second sort: a frame that ends with the partition would be gone through anew for every row
    so_far = lambda order: Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    rows = both.select("*", F.max("_mark").over(so_far(F.col("time"))).alias("_b"), F.min("_mark").over(so_far(F.desc("time"))).alias("_a")).where("_left")
    if long is not None:
        ends = both.where("_long").groupBy(*keys).agg(F.max("_mark").alias("_last"), F.min("_mark").alias("_first"))
        others = lambda order: Window.partitionBy("symbol").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, F.max("_last").over(others(F.col("_bucket"))).alias("_back"), F.min("_first").over(others(F.desc("_bucket"))).alias("_ahead"))
        rows = rows.join(ends, keys, "left").withColumn("_b", F.coalesce("_b", "_back")).withColumn("_a", F.coalesce("_a", "_ahead"))
    near = F.when(F.col("_a").isNull() | (F.col("time") - F.col("_b.t") <= F.col("_a.t") - F.col("time")), F.col("_b")).otherwise(F.col("_a"))
    chosen = {"nearest": near, "left": F.col("_b"), "right": F.col("_a")}[how]
    return rows.select(*left.columns, chosen["t"].alias("matched_time"), chosen["v"].alias(value))


def _indexed(bars: DataFrame, long: DataFrame | None) -> DataFrame:
    """bars with `_i`, the number of the row in its symbol from 0, and `_n`, how many the symbol has."""
    if long is None:
        w = Window.partitionBy("symbol")
        return bars.withColumn("_i", F.row_number().over(w.orderBy("time")) - 1).withColumn("_n", F.count("*").over(w))
    counts = bars.groupBy(F.col("symbol").alias("_s")).agg(F.count("*").alias("_n"))
    rows = numbered(bars, long, SPAN).withColumnRenamed("i", "_i").drop("_part", "_long")
    return rows.join(counts, F.col("symbol").eqNullSafe(F.col("_s")), "left").drop("_s")


def at_index(bars: DataFrame, index: int, how: str | None = None, long: DataFrame | None = None) -> DataFrame:
    """The row with this index of each symbol; outside the series none, or the first/last with how=right/left."""
    want = F.lit(index)
    if how == "left":
        want = F.least(want, F.col("_n") - 1)
    elif how == "right":
        want = F.greatest(want, F.lit(0))
    return _indexed(bars, long).where(F.col("_i") == want).drop("_i", "_n")


def visible(bars: DataFrame, start: int, end: int, padding: int = 0, long: DataFrame | None = None) -> DataFrame:
    """Bars of start..end and `padding` neighbours on either side; of a range without bars, those around the place it would have."""
    if end < start:
        return bars.limit(0)
    if not padding:
        return bars.where(F.col("time").between(start, end))
    at = counts_around(bars, start, end).select(F.col("symbol").alias("_s"), F.col("before").alias("_from"), (F.col("before") + F.col("inside")).alias("_to"))
    rows = _indexed(bars, long).join(at, F.col("symbol").eqNullSafe(F.col("_s")))
    return rows.where((F.col("_i") >= F.col("_from") - padding) & (F.col("_i") < F.col("_to") + padding)).select(*bars.columns)


def counts_around(bars: DataFrame, start: int, end: int) -> DataFrame:
    """Bars before, in and after the range, by symbol."""
    return bars.groupBy("symbol").agg(F.count_if(F.col("time") < start).alias("before"), F.count_if(F.col("time").between(start, end)).alias("inside"), F.count_if(F.col("time") > end).alias("after"))


def overview(bars: DataFrame, value: Column, most: int = 600, long: DataFrame | None = None) -> DataFrame:
    """At most `most` points a symbol: open, high, low, close and count of runs of ceil(n / most) rows."""
    rows = _indexed(bars.select("symbol", "time", value.cast("double").alias("v")), long).withColumn("_size", F.ceil(F.col("_n") / most))
    known = F.when(valid(F.col("v")), F.col("v"))
    order = F.when(known.isNotNull(), F.col("time"))
    return (
        rows.groupBy("symbol", F.floor(F.col("_i") / F.col("_size")).alias("bucket"))
        .agg(F.min("time").alias("time"), F.min_by("v", order).alias("open"), F.max(known).alias("high"), F.min(known).alias("low"), F.max_by("v", order).alias("close"), F.count(known).alias("n"))
        .where("n > 0")
    )


def upserted(old: DataFrame, new: DataFrame, version: str = "version") -> DataFrame:
    """Both tables' rows, of each symbol and time the one with the highest version."""
    both = old.unionByName(new)
    cols = [c for c in both.columns if c not in ("symbol", "time")]
    return both.groupBy("symbol", "time").agg(F.max_by(F.struct(*cols), version).alias("row")).select("symbol", "time", "row.*").select(*old.columns)


def popped(bars: DataFrame, n: int, long: DataFrame | None = None) -> DataFrame:
    """Bars without the last n of each symbol."""
    return _indexed(bars, long).where(F.col("_n") - F.col("_i") > n).drop("_i", "_n")


def nearest_value(values: list[Column], at: Column) -> Column:
    """The one of a row's values that is nearest to `at`; of equally near ones the first given, null where all are."""
    marks = [F.when(valid(v), F.struct(F.abs(v - at).alias("gap"), F.lit(k).alias("k"), v.cast("double").alias("v"))) for k, v in enumerate(values)]
    return F.array_min(F.filter(F.array(*marks), lambda m: m.isNotNull()))["v"]
