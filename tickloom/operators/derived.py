"""Bars that follow price instead of time: Heikin-Ashi, Renko, Point and Figure."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.folds import Linear, Machine, fold
from tickloom.operators.indicators import Plan
from tickloom.operators.windows import lag
from tickloom.plans.run import clean

HEIKIN_ASHI = Plan(
    [
        {"hc": "(open + high + low + close) / 4", "half": "CASE WHEN i = 0 THEN 0.0 ELSE 0.5 END"},
        {"past": f"CASE WHEN i = 0 THEN (open + close) / 2 ELSE {lag('hc')} / 2 END"},
        [Linear("ho", "half", "past")],
        {"ha_high": "greatest(high, ho, hc)", "ha_low": "least(low, ho, hc)"},
    ],
    {"ha_open": "ho", "ha_high": "ha_high", "ha_low": "ha_low", "ha_close": "hc"},
)


def _boxed(bars: DataFrame, box: float | None, high: str, low: str, parts: int) -> DataFrame:
    """Bars with the box size of their symbol and the ends of its time span."""
    span = F.max(high) - F.min(low)
    size = F.lit(float(box)) if box and box > 0 else F.when(span > 0, span).otherwise(1.0) / parts
    ends = bars.groupBy("symbol").agg(size.alias("box"), F.min("time").alias("first"), F.max("time").alias("last"))
    return clean(bars).where("close is not null").join(ends, "symbol")


def _spread(rows: DataFrame, order: list[str]) -> DataFrame:
    """Times of derived bars: evenly over the source's span, or one second apart where there is one bar."""
    w = Window.partitionBy("symbol").orderBy(*order)
    k, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy("symbol"))
    even = F.col("first") + k / F.greatest(n - 1, F.lit(1)) * (F.col("last") - F.col("first"))
    return rows.withColumn("time", F.when((n == 1) | (F.col("last") <= F.col("first")), (F.col("first") + k).cast("double")).otherwise(even))


def _bricks(s: dict, close: float | None, box: float | None) -> tuple | None:
    """How many whole boxes the base has moved before and after this close."""
    if close is None or not box:
        return None
    if "base" not in s:
        s.update(base=close, first=close, at=0)
        return None
    before = s["at"]
    while close >= s["base"] + box:
        s["base"] += box
        s["at"] += 1
    while close <= s["base"] - box:
        s["base"] -= box
        s["at"] -= 1
    return (float(before), float(s["at"]), s["first"]) if s["at"] != before else None


def renko_steps() -> Machine:
    """What each bar (close, box) moves a Renko chart, in whole boxes before and after it; null where it moves none."""
    return Machine({"before": "double", "after": "double", "base0": "double"}, _bricks, ("close", "box"))


def _ended(steps: DataFrame, box: float) -> DataFrame:
    """Steps of all bars so far with the box and the ends of their symbol's time span."""
    ends = steps.groupBy("symbol").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    return steps.join(ends, "symbol").withColumn("box", F.lit(float(box)))


def renko_of(steps: DataFrame, box: float) -> DataFrame:
    """The bricks of steps (symbol, time, before, after, base0), one row for each bar, such as `live.live_renko` keeps."""
    return _laid(_ended(steps, box))


def _laid(steps: DataFrame) -> DataFrame:
    moved = steps.where("after is not null").withColumnRenamed("time", "t")
    step = F.signum(F.col("after") - F.col("before"))
    rows = moved.select("symbol", "t", "first", "last", "box", "base0", "before", step.alias("step"), F.explode(F.sequence(F.lit(0), (F.abs(F.col("after") - F.col("before")) - 1).cast("int"))).alias("k"))
    rows = _spread(rows, ["t", "k"])
    start = F.col("base0") + (F.col("before") + F.col("k") * F.col("step")) * F.col("box")
    end = start + F.col("step") * F.col("box")
    return rows.select("symbol", "time", start.alias("open"), F.greatest(start, end).alias("high"), F.least(start, end).alias("low"), end.alias("close"))


def renko(bars: DataFrame, box: float | None = None) -> DataFrame:
    """symbol, time, open, high, low, close of the bricks; without a box, a fortieth of the range of closes."""
    return _laid(fold(_boxed(bars, box, "close", "close", 40), [renko_steps()]))


def _columns(s: dict, close: float | None, box: float | None, reversal: float) -> tuple | None:
    """Column number, direction, top and bottom after a close that changed the chart."""
    if close is None or not box:
        return None
    if "grid" not in s:
        s.update(grid=close, top=close, bottom=close, way=0, column=0)
        return None
    on_grid = lambda cut: cut((close - s["grid"]) / box) * box + s["grid"]
    if s["way"] >= 0 and close >= s["top"] + box:
        new = s["way"] == 0
        s.update(top=on_grid(math.floor), way=1)
        s["low"] = s["bottom"] if new else s["low"]
    elif s["way"] <= 0 and close <= s["bottom"] - box:
        new = s["way"] == 0
        s.update(bottom=on_grid(math.ceil), way=-1)
        s["high"] = s["top"] if new else s["high"]
    elif s["way"] == 1 and close <= s["top"] - reversal * box:
        s.update(way=-1, bottom=close, high=s["top"] - box, column=s["column"] + 1)
    elif s["way"] == -1 and close >= s["bottom"] + reversal * box:
        s.update(way=1, top=close, low=s["bottom"] + box, column=s["column"] + 1)
    else:
        return None
    ends = (s["low"], s["top"]) if s["way"] == 1 else (s["high"], s["bottom"])
    return (float(s["column"]), *ends)


def figure_steps(reversal: float = 2.0) -> Machine:
    """The column that each bar (close, box) of a Point and Figure chart changes, and its ends; null where it changes none."""
    return Machine({"column": "double", "open_at": "double", "close_at": "double"}, _columns, ("close", "box"), {"reversal": reversal if reversal > 0 else 2.0})


def figure_of(steps: DataFrame, box: float) -> DataFrame:
    """The columns of steps (symbol, time, column, open_at, close_at), one row for each bar, such as `live.live_figure` keeps."""
    return _drawn(_ended(steps, box))


def _drawn(steps: DataFrame) -> DataFrame:
    rows = steps.where("column is not null")
    last = rows.groupBy("symbol", "column", "first", "last").agg(F.max_by(F.struct("open_at", "close_at"), "time").alias("c"))
    return _spread(last, ["column"]).select("symbol", "time", F.col("c.open_at").alias("open"), F.greatest("c.open_at", "c.close_at").alias("high"), F.least("c.open_at", "c.close_at").alias("low"), F.col("c.close_at").alias("close"))


def point_and_figure(bars: DataFrame, box: float | None = None, reversal: float = 2.0) -> DataFrame:
    """symbol, time, open, high, low, close of the columns; without a box, a fiftieth of the high-low range."""
    return _drawn(fold(_boxed(bars, box, "high", "low", 50), [figure_steps(reversal)]))
