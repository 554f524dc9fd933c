"""Order flow: footprints from trades, their metrics, volume profiles and time-price profiles.

Levels are rows (symbol, time, tick, price, bid_volume, ask_volume, trade_count); prices are grouped by
integer tick. Only a bar's or a profile's own levels are ever gathered into an array, for its value area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.resample import bucket

LEVEL = ["symbol", "time"]


def tick_of(price: Column | str, size: float, origin: float = 0.0) -> Column:
    """Grid index, halves upward."""
    price = F.col(price) if isinstance(price, str) else price
    return F.floor((price - F.lit(origin)) / F.lit(size) + F.lit(0.5)).cast("long")


def off_grid(rows: DataFrame, price: str, size: float, origin: float = 0.0) -> DataFrame:
    """Rows whose price is farther from its tick than rounding explains; a strict reader refuses them."""
    exact = tick_of(price, size, origin) * size + origin
    room = F.greatest(F.lit(1e-12), F.abs(F.col(price)) * (2.220446049250313e-16 * 16), F.lit(size * 1e-9))
    return rows.where(F.abs(F.col(price) - exact) > room)


def trade_faults(trades: DataFrame) -> DataFrame:
    """Trades that repeat an id or step back in time, with the reason."""
    order = Window.partitionBy("symbol").orderBy("id")
    late = trades.withColumn("before", F.max("time").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("time < before").select("symbol", "id", F.lit("time goes back").alias("reason"))
    twice = trades.groupBy("symbol", "id").agg(F.count("*").alias("n")).where("n > 1").select("symbol", "id", F.lit("id occurs twice").alias("reason"))
    return late.union(twice)


def footprint_levels(trades: DataFrame, seconds: int, size: float, origin: int = 0) -> DataFrame:
    """Volume sold into the bid and bought at the ask by bar and tick; a bar's time is its bucket's start."""
    side = lambda s: F.coalesce(F.sum(F.when(F.col("aggressor_side") == s, F.col("volume"))), F.lit(0.0))
    start = (bucket(seconds, origin) * seconds + origin).alias("time")
    return (
        trades.groupBy("symbol", start, tick_of("price", size).alias("tick"))
        .agg(side("sell").alias("bid_volume"), side("buy").alias("ask_volume"), F.count("*").alias("trade_count"))
        .select("symbol", "time", "tick", (F.col("tick") * size).alias("price"), "bid_volume", "ask_volume", "trade_count")
    )


def footprint_bars(trades: DataFrame, seconds: int, origin: int = 0) -> DataFrame:
    """OHLC of the same bars in trade order."""
    order, start = F.struct("micros", "id"), (bucket(seconds, origin) * seconds + origin).alias("time")
    return trades.groupBy("symbol", start).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"))


def poc_struct(total: Column, distance: Column, price: Column, policy: str = "closest") -> Column:
    """What the point of control has most of: total, then the policy's price."""
    return {"closest": F.struct(total, -distance, -price), "lower": F.struct(total, -price), "higher": F.struct(total, price)}[policy]


def value_area(cells: Column, name: str, total: Column, at: Column, share: float) -> Column:
    """struct(lo, hi, volume): positions (from 1) of the area around `at` that holds `share` of the total.

    It grows by the larger neighbour, by both where they are equal, and stops at the goal. `cells` should be
    a column, not an expression: it is looked up at every step.
    """
    cell = lambda k: F.when((k >= 1) & (k <= F.size(cells)), F.element_at(cells, k.cast("int"))[name]).otherwise(F.lit(-1.0))
    state = lambda lo, hi, v, goal: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), v.cast("double").alias("volume"), goal.cast("double").alias("goal"))

    def grow(s: Column, _: Column) -> Column:
        below, above = cell(s["lo"] - 1), cell(s["hi"] + 1)
        return (
            F.when((s["volume"] >= s["goal"]) | ((below < 0) & (above < 0)), s)
            .when((below == above) & (below >= 0), state(s["lo"] - 1, s["hi"] + 1, s["volume"] + below + above, s["goal"]))
            .when(above > below, state(s["lo"], s["hi"] + 1, s["volume"] + above, s["goal"]))
            .otherwise(state(s["lo"] - 1, s["hi"], s["volume"] + below, s["goal"]))
        )

    return F.aggregate(F.sequence(F.lit(1), F.size(cells)), state(at, at, cell(at), total * share), grow)


def footprint_metrics(levels: DataFrame, bars: DataFrame, policy: str = "closest", share: float = 0.7) -> DataFrame:
    """Totals, delta, point of control, value area and auction state of each bar."""
    joined = levels.join(bars, LEVEL).withColumn("total", F.col("bid_volume") + F.col("ask_volume"))
    grouped = joined.groupBy(*LEVEL).agg(
        F.sum("bid_volume").alias("bid_volume"),
        F.sum("ask_volume").alias("ask_volume"),
        F.sum("total").alias("volume"),
        F.when(F.count("trade_count") == F.count("*"), F.sum("trade_count")).alias("trade_count"),
        F.max_by("price", poc_struct(F.col("total"), F.abs(F.col("price") - F.col("close")), F.col("price"), policy)).alias("poc"),
        F.max("total").alias("poc_volume"),
        F.array_sort(F.collect_list(F.struct("price", "total"))).alias("cells"),
        F.min_by("ask_volume", "tick").alias("low_ask"),
        F.max_by("bid_volume", "tick").alias("high_bid"),
        (F.abs(F.min("price") - F.first("low")) < 1e-9).alias("has_low"),
        (F.abs(F.max("price") - F.first("high")) < 1e-9).alias("has_high"),
    )
    at = F.array_position(F.transform("cells", lambda c: c["price"]), F.col("poc"))
    area = value_area(F.col("cells"), "total", F.col("volume"), at, share)
    state = lambda has, v: F.when(~has, "unavailable").when(v > 0, "unfinished").otherwise("finished")
    return grouped.withColumn("area", area).select(
        *LEVEL,
        "bid_volume",
        "ask_volume",
        "volume",
        (F.col("ask_volume") - F.col("bid_volume")).alias("delta"),
        "trade_count",
        "poc",
        "poc_volume",
        F.element_at("cells", F.col("area.lo").cast("int"))["price"].alias("va_low"),
        F.element_at("cells", F.col("area.hi").cast("int"))["price"].alias("va_high"),
        F.col("area.volume").alias("va_volume"),
        state(F.col("has_low"), F.col("low_ask")).alias("auction_low"),
        state(F.col("has_high"), F.col("high_bid")).alias("auction_high"),
    )


def imbalances(levels: DataFrame, ratio: float = 3.0, least: float = 0.0) -> DataFrame:
    """Diagonal imbalances: asks against the bid a tick below, bids against the ask a tick above.

    An empty tick inside the bar counts as zero, so the ratio there is infinite; the bar's edges are not compared.
    """
    w = Window.partitionBy(*LEVEL).orderBy("tick")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = lambda fn, step, v: F.coalesce(F.when(fn("tick").over(w) == F.col("tick") + step, fn(v).over(w)), F.lit(0.0))
    seen = levels.select(*LEVEL, "tick", "price", "bid_volume", "ask_volume", near(F.lag, -1, "bid_volume").alias("bid_below"), near(F.lead, 1, "ask_volume").alias("ask_above"), F.min("tick").over(whole).alias("low"), F.max("tick").over(whole).alias("high"))
    of = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0.0))).otherwise(F.lit(float("inf")))
    side = lambda name, v, other, inside: seen.where(inside & (v > 0) & (v >= least) & (of(v, other) >= ratio)).select(*LEVEL, "tick", "price", F.lit(name).alias("side"), v.alias("volume"), other.alias("compared_volume"), of(v, other).alias("ratio"))
    return side("buy", F.col("ask_volume"), F.col("bid_below"), F.col("tick") > F.col("low")).union(side("sell", F.col("bid_volume"), F.col("ask_above"), F.col("tick") < F.col("high")))


def stacked(found: DataFrame, least: int = 3) -> DataFrame:
    """Runs of at least `least` adjacent ticks with an imbalance on the same side."""
    w = Window.partitionBy(*LEVEL, "side").orderBy("tick")
    runs = found.withColumn("island", F.col("tick") - F.row_number().over(w))
    return runs.groupBy(*LEVEL, "side", "island").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high")).where(F.col("n") >= least).drop("island")


def profile_range(rows: DataFrame, mode: str, visible: tuple[int, int], fixed: tuple[int, int] | None = None, sessions: DataFrame | None = None, anchor: int | None = None) -> DataFrame:
    """The bars or levels (time) that a profile is made of: those of the visible or a fixed range, ends included, or of
    the session (open, close) that holds `anchor`, else the end of the visible range; none where no session does."""
    if mode == "session":
        at = visible[1] if anchor is None else anchor
        found = sessions.where((F.col("open") <= at) & (F.col("close") > at)).agg(F.min("open"), F.min("close")).first()
        return rows.where(F.lit(False)) if found[0] is None else rows.where((F.col("time") >= found[0]) & (F.col("time") < found[1]))
    if mode not in ("visible", "fixed") or (mode == "fixed" and fixed is None):
        raise ValueError("a profile range is visible, fixed (with a range) or session")
    low, high = sorted(visible if mode == "visible" else fixed)
    return rows.where(F.col("time").between(low, high))


def order_faults(trades: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Trades (symbol, time, id, sequence, and the column `arrival`) that break the order, with the first reason.

    A trade may not be earlier than the one before it; at the same time its sequence, if it has one, may not be lower than
    the last one; and no id comes twice. A strict reader refuses a stream with any of these.
    """
    series = Window.partitionBy("symbol").orderBy(arrival)
    same = Window.partitionBy("symbol", "time").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    number = F.row_number().over(Window.partitionBy("symbol", "id").orderBy(arrival))
    rows = trades.select("*", F.lag("time").over(series).alias("_before"), F.last("sequence", ignorenulls=True).over(same).alias("_last"), number.alias("_nth"))
    reason = (
        F.when(F.col("time") < F.col("_before"), "time goes back")
        .when((F.col("time") == F.col("_before")) & (F.col("sequence") < F.col("_last")), "sequence goes back")
        .when(F.col("id").isNotNull() & (F.col("_nth") > 1), "id occurs twice")
    )
    return rows.withColumn("reason", reason).where("reason is not null").drop("_before", "_last", "_nth")


def volume_profile(levels: DataFrame, bars: DataFrame, share: float = 0.7) -> DataFrame:
    """Profile of all bars of a symbol; ties of the point of control go to the last close, then the lower price."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "time").alias("close"))
    ticks = levels.groupBy("symbol", "tick", "price").agg(F.sum("bid_volume").alias("bid"), F.sum("ask_volume").alias("ask"))
    edges = ticks.groupBy("symbol").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    near = last.join(edges, "symbol").select("symbol", F.greatest("lo", F.least("hi", "close")).alias("near"))
    from tickloom.operators.profiles import PROFILE, whole
    from tickloom.ship import by_group

    # a group has a row for each price level, however many trades there were
    return by_group(ticks.join(near, "symbol").select("symbol", "price", "bid", "ask", "near"), ["symbol"], whole(share), PROFILE)


def developing_profile(levels: DataFrame, bars: DataFrame, share: float = 0.7) -> DataFrame:
    """Point of control and value area after each bar, over all bars of the symbol up to it.

    One pass in time order with the running totals by tick as state: bars times ticks rows are never made.
    """
    from tickloom.operators.profiles import developing
    from tickloom.ship import by_group

    nested = levels.groupBy(*LEVEL).agg(F.collect_list(F.struct("tick", "price", (F.col("bid_volume") + F.col("ask_volume")).alias("total"))).alias("cells"))
    rows = nested.join(bars.select(*LEVEL, "close"), LEVEL)
    return by_group(rows, ["symbol"], developing(share), "symbol string, time long, poc double, va_low double, va_high double, volume double")


def profile_modes(footprints: DataFrame) -> DataFrame:
    """ready, approximate or mixed by symbol, from data_mode (exact or approximate) and reason; reasons sorted."""
    exact, all_ = F.count_if(F.col("data_mode") == "exact"), F.count("*")
    status = F.when(exact == all_, "ready").when(exact == 0, "approximate").otherwise("mixed")
    return footprints.groupBy("symbol").agg(status.alias("status"), F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


def tpo_levels(bars: DataFrame, size: float, most: int = 5000) -> DataFrame:
    """A row for each session, period and tick that the period's bar touched; bars wider than `most` ticks raise."""
    w = Window.partitionBy("symbol", "session").orderBy("time")
    low, high = tick_of("low", size), tick_of("high", size)
    wide = F.when(high - low + 1 > most, F.raise_error(F.lit("a bar spans too many levels")).cast("long")).otherwise(high)
    periods = bars.select("symbol", "session", "time", "low", "high", (F.row_number().over(w) - 1).alias("period"), low.alias("a"), wide.alias("b"))
    return periods.select("symbol", "session", "time", "period", "low", "high", F.explode(F.sequence("a", "b")).alias("tick"))


def tpo_symbol(period: Column) -> Column:
    """A-Z, a-z, then A2 and so on."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    letter = F.substring(F.lit(letters), (period % 52 + 1).cast("int"), F.lit(1))
    return F.when(period < 52, letter).otherwise(F.concat(letter, (F.floor(period / 52) + 1).cast("string")))


def tpo_profile(bars: DataFrame, size: float, share: float = 0.7, balance: int = 2) -> DataFrame:
    """Count, point of control, value area, initial balance and single prints of each session."""
    rows = tpo_levels(bars, size)
    levels = rows.groupBy("symbol", "session", "tick").agg(F.count("*").alias("n"))
    edges = rows.groupBy("symbol", "session").agg(
        F.min("time").alias("start"), F.max("time").alias("end"), (F.max("period") + 1).alias("periods"), (F.min("tick") + F.max("tick")).alias("twice_middle"), F.min(F.when(F.col("period") < balance, F.col("low"))).alias("ib_low"), F.max(F.when(F.col("period") < balance, F.col("high"))).alias("ib_high")
    )
    cells = levels.join(edges, ["symbol", "session"])
    away = F.abs(2 * F.col("tick") - F.col("twice_middle"))
    out = cells.groupBy("symbol", "session", "start", "end", "periods", "ib_low", "ib_high").agg(
        F.sum("n").alias("total"), F.max_by("tick", F.struct("n", -away, -F.col("tick"))).alias("poc_tick"), F.max("n").alias("poc_count"), F.count_if(F.col("n") == 1).alias("single_prints"), F.array_sort(F.collect_list(F.struct("tick", F.col("n").cast("double").alias("n")))).alias("cells")
    )
    area = value_area(F.col("cells"), "n", F.col("total"), F.array_position(F.transform("cells", lambda c: c["tick"]), F.col("poc_tick")), share)
    price = lambda t: t * F.lit(size)
    return out.withColumn("area", area).select(
        "symbol", "session", "start", "end", "periods", "total", price(F.col("poc_tick")).alias("poc"), "poc_count", "single_prints", "ib_low", "ib_high",
        price(F.element_at("cells", F.col("area.lo").cast("int"))["tick"]).alias("va_low"), price(F.element_at("cells", F.col("area.hi").cast("int"))["tick"]).alias("va_high"),
    )
