import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tickloom.functions import calendar, resample, scalars, trading
from tickloom.operators import compare, derived, orderflow
from tickloom.operators.profiles import area

BAR = "symbol string, time long, open double, high double, low double, close double, volume double"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_resampling_keeps_the_first_time_and_null_volume(spark):
    data = [(0, 10, 12, 9, 11, 2), (60, 11, 15, 10, 14, 3), (120, 20, 23, 18, 21, None), (180, 21, 24, 19, 22, 7), (360, 30, 31, 28, 29, 4), (480, 1, 1, 1, 1, None)]
    bars = spark.createDataFrame([("x", t, float(o), float(h), float(lo), float(c), v if v is None else float(v)) for t, o, h, lo, c, v in data], BAR)
    got = rows(resample.resample(bars, 120), "time")
    assert [r[1:] for r in got] == [(0, 10, 15, 9, 14, 5), (120, 20, 24, 18, 22, 7), (360, 30, 31, 28, 29, 4), (480, 1, 1, 1, 1, None)]
    assert [resample.resolution_seconds(x) for x in ("5", "30s", "4H", "1d", "2w")] == [300, 30, 14400, 86400, 1209600]
    for bad in ("1M", "", "x", "0", "-3m"):
        with pytest.raises(ValueError):
            resample.resolution_seconds(bad)


def trades(spark):
    data = [(60, 100.0, 2, "buy"), (61, 99.75, 3, "sell"), (62, 100.0, 5, "sell"), (119, 100.25, 7, "buy"), (120, 100.0, 11, "sell")]
    return spark.createDataFrame([("x", t, t * 10**6, p, float(v), s, i) for i, (t, p, v, s) in enumerate(data)], "symbol string, time long, micros long, price double, volume double, aggressor_side string, id long")


def test_footprint_of_five_trades(spark):
    levels = orderflow.footprint_levels(trades(spark), 60, 0.25)
    assert [(r[1], r[3], r[4], r[5], r[6]) for r in rows(levels, "time", "tick")] == [(60, 99.75, 3, 0, 1), (60, 100, 5, 2, 2), (60, 100.25, 0, 7, 1), (120, 100, 11, 0, 1)]
    bars = orderflow.footprint_bars(trades(spark), 60)
    m = rows(orderflow.footprint_metrics(levels, bars).select("time", "delta", "poc", "poc_volume", "va_low", "va_high", "auction_low", "auction_high"), "time")
    # 100 and 100.25 hold 7 each: the close, 100.25, decides
    assert m[0] == (60, 1, 100.25, 7, 100, 100.25, "finished", "finished")
    assert orderflow.off_grid(trades(spark), "price", 0.5).count() == 2
    assert orderflow.trade_faults(trades(spark).union(trades(spark).limit(1))).count() >= 1


def test_imbalances_and_stacks(spark):
    cells = [(100, 10, 0), (101, 5, 30), (102, 0, 15), (103, 2, 9), (104, 0, 8)]
    levels = spark.createDataFrame([("x", 0, t, float(t), float(b), float(a), 1) for t, b, a in cells], "symbol string, time long, tick long, price double, bid_volume double, ask_volume double, trade_count long")
    found = orderflow.imbalances(levels)
    assert sorted((r["side"], r["tick"]) for r in found.collect()) == [("buy", 101), ("buy", 102), ("buy", 103), ("buy", 104)]
    assert [(r["side"], r["n"], r["low"], r["high"]) for r in orderflow.stacked(found).collect()] == [("buy", 4, 101, 104)]


def test_value_area_grows_by_the_larger_side(spark):
    import random

    random.seed(4)
    for _ in range(15):
        totals = [float(random.randint(0, 4)) for _ in range(random.randint(1, 9))]
        at = totals.index(max(totals))
        df = spark.createDataFrame([([(x,) for x in totals], at + 1)], "t array<struct<v: double>>, at int")
        got = df.select(orderflow.value_area(F.col("t"), "v", F.lit(sum(totals)), F.col("at"), 0.7).alias("v")).first()["v"]
        assert (got["lo"] - 1, got["hi"] - 1) == area(totals, at, 0.7)


def test_developing_profile_ends_at_the_profile(spark):
    levels, bars = orderflow.footprint_levels(trades(spark), 60, 0.25), orderflow.footprint_bars(trades(spark), 60)
    last = orderflow.developing_profile(levels, bars).orderBy(F.desc("time")).first()
    whole = orderflow.volume_profile(levels, bars).first()
    assert (last["poc"], last["va_low"], last["va_high"], last["volume"]) == (whole["poc"], whole["va_low"], whole["va_high"], whole["volume"])
    modes = spark.createDataFrame([("a", "exact", None), ("b", "exact", None), ("b", "approximate", "z"), ("c", "approximate", "y"), ("c", "approximate", "x")], "symbol string, data_mode string, reason string")
    assert rows(orderflow.profile_modes(modes), "symbol") == [("a", "ready", ""), ("b", "mixed", "z"), ("c", "approximate", "x,y")]


def test_time_price_profile(spark):
    data = [(60, "a", 100, 102), (120, "a", 101, 103), (180, "b", 102, 104)]
    bars = spark.createDataFrame([("x", s, t, float(lo), float(hi)) for t, s, lo, hi in data], "symbol string, session string, time long, low double, high double")
    got = {r["session"]: r for r in orderflow.tpo_profile(bars, 1.0).collect()}
    assert (got["a"]["total"], got["a"]["poc"], got["a"]["poc_count"], got["a"]["single_prints"]) == (6, 101, 2, 2)
    assert (got["a"]["ib_low"], got["a"]["ib_high"], got["b"]["poc"]) == (100, 103, 103)
    symbols = spark.range(106).select(orderflow.tpo_symbol(F.col("id")).alias("s")).collect()
    assert [symbols[i][0] for i in (0, 25, 26, 51, 52, 105)] == ["A", "Z", "a", "z", "A2", "B3"]
    with pytest.raises(Exception):  # noqa: B017
        orderflow.tpo_levels(bars, 0.0001).count()


def path(spark, closes):
    return spark.createDataFrame([("x", 60 * i, float(c), float(c), float(c), float(c), 1.0) for i, c in enumerate(closes)], BAR)


def test_renko_and_point_and_figure(spark):
    bricks = rows(derived.renko(path(spark, [10, 12.5, 11.5, 9.9]), 1.0), "time")
    assert [(r[2], r[5]) for r in bricks] == [(10, 11), (11, 12), (12, 11), (11, 10)]
    assert [r[1] for r in bricks] == [0, 60, 120, 180]
    columns = rows(derived.point_and_figure(path(spark, [10, 13.5, 12.5, 10.5, 9, 14]), 1.0), "time")
    assert [(r[2], r[5]) for r in columns] == [(10, 13), (12, 9), (10, 14)]
    assert derived.renko(path(spark, [5]), 1.0).count() == 0


def test_sessions_over_daylight_saving(spark):
    plan = calendar.Schedule("America/New_York", (calendar.SessionRule("day", (1, 2, 3, 4, 5), "09:30", "16:00"),), frozenset({"2024-03-12"}), {"2024-03-13": (calendar.SessionRule("half", (3,), "09:30", "13:00"),)})
    table = calendar.sessions(spark, plan, "2024-03-08", "2024-03-13")
    at = lambda *x: int(datetime(*x, tzinfo=timezone.utc).timestamp())
    assert [(r["id"], r["open"], r["close"]) for r in table.orderBy("open").collect()] == [
        ("2024-03-08/day", at(2024, 3, 8, 14, 30), at(2024, 3, 8, 21)),
        ("2024-03-11/day", at(2024, 3, 11, 13, 30), at(2024, 3, 11, 20)),
        ("2024-03-13/half", at(2024, 3, 13, 13, 30), at(2024, 3, 13, 17)),
    ]
    times = spark.createDataFrame([("x", at(2024, 3, 8, 15)), ("x", at(2024, 3, 9)), ("x", at(2024, 3, 13, 17))], "symbol string, time long")
    assert [r["session"] for r in calendar.with_session(times, table).orderBy("time").collect()] == ["2024-03-08/day", None, None]
    moved = {r["time"]: r["trading_time"] for r in calendar.projected(times, table).collect()}
    assert moved[at(2024, 3, 8, 15)] == 1800 and moved[at(2024, 3, 9)] == 6.5 * 3600 and moved[at(2024, 3, 13, 17)] is None
    back = calendar.unprojected(spark.createDataFrame([(1800,), (23400,)], "trading_time long"), table)
    assert sorted(r["time"] for r in back.collect()) == [at(2024, 3, 8, 15), at(2024, 3, 11, 13, 30)]
    near = {r["time"]: (r["next_open"], r["previous_close"]) for r in calendar.neighbours(times, table).collect()}
    assert near[at(2024, 3, 9)] == (at(2024, 3, 11, 13, 30), at(2024, 3, 8, 21))
    ends = calendar.bar_close(times, 8 * 3600, table).orderBy("time").collect()
    assert ends[0]["close_time"] == at(2024, 3, 8, 21)
    two = calendar.daily_close(times.limit(1), table, 2).first()
    assert two["close_time"] == at(2024, 3, 11, 20)
    gap = calendar.Schedule("America/New_York", (calendar.SessionRule("night", (7,), "02:30", "05:00"),))
    with pytest.raises(ValueError):
        calendar.sessions(spark, gap, "2024-03-10", "2024-03-10")
    with pytest.raises(ValueError):
        calendar.Schedule("UTC", (calendar.SessionRule("a", (1,), "09:00", "12:00"), calendar.SessionRule("b", (1,), "11:00", "13:00"))).check()


def test_as_of_takes_the_left_of_equals(spark):
    right = spark.createDataFrame([("x", 10, 1.0), ("x", 20, 2.0)], "symbol string, time long, v double")
    left = spark.createDataFrame([("x", t) for t in (5, 10, 15, 16, 25)], "symbol string, time long")
    assert [r["v"] for r in compare.as_of(left, right, "v").orderBy("time").collect()] == [1, 1, 1, 2, 2]
    assert [r["v"] for r in compare.as_of(left, right, "v", "left").orderBy("time").collect()] == [None, 1, 1, 1, 2]
    assert [r["v"] for r in compare.as_of(left, right, "v", "right").orderBy("time").collect()] == [1, 1, 2, 2, None]


def test_scalars_and_records(spark):
    row = spark.createDataFrame([(-2.5, 100.0, 1709164800)], "x double, p double, t long")
    got = row.select(scalars.quantised(F.col("x"), 1.0).alias("q"), scalars.scaled(F.col("x"), "logarithmic").alias("l"), scalars.preset_start(F.col("t"), "1M", F.lit(0)).alias("m"), scalars.preset_start(F.col("t"), "5D", F.lit(0)).alias("d"), scalars.backoff(F.lit(3), 1.0, 2.0, 3.5).alias("b")).first()
    assert (got["q"], got["l"], got["m"], got["d"], got["b"]) == (-2, None, 1706486400, 1709164800 - 432000, 3.5)
    orders = spark.createDataFrame([("1", "x", "buy", "limit", "working", 2.0, 1.0, 10.05, None), ("2", "x", "buy", "limit", "working", 2.0, 3.0, 10.05, None), ("3", "x", "up", "market", "working", 2.0, 1.0, None, None), ("3", "x", "buy", "market", "working", 2.0, 1.0, None, None), ("4", "x", "buy", "stop", "working", 2.5, 0.0, None, 1.0), ("5", "x", "buy", "limit", "working", 1.0, 0.0, 10.051, None)], "id string, symbol string, side string, type string, status string, quantity double, filled double, limit_price double, stop_price double")
    assert [r["reason"] for r in trading.check_orders(orders, 0.05, 1.0).orderBy("id", "side").collect()] == [None, "filled is outside the quantity", "id is not unique", "id is not unique", "quantity is off the grid", "limit price is missing or off the grid"]
    quotes = spark.createDataFrame([("a", 1, 10.0, 9.0), ("b", 1, None, 9.0), ("c", 1, None, None)], "symbol string, time long, bid double, ask double")
    assert [r["valid"] for r in trading.check_quotes(quotes, 1.0).orderBy("symbol").collect()] == [False, True, False]
    intents = spark.createDataFrame([("1", "place-order", None), ("2", "cancel-order", None), ("3", "jump", "x")], "id string, kind string, target string")
    assert [r["valid"] for r in trading.check_intents(intents).orderBy("id").collect()] == [True, False, False]


def test_overview_and_relative(spark):
    bars = path(spark, [0, 2, 4, None or 8, 6])
    got = rows(compare.overview(bars, F.col("close"), most=3).select("bucket", "open", "high", "low", "close", "n"), "bucket")
    assert got == [(0, 0, 2, 0, 2, 2), (1, 4, 8, 4, 8, 2), (2, 6, 6, 6, 6, 1)]
    base = compare.relative(bars, F.col("close"), "indexed")
    assert [r["relative"] for r in base.orderBy("time").collect()] == [0, 100, 200, 400, 300]
    assert math.isclose(compare.relative(bars, F.col("close"), start=120).orderBy("time").collect()[-1]["relative"], 50)
