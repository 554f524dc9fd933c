"""The trading store, registration checks, sources and chains."""

import pytest
from pyspark.sql import functions as F

from tickloom.functions import trading
from tickloom.operators import compare, indicators, orderflow
from tickloom.plans.run import chained, indicator

ORDERS = "id string, symbol string, side string, type string, status string, quantity double, filled double, limit_price double, stop_price double"


def order(id_, quantity=2.0, **more):
    row = {"symbol": "s", "side": "buy", "type": "market", "status": "working", "filled": 0.0, "limit_price": None, "stop_price": None, **more}
    return (id_, row["symbol"], row["side"], row["type"], row["status"], quantity, row["filled"], row["limit_price"], row["stop_price"])


def test_store_takes_whole_tables_and_says_what_changed(spark):
    store = trading.TradingStore(0.25, 1.0)
    made = lambda *rows: spark.createDataFrame(list(rows), ORDERS)
    changes = lambda df: sorted(map(tuple, df.collect()))
    assert changes(store.set("orders", made(order("a"), order("b")))) == [("a", "added"), ("b", "added")] and store.version == 1
    assert changes(store.set("orders", made(order("b"), order("a")))) == [] and store.version == 1
    assert changes(store.set("orders", made(order("b", 3.0), order("c")))) == [("a", "removed"), ("b", "updated"), ("c", "added")]
    with pytest.raises(ValueError, match="quantity is off the grid"):
        store.set("orders", made(order("b", 2.5)))
    with pytest.raises(ValueError, match="not unique"):
        store.set("orders", made(order("b"), order("b")))
    assert store.version == 2 and store.snapshot()["orders"].count() == 2
    with pytest.raises(ValueError):
        store.set("trades", made())


def test_names_of_indicators_are_unique_and_plain():
    for names in (("SimpleMovingAverage",), ("New", "sma"), ("New", " x"), ("New", "UPPER"), ("",)):
        with pytest.raises(ValueError):
            indicators.indicator(*names)(lambda: None)
    with pytest.raises(ValueError):
        indicators.indicator("New", length=float("nan"))(lambda length: None)


def test_sources_and_chains(spark):
    rows = [("s", k, 1.0 + k, 3.0 + k, 0.5 + k, 2.0 + k * k if k != 4 else None, 5.0) for k in range(12)]
    bars = spark.createDataFrame(rows, "symbol string, time long, open double, high double, low double, close double, volume double")
    got = [r["value"] for r in indicator(bars, "sma", source="hl2", length=2).orderBy("time").collect()]
    assert got[0] is None and got[1:] == [k + 2.25 for k in range(11)]
    skipped = [r["value"] for r in indicator(bars, "sma", source=F.col("close"), length=2).orderBy("time").collect()]
    closes = [(k, 2.0 + k * k) for k in range(12) if k != 4]
    want = {b[0]: (a[1] + b[1]) / 2 for a, b in zip(closes, closes[1:])}
    assert skipped == [want.get(k) for k in range(12)]
    of = [r["value"] for r in chained(bars, ("momentum", {"length": 1}, "value"), ("sum", {"length": 2}, "value")).orderBy("time").collect()]
    moves = [(k, 2 * k - 1.0) for k in range(1, 12) if k not in (4, 5)]
    want = {b[0]: a[1] + b[1] for a, b in zip(moves, moves[1:])}
    assert of == [want.get(k) for k in range(12)]
    with pytest.raises(ValueError):
        chained(bars, ("rsi", {}, "nothing"), ("sma", {}, "value"))


def test_profile_ranges(spark):
    bars = spark.createDataFrame([(t,) for t in range(0, 100, 10)], "time long")
    sessions = spark.createDataFrame([(20, 50), (60, 90)], "open long, close long")
    times = lambda df: [r["time"] for r in df.orderBy("time").collect()]
    assert times(orderflow.profile_range(bars, "visible", (50, 30))) == [30, 40, 50]
    assert times(orderflow.profile_range(bars, "fixed", (0, 90), fixed=(10, 20))) == [10, 20]
    assert times(orderflow.profile_range(bars, "session", (0, 45), sessions=sessions)) == [20, 30, 40]
    assert times(orderflow.profile_range(bars, "session", (0, 45), sessions=sessions, anchor=60)) == [60, 70, 80]
    assert times(orderflow.profile_range(bars, "session", (0, 55), sessions=sessions)) == []
    with pytest.raises(ValueError):
        orderflow.profile_range(bars, "fixed", (0, 1))


def test_order_of_trades(spark):
    rows = [(0, 10, "a", 1), (1, 10, "b", None), (2, 10, "c", 0), (3, 11, "d", 0), (4, 9, "e", 5), (5, 11, "a", 1), (6, 11, None, None), (7, 11, None, 1)]
    trades = spark.createDataFrame([("s", t, i, q, k) for k, t, i, q in rows], "symbol string, time long, id string, sequence long, arrival long")
    assert sorted((r["arrival"], r["reason"]) for r in orderflow.order_faults(trades).collect()) == [(2, "sequence goes back"), (4, "time goes back"), (5, "id occurs twice")]


def test_nearest_value(spark):
    row = spark.createDataFrame([(1.0, 5.0, None, 3.0)], "a double, b double, c double, d double")
    near = lambda at: row.select(compare.nearest_value([F.col(c) for c in "abcd"], F.lit(at))).first()[0]
    assert (near(0.0), near(4.0), near(3.4)) == (1.0, 5.0, 3.0)
