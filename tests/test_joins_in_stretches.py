import random
from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tickloom.functions import calendar
from tickloom.operators import compare
from tickloom.operators.stretches import long_symbols

SCHEMA = "symbol string, time long, v double"


@pytest.fixture(scope="module")
def sides():
    """A symbol with a burst, a short one, one with nothing on the right, a null one; times that occur twice."""
    rng = random.Random(4)
    right = [("hot", t, float(rng.randint(0, 9))) for t in [*range(0, 4000, 400), *(2000 + k for k in range(300)), 2001, 2001]]
    right += [("cold", t, float(t)) for t in (5, 900)] + [(None, 7, 1.0), (None, 70, None), ("nan", 3, float("nan"))]
    left = [("hot", rng.randint(-500, 6000)) for _ in range(250)] + [("hot", 2001), ("cold", 452), ("cold", 453), ("none", 1), (None, 8), (None, 60), ("nan", 9)]
    return left, right


def brute(left, right, how):
    out = []
    for s, t in left:
        low = lambda v: float("-inf") if v is None else float("inf") if v != v else v
        back = max(((x, low(v), v) for r, x, v in right if r == s and x <= t), key=lambda m: m[:2], default=None)
        ahead = min(((x, low(v), v) for r, x, v in right if r == s and x >= t), key=lambda m: m[:2], default=None)
        one = {"left": back, "right": ahead, "nearest": back if ahead is None or (back and t - back[0] <= ahead[0] - t) else ahead}[how]
        out.append((s, t, one and one[0], one and one[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", ["nearest", "left", "right"])
@pytest.mark.parametrize("span", [None, 20])
def test_as_of_equals_looking_at_every_row(spark, sides, how, span):
    left, right = (spark.createDataFrame(x, s) for x, s in zip(sides, ("symbol string, time long", SCHEMA), strict=True))
    long = None if span is None else long_symbols(left.unionByName(right.select("symbol", "time")), span)
    got = compare.as_of(left, right, "v", how, long)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, brute(*sides, how)))


def test_as_of_spreads_a_burst_over_buckets(spark):
    from tickloom.operators.stretches import bucketed

    rows = spark.range(20_000).select(F.lit("x").alias("symbol"), F.when(F.col("id") < 100, F.col("id") * 10**6).otherwise(5 * 10**7 + F.col("id")).alias("time"))
    counts = bucketed(rows, long_symbols(rows, 1000)).groupBy("_bucket").count().toPandas()["count"]
    assert len(counts) > 200 and counts.max() < 400


@pytest.mark.parametrize("start, end, padding", [(100, 300, 0), (100, 300, 2), (105, 106, 1), (-9, -1, 3), (9000, 9999, 2), (300, 100, 2), (-9, 9999, 4)])
@pytest.mark.parametrize("long", [False, True])
def test_places_in_a_series(spark, start, end, padding, long):
    data = [("a", 10 * k, float(k)) for k in range(60)] + [("b", 200, 1.0), (None, 150, 2.0), (None, 400, 3.0)]
    bars = spark.createDataFrame(data, SCHEMA).repartition(3)
    some = long_symbols(bars, 20) if long else None
    series = {s: [r for r in data if r[0] == s] for s in ("a", "b", None)}
    want, cut, third = [], [], []
    for rows in series.values():
        i, j = sum(r[1] < start for r in rows), sum(r[1] <= end for r in rows)
        want += rows[max(0, i - padding) : j + padding] if end >= start else []
        cut += rows[:-2]
        third += rows[3:4]
    plain = lambda df: sorted((tuple(r) for r in df.select("symbol", "time", "v").collect()), key=str)
    assert plain(compare.visible(bars, start, end, padding, some)) == sorted(want, key=str)
    if padding == 2:
        assert plain(compare.popped(bars, 2, some)) == sorted(cut, key=str)
        assert plain(compare.at_index(bars, 3, long=some)) == sorted(third, key=str)
        got = compare.overview(bars, F.col("v"), 7, some).orderBy("symbol", "bucket").collect()
        assert [(r["open"], r["close"], r["n"]) for r in got if r["symbol"] == "a"] == [(9.0 * k, min(9.0 * k + 8, 59.0), 9 if k < 6 else 6) for k in range(7)]


def test_alignment_follows_the_clock_of_one_calendar(spark):
    home = calendar.Schedule("America/New_York", (calendar.SessionRule("main", (1, 2, 3, 4, 5), "09:30", "16:00"),))
    table = calendar.sessions(spark, home, "2024-03-07", "2024-03-12")  # the clock goes forward on the 10th
    at = lambda day, hour, zone: int(datetime(2024, 3, day, hour, 30, tzinfo=ZoneInfo(zone)).timestamp())
    ny = [(at(d, h, "America/New_York"), d + h / 100) for d in (8, 11) for h in (9, 12)]
    tokyo = [(at(d, h, "Asia/Tokyo"), 100.0 + d + h / 100) for d in (8, 9, 12, 13) for h in (9, 14)] + [(ny[1][0], 1.0), (ny[1][0], 2.0), (at(20, 9, "Asia/Tokyo"), 5.0)]
    series = {"ny": spark.createDataFrame(ny, "time long, value double"), "tokyo": spark.createDataFrame(tokyo, "time long, value double")}
    got = {r["trading_time"]: (r["ny"], r["tokyo"]) for r in compare.aligned_on_sessions(series, table).collect()}
    day = 23400  # seconds of a session; the first is that of the 7th
    assert got[day] == (8.09, 108.14)  # Tokyo's 8th is over before New York's begins
    assert got[day + 10800] == (8.12, 2.0)
    assert got[2 * day] == (11.09, 109.14) and got[3 * day] == (None, 112.14)
    assert got[2 * day + 10800] == (11.12, None) and len(got) == 5
