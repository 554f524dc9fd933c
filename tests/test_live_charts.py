import math
from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F
from test_streaming import feed, finish

from tickloom.functions import calendar
from tickloom.operators import derived
from tickloom.streaming import live

BAR = "symbol string, time long, open double, high double, low double, close double, volume double"


def bar(i, lift=0.0, symbol="x"):
    close = None if i == 5 else round(100 + 9 * math.sin(i / 2) + i % 3 + lift, 2)
    return (symbol, 60 * i, close, close, close, close, 1.0)


#: Micro-batches with revised last bars, one that comes late, one without a close.
PARTS = [[bar(0), bar(1)], [bar(2, 30.0)], [bar(2, -30.0)], [bar(2), bar(3), bar(0, 50.0)], [bar(i) for i in range(4, 15)] + [bar(3, symbol="y")], [bar(14, 9.0)], [bar(15), bar(14)], [bar(i) for i in range(16, 24)]]


def seen(parts):
    """The bars as they stand: of each symbol and time the last that was not late when it came."""
    held = {}
    for part in parts:
        for row in sorted(part, key=lambda r: r[1]):
            last = max((t for s, t in held if s == row[0]), default=-1)
            if row[1] >= last:
                held[row[0], row[1]] = row
    return list(held.values())


def plain(df):
    return sorted((r["symbol"], *(round(r[c], 6) for c in ("time", "open", "high", "low", "close"))) for r in df.collect())


@pytest.mark.parametrize("make, draw, batch", [(live.live_renko, derived.renko_of, derived.renko), (live.live_figure, derived.figure_of, derived.point_and_figure)])
def test_charts_by_price_equal_the_batch_at_every_prefix(spark, tmp_path, make, draw, batch):
    folder, kept, box = str(tmp_path / "out"), live.into_steps(str(tmp_path / "out")), 1.5
    states, number = [], [0]

    def run(rows, k):
        kept(rows, k)
        kept(rows, k)  # a retry
        number[0] += 1
        states.append(plain(draw(live.held(spark, folder), box)))

    stream = make(feed(spark, str(tmp_path / "in"), [spark.createDataFrame(p, BAR) for p in PARTS], BAR), box)
    q = stream.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", str(tmp_path / "mark")).start()
    q.processAllAvailable()
    q.stop()
    assert number[0] >= len(PARTS)
    for k in range(len(PARTS)):
        assert states[k] == plain(batch(spark.createDataFrame(seen(PARTS[: k + 1]), BAR), box)), k
    assert len(states[len(PARTS) - 1]) >= 4


TRADE = "symbol string, ts timestamp, price double, volume double, id long"


def test_session_bars_close_with_their_sessions_over_a_clock_change(spark, tmp_path):
    schedule = calendar.Schedule("America/New_York", (calendar.SessionRule("pre", (1, 2, 3, 4, 5), "08:00", "09:30", "pre"), calendar.SessionRule("main", (1, 2, 3, 4, 5), "09:30", "16:00")))
    table = calendar.sessions(spark, schedule, "2024-03-07", "2024-03-13")
    at = lambda day, hour, minute=0: datetime(2024, 3, day, hour, minute, tzinfo=ZoneInfo("America/New_York"))
    times = [at(8, 8), at(8, 9, 29), at(8, 9, 30), at(8, 15, 59), at(8, 16), at(9, 12), at(11, 9, 0), at(11, 9, 30), at(11, 15, 30), at(12, 10)]
    trades = [("x", t, float(k), 1.0, k) for k, t in enumerate(times)] + [("y", at(11, 10), 50.0, 2.0, 99)]
    late = [("x", at(8, 12), 999.0, 1.0, 100)]
    made = lambda rows: spark.createDataFrame([(s, int(t.timestamp()), *r) for s, t, *r in rows], "symbol string, t long, price double, volume double, id long").select("symbol", F.timestamp_seconds("t").alias("ts"), "price", "volume", "id")
    parts = [made(trades[:6]), made(trades[6:9] + trades[10:]), made(late), made(trades[9:10])]
    stream = live.live_session_bars(feed(spark, str(tmp_path / "in"), parts, TRADE), table, lateness="10 seconds")
    got = finish(stream, "session_windows", "append").orderBy("symbol", "session_open").collect()
    bars = [(r["symbol"], r["session"], r["open"], r["high"], r["low"], r["close"], r["trade_count"]) for r in got]
    assert bars == [("x", "2024-03-08/pre", 0, 1, 0, 1, 2), ("x", "2024-03-08/main", 2, 3, 2, 3, 2), ("x", "2024-03-11/pre", 6, 6, 6, 6, 1), ("x", "2024-03-11/main", 7, 8, 7, 8, 2), ("y", "2024-03-11/main", 50, 50, 50, 50, 1)]
    assert got[1]["session_open"] == int(at(8, 9, 30).timestamp()) and got[3]["session_open"] - got[1]["session_open"] == 3 * 86400 - 3600
    batch = live.live_session_bars(made(trades), table).where("session <> '2024-03-12/main'").orderBy("symbol", "session_open").collect()
    assert [tuple(r) for r in batch] == [tuple(r) for r in got]
