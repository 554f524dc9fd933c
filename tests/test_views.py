"""Views of the tail equal a rebuild after random edits, and read no more of the log than they touch."""

import random

from pyspark.sql import functions as F

from tickloom.functions.resample import resample
from tickloom.operators.orderflow import tick_of
from tickloom.streaming.views import LiveViews

SCHEMA = "symbol string, time long, open double, high double, low double, close double, volume double, version long, deleted boolean"


def rows_of(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def rebuilt(spark, held):
    bars = spark.createDataFrame([r[:7] for r in held.values() if not r[8]], SCHEMA.split(", version")[0])
    levels = bars.where("close is not null and volume is not null").groupBy("symbol", tick_of("close", 0.5).alias("tick")).agg(F.sum("volume"), F.count("*"))
    return rows_of(resample(bars, 100).select("symbol", "time", "open", "high", "low", "close", "volume")), rows_of(levels)


def test_views_equal_a_rebuild_after_random_edits(spark, tmp_path):
    rng, views, held, at = random.Random(5), LiveViews(spark, str(tmp_path), 100, 0.5, stretch=2), {}, 0
    for number in range(5):
        batch = []
        for _ in range(12):
            # mostly the tail: new bars, revisions of the last ones, bars taken back, and now and then an old one
            time = at if rng.random() < 0.5 else max(0, at - 20 * rng.choice([0, 1, 2, 9]))
            at += 20 * (time == at)
            price = float(rng.randint(10, 14))
            row = (rng.choice(["x", "x", None, ""]), time, price, price + 1, price - 1, price if rng.random() < 0.9 else None, rng.choice([1.0, 2.5, None]), 10 * number + rng.randint(0, 3), rng.random() < 0.15)
            batch.append(row)
        for row in sorted(batch, key=lambda r: r[7]):
            if row[:2] not in held or (row[7], number) >= (held[row[:2]][7], held[row[:2]][9]):
                held[row[:2]] = (*row, number)
        # rows of one batch with one bar and one version would be a tie
        batch = list({(r[0], r[1]): r[:9] for r in held.values() if r[9] == number}.values())
        for _ in range(2 if number == 3 else 1):
            views.run(spark.createDataFrame(batch, SCHEMA), number)
        want = rebuilt(spark, held)
        assert rows_of(views.bars()) == want[0] and rows_of(views.profile()) == want[1]


def test_only_touched_stretches_are_read(spark, tmp_path):
    views = LiveViews(spark, str(tmp_path), 100, 0.5, stretch=2)
    bar = lambda t, v=1, x=1.0: ("x", t, x, x, x, x, 1.0, v, False)
    views.run(spark.createDataFrame([bar(t) for t in range(0, 2000, 20)], SCHEMA), 0)
    for old in (tmp_path / "log" / "batch=0").glob("stretch=[0-7]"):
        for part in old.glob("*.parquet"):
            part.write_bytes(b"not to be read")
    views.run(spark.createDataFrame([bar(1980, 2, 5.0), bar(2000)], SCHEMA), 1)
    last = views.bars().orderBy(F.desc("time")).limit(2).collect()
    assert [(r["time"], r["close"], r["volume"]) for r in last] == [(2000, 1.0, 1.0), (1900, 5.0, 5.0)]
    assert sorted((r["tick"], r["volume"]) for r in views.profile().collect()) == [(2, 100.0), (10, 1.0)]
