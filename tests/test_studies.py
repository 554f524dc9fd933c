"""Plans on live bars equal the batch, whatever comes in between: previews, retries, corrections, expiry."""

import math
import random

import pytest
from test_oracles import BARS
from test_streaming import feed

from tickloom.plans.run import indicators
from tickloom.streaming.studies import LiveStudy

SCHEMA = "symbol string, time long, open double, high double, low double, close double, volume double, version long"
#: Of every tier: projections, lags, windows with a bound and by a flag, running totals, averages, recurrences, machines.
NAMES = ["medianprice", "roc", "bb", "mfi", "chop", "kst", "vwap", "obv", "cmf", "twap", "ema", "macd", "adx", "rsi", "kama", "vidya", "nvi", "supertrend", "psar", "aroon", "kalman", "psy"]
SMALL = {"kst": {"roc1Length": 2, "roc2Length": 3, "roc3Length": 4, "roc4Length": 5, "sma1Length": 3, "sma2Length": 3, "sma3Length": 3, "sma4Length": 3, "signalLength": 3}, "macd": {"fastLength": 4, "slowLength": 7, "signalLength": 3}, "psar": {}, "kama": {"length": 5}}
WITH_LENGTH = {"bb", "mfi", "chop", "cmf", "ema", "adx", "rsi", "vidya", "supertrend", "aroon", "kalman", "psy"}
ASKED = {n: (n, SMALL.get(n, {"length": 6} if n in WITH_LENGTH else {})) for n in NAMES}


def bar(symbol, i, version=1, lift=0.0):
    b = BARS[i]
    return (symbol, 60 * i, *(b[k] if b[k] is None else b[k] + lift * (k != "volume") for k in ("open", "high", "low", "close", "volume")), version)


def alike(got, want):
    assert got.keys() == want.keys()
    for key, row in want.items():
        for x, y in zip(got[key], row, strict=True):
            assert x == y or (x is not None and y is not None and abs(x - y) <= 1e-9 * max(1.0, abs(y))), key


def held(df, outputs):
    return {(r["symbol"], r["time"]): tuple(r[c] for c in outputs) for r in df.collect()}


def batch_of(spark, rows, asked):
    return indicators(spark.createDataFrame([r[:7] for r in rows], SCHEMA.removesuffix(", version long")), asked)


def test_a_stream_equals_the_batch_and_previews_leave_no_trace(spark, tmp_path):
    n = 58
    parts = [
        [bar("x", i) for i in range(20)] + [bar(None, i) for i in range(3)] + [bar("x", 19, 0, 70.0)],
        [bar("x", 19, 2, 30.0), bar("x", 19, 3), bar("x", 4, 9, 99.0), bar("", 0)],  # a preview's revisions in any order, and a late bar
        [bar("x", i) for i in range(20, 44)] + [bar("x", 44, 1, 55.0), bar(None, 3)],
        [bar("x", i, 2) for i in range(44, n)] + [bar("x", n, 1, 40.0), bar("y", 0)],
    ]
    study = LiveStudy(spark, str(tmp_path / "study"), ASKED, buckets=2)
    stream = feed(spark, str(tmp_path / "in"), [spark.createDataFrame(p, SCHEMA) for p in parts], SCHEMA)
    query = stream.writeStream.foreachBatch(study.run).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    query.processAllAvailable()
    query.stop()
    got = study.results()
    last = {(r["symbol"], r["time"]): r["final"] for r in got.collect()}
    assert not last["x", 60 * n] and last["x", 60 * (n - 1)] and not last[None, 180] and last[None, 120] and not last["", 0]
    # finals and previews alike are what a batch gives that ends with them
    rows = [bar("x", i) for i in range(n)] + [bar("x", n, 1, 40.0)] + [bar(None, i) for i in range(4)] + [bar("", 0), bar("y", 0)]
    alike(held(got, study.outputs), held(batch_of(spark, rows, ASKED), study.outputs))


@pytest.fixture
def small(spark, tmp_path):
    asked = {n: ASKED[n] for n in ("bb", "obv", "ema", "vidya", "aroon")}
    return LiveStudy(spark, str(tmp_path / "study"), asked, buckets=1, keep=4), asked


def test_a_retry_gives_the_same_and_state_stays_small(spark, small):
    study, asked = small
    sizes = []
    for k in range(6):
        rows = spark.createDataFrame([bar("x", i) for i in range(10 * k, 10 * k + 10)], SCHEMA)
        for _ in range(2 if k == 3 else 1):
            study.run(rows, k)
        sizes.append(study._state({0: study.versions(0)[-1:]}).count())
    alike(held(study.results(), study.outputs), held(batch_of(spark, [bar("x", i) for i in range(60)], asked), study.outputs))
    # a preview, the rows that windows look back on, and those by a flag: no more however long the stream
    assert max(sizes) <= 1 + 6 + 2 * 6 and len(study.versions(0)) == 4
    study.compact()
    assert len(study._named("out", "version")) == 1 and study.results().count() == 60
    # previews go, symbols that are long silent too
    study.discard()
    assert study._state({0: study.versions(0)[-1:]}).where("NOT _final").count() == 0
    study.expire(60 * 60)
    assert study._state({0: study.versions(0)[-1:]}) is None
    # a symbol that comes again starts anew
    study.run(spark.createDataFrame([bar("x", i) for i in range(60, 70)], SCHEMA), 6)
    again = {k: v for k, v in held(study.results(), study.outputs).items() if k[1] >= 3600}
    alike(again, held(batch_of(spark, [bar("x", i) for i in range(60, 70)], asked), study.outputs))


def test_corrections_go_on_from_a_checkpoint(spark, small):
    study, asked = small
    study.keep = 9
    rows = [bar(s, i) for s in ("x", "y") for i in range(40)]
    for k in range(4):
        study.run(spark.createDataFrame([r for r in rows if 600 * k <= r[1] < 600 * (k + 1)], SCHEMA), k)
    for at, lift in ((25, 7.0), (22, -3.0), (24, 2.0)):
        fixed = bar("x", at, 5, lift)
        rows = [fixed if r[:2] == fixed[:2] else r for r in rows]
        # what is before the checkpoint (bars up to 18 are final at the end of the second batch) is not read
        history = spark.createDataFrame([r if r[1] > 60 * 18 else (*r[:2], *[math.pi] * 5, 1) for r in rows if r[1] < 60 * 39], SCHEMA)
        study.correct(history, spark.createDataFrame([fixed], SCHEMA))
        alike(held(study.results(), study.outputs), held(batch_of(spark, rows, asked), study.outputs))
    study.run(spark.createDataFrame([bar("x", 40), bar("x", 41), bar("y", 40)], SCHEMA), 4)
    rows += [bar("x", 40), bar("x", 41), bar("y", 40)]
    alike(held(study.results(), study.outputs), held(batch_of(spark, rows, asked), study.outputs))


def test_a_correction_without_a_checkpoint_reads_from_the_start(spark, small):
    study, asked = small
    rng = random.Random(1)
    rows = [bar("x", i) for i in range(24)]
    study.run(spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA), 0)
    fixed = bar("x", 3, 5, 7.0)
    study.correct(spark.createDataFrame(rows[:23], SCHEMA), spark.createDataFrame([fixed], SCHEMA))
    rows[3] = fixed
    alike(held(study.results(), study.outputs), held(batch_of(spark, rows, asked), study.outputs))
