import math

import pytest
from pyspark.sql import functions as F

from tickloom.operators.folds import Average
from tickloom.operators.indicators import find
from tickloom.plans.run import indicator
from tickloom.streaming import live

TRADE = "symbol string, ts timestamp, price double, volume double, aggressor_side string, id long"


def feed(spark, folder, parts, schema):
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def finish(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.sql(f"select * from {name}")


def trade_rows(spark, seconds):
    return spark.createDataFrame([("x", t, 100.0 + t % 7, 1.0 + t % 3, "buy" if t % 2 else "sell", t) for t in seconds], "symbol string, t long, price double, volume double, aggressor_side string, id long").select("symbol", F.timestamp_seconds("t").alias("ts"), "price", "volume", "aggressor_side", "id")


def test_closed_bars_equal_the_batch(spark, tmp_path):
    parts = [trade_rows(spark, range(a, a + 50)) for a in (0, 50, 100, 150)]
    got = finish(live.live_bars(feed(spark, str(tmp_path / "in"), parts, TRADE), "30 seconds", "0 seconds"), "closed_bars", "append").toPandas()
    assert len(got) >= 4 and got["start"].is_unique
    first = got.sort_values("start").iloc[0]
    prices = [100.0 + t % 7 for t in range(30)]
    assert (first["open"], first["high"], first["low"], first["close"]) == (prices[0], max(prices), min(prices), prices[-1])


def test_footprints_count_an_id_once(spark, tmp_path):
    part = trade_rows(spark, range(960, 980))
    got = finish(live.live_footprint(feed(spark, str(tmp_path / "in"), [part, part], TRADE), "60 seconds", 1.0), "live_levels", "update").toPandas()
    last = got.groupby(["symbol", "start", "tick"]).last()
    assert last["trade_count"].sum() == 20


@pytest.mark.parametrize("study, name", [(Average("value", "close", 5, "strict"), "ema"), (find("aroon").plan(length=5).steps[-1][0], "aroon")])
def test_stream_equals_batch_and_previews_do_not_count(spark, tmp_path, study, name):
    schema = "symbol string, time long, open double, high double, low double, close double, volume double"
    bar = lambda i, lift=0.0: ("x", 60 * i, *[100 + 5 * math.sin(i / 3) + d + lift for d in (0.0, 1.0, -1.0, 0.5)], 1.0)
    parts = [[bar(i) for i in range(8)] + [bar(8, 50.0)], [bar(8)], [bar(2, 99.0), bar(9)], [bar(i) for i in range(10, 16)]]
    stream = feed(spark, str(tmp_path / "in"), [spark.createDataFrame(p, schema) for p in parts], schema)
    got = finish(live.live_study(stream, study), f"study_{name}", "update").toPandas()
    final = got[got["final"]].drop_duplicates("time", keep="last").sort_values("time")
    batch = indicator(spark.createDataFrame([bar(i) for i in range(16)], schema), name, length=5).orderBy("time").toPandas()
    for out in study.outs:
        want = batch[out].tolist()[: len(final)]
        assert final[out].tolist() == pytest.approx(want, nan_ok=True)
    assert len(final) == 15


def test_upserts_survive_a_second_run_and_corrections_recompute(spark, tmp_path):
    schema = "symbol string, time long, close double, version long"
    run, folder = live.upsert_into(str(tmp_path / "out")), str(tmp_path / "out")
    batches = [[("x", 0, 1.0, 1), ("x", 60, 2.0, 1)], [("x", 60, 3.0, 2), ("x", 120, 4.0, 1)]]
    for k, b in enumerate(batches):
        for _ in range(2):
            run(spark.createDataFrame(b, schema), k)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "out" / "table").glob("_symbol=x/*/*.parquet")}
    run(spark.createDataFrame([("y", 7, 9.0, 1)], schema), 0)  # a new checkpoint goes on, and x is not touched
    assert files == {f: f.stat().st_mtime_ns for f in (tmp_path / "out" / "table").glob("_symbol=x/*/*.parquet")}
    kept = live.held(spark, folder).where("symbol = 'x'")
    assert sorted((r["time"], r["close"]) for r in kept.collect()) == [(0, 1), (60, 3), (120, 4)]
    study = lambda bars: bars.select("symbol", "time", F.expr("sum(close) OVER (PARTITION BY symbol ORDER BY time)").alias("s"))
    fixed = live.corrected(kept, spark.createDataFrame([("x", 60, 30.0, 9)], schema), study)
    assert sorted((r["time"], r["s"]) for r in fixed.collect()) == [(60, 31), (120, 35)]


def test_upserts_keep_symbols_that_are_null_or_empty(spark, tmp_path):
    schema = "symbol string, time long, close double, version long"
    run, folder = live.upsert_into(str(tmp_path / "out")), str(tmp_path / "out")
    batches = [[(s, t, 1.0, 1) for s in (None, "", "x") for t in (0, 60)], [(s, t, 2.0, 2) for s in (None, "") for t in (60, 120)]]
    for k, b in enumerate(batches):
        run(spark.createDataFrame(b, schema), k)
    got = {(r["symbol"], r["time"]): r["close"] for r in live.held(spark, folder).collect()}
    assert got == {(s, t): 1.0 for s in (None, "", "x") for t in (0, 60)} | {(s, t): 2.0 for s in (None, "") for t in (60, 120)}


def test_revisions_of_one_bar_go_by_version(spark, tmp_path):
    schema = "symbol string, time long, close double, version long"
    parts = [[("x", 0, 5.0, 3), ("x", 0, 1.0, 1), ("x", 0, 3.0, 2), ("x", 60, 7.0, 1)]]
    stream = feed(spark, str(tmp_path / "in"), [spark.createDataFrame(p, schema) for p in parts], schema)
    got = finish(live.live_study(stream, Average("value", "close", 1, "grow")), "by_version", "update").toPandas()
    assert got[got["time"] == 0]["value"].tolist() == [5.0]
