"""Series cut into stretches give what whole series give, and use more tasks than there are symbols."""

import pytest
from pyspark.sql import functions as F
from test_oracles import BARS

from tickloom.operators.indicators import REGISTRY
from tickloom.operators.stretches import long_symbols, numbered
from tickloom.plans.run import combined, indicator, indicators, run_plan
from tickloom.plans.stages import Bounded, Running, reach, staged

#: Windows with a bound, running totals, averages, recurrences, machines; several at a time, as one plan.
TOGETHER = ["bb macd adx psar smma", "kama tsi obv vwap twap nvi", "connorsrsi tmf massindex", "cmf alf vidya psy vma"]


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(s, 60 * i + (900 if i > 100 else 0), *(b[k] for k in ("open", "high", "low", "close", "volume"))) for s, some in (("long", BARS), ("short", BARS[:9])) for i, b in enumerate(some)]
    return spark.createDataFrame(rows, "symbol string, time long, open double, high double, low double, close double, volume double").repartition(3).cache()


def alike(parts, whole):
    whole = {(r["symbol"], r["time"]): r for r in whole.collect()}
    parts = parts.collect()
    assert len(parts) == len(whole)
    for r in parts:
        for x, y in zip(r, whole[r["symbol"], r["time"]], strict=True):
            assert x == y or abs(x - y) <= 1e-9 * max(1.0, abs(y))


@pytest.mark.parametrize("names", TOGETHER)
def test_stretches_equal_whole_series(bars, names):
    asked = {n: (n, {}) for n in names.split()}
    alike(indicators(bars, asked, long_symbols(bars, 25), 25), indicators(bars, asked))


def test_one_indicator_in_stretches(bars):
    alike(indicator(bars, "ema", long=long_symbols(bars, 25), span=25), indicator(bars, "ema"))


def test_a_burst_is_spread_evenly(spark):
    # nearly all rows in a hundredth of the time
    times = F.when(F.col("id") < 500, F.col("id") * 1000).otherwise(F.lit(500_000) + F.col("id"))
    bars = spark.range(20_000).select(F.lit("s").alias("symbol"), times.alias("time"), *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")))
    rows = numbered(bars, long_symbols(bars, 1000), 1000)
    sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
    assert len(sizes) == 20 and set(sizes) == {1000}
    assert rows.where("i <> (CASE WHEN time < 500000 THEN time / 1000 ELSE time - 500000 END)").count() == 0
    bounds = long_symbols(bars, 1000).first()["_bounds"]
    assert len(bounds) > 200 and long_symbols(bars, 20_000).count() == 0


def test_running_totals_of_a_long_symbol_use_many_tasks(bars):
    plan = indicator(bars, "vwap", long=long_symbols(bars, 25), span=25)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "currentrow" in line and "sum(" in line]
    assert windows and all("_part" in line for line in windows)


def test_building_a_plan_starts_no_job(spark, bars):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "none", False)
    try:
        long = long_symbols(bars, 25)
        indicator(bars, "ema", long=long, span=25)
        indicator(bars, "macd")
        indicator(bars, "bb", source="hl2")
        indicators(bars, {"a": ("adx", {}), "b": ("vwap", {})})
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_projection_runs_on_a_stream(spark, tmp_path):
    schema = "symbol string, time long, open double, high double, low double, close double, volume double"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path))
    assert indicator(stream, "medianprice").isStreaming


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_every_plan_has_stages_and_one_that_is_combined(name):
    for plan in (REGISTRY[name].plan(), combined({"x": (name, {})})):
        for stage in staged(plan):
            if isinstance(stage, Bounded):
                assert "UNBOUNDED" not in " ".join(stage.columns.values())
            elif isinstance(stage, Running):
                assert all(" OVER " not in argument for _, argument in stage.columns.values())


def test_stages_give_what_the_steps_give(bars):
    # one stretch for everything: only the splitting of texts is at work
    asked = {n: (n, {}) for n in ("vma", "stc", "obv", "psy")}
    alike(run_plan(bars, combined(asked), long_symbols(bars, 10**6), 10**6), indicators(bars, asked))


def test_reach_of_texts():
    assert reach("close") == {"": 0}
    assert reach("lag(close, 3) OVER (PARTITION BY symbol ORDER BY time) + avg(x) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)") == {"": 8}
    assert reach("sum(x) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)") is None
    assert reach("lag(x, 2) OVER (PARTITION BY symbol, ok ORDER BY time)") == {"": 0, "ok": 2}
    assert reach("row_number() OVER (PARTITION BY symbol ORDER BY time)") is None


def test_folds_behind_windows_by_a_flag_are_in_order(bars):
    # Spark puts windows by symbol below those by symbol and flag; the folds must still see the rows by time
    together = indicators(bars, {"k": ("kst", {}), "c": ("chop", {}), "e": ("rsi", {})})
    alike(together.select("symbol", "time", "e_value"), indicator(bars, "rsi"))
