import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators.folds import Linear, fold
from tickloom.operators.stretches import folded, long_symbols, numbered
from tickloom.sources import tables


def test_bars_come_back_under_their_schema(spark, tmp_path):
    bars = spark.createDataFrame([("x", 86400 * 20 * i, 1.0, 2.0, 0.5, 1.5, None) for i in range(6)], tables.BARS)
    tables.write(bars, str(tmp_path / "bars"))
    back = tables.read(spark, str(tmp_path / "bars")).select(bars.columns)
    assert sorted(back.collect()) == sorted(bars.collect())
    plan = tables.read(spark, str(tmp_path / "bars"), tables.BARS + ", span long").where("span = 1 and time > 5").select("close")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(span" in plan and "PushedFilters: [IsNotNull(time)" in plan
    bad = spark.createDataFrame([("x", 1, 1.0, 0.5, 0.5, 1.0, 1.0), ("x", 2, 1.0, None, 1.0, 1.0, 1.0), (None, 3, 1.0, 1.0, 1.0, 1.0, 1.0), ("x", 4, 1.0, 1.0, 1.0, 1.0, -1.0), ("x", 5, 1.0, 1.0, 1.0, 1.0, 0.0)], tables.BARS)
    assert tables.faulty(bad).count() == 4
    meta = spark.createDataFrame([("x", "X", "UTC", 0.01, 1.0)], tables.SYMBOLS)
    assert tables.with_symbol(bars, meta).where("tick = 0.01").count() == 6


def test_two_pass_scan_equals_the_fold(spark):
    rng = np.random.default_rng(1)
    rows = [(s, t, float(rng.uniform(0.5, 1.0)) if t % 17 else None, float(rng.normal())) for s in ("x", "y") for t in range(200)]
    df = spark.createDataFrame(rows, "symbol string, time long, a double, b double")
    want = {(r["symbol"], r["time"]): r["y"] for r in fold(df, [Linear("y", "a", "b")]).collect()}
    got = {(r["symbol"], r["time"]): r["y"] for r in folded(numbered(df, long_symbols(df, 30), 30), [Linear("y", "a", "b")]).collect()}
    assert got.keys() == want.keys() and all(got[k] == (None if v is None else pytest.approx(v)) for k, v in want.items())
    none = df.where(F.lit(False))
    assert folded(numbered(none, long_symbols(none, 30), 30), [Linear("y", "a", "b")]).count() == 0
