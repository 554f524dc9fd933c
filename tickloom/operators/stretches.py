"""Long series in stretches: the same plans, with a symbol spread over many tasks.

`long_symbols` is a small table of the symbols with more than `span` rows and quantiles of their times. Rows of such a
symbol are numbered by the buckets that the quantiles make (a few counts for each symbol), so a burst of rows is as
even as a quiet time, and the numbers cut the series into stretches of `span` rows. Each kind of stage then runs in
stretches. Bounded windows take the rows before that they look back on. Running aggregates are taken twice: within each
stretch, and over the stretches' totals, whose earlier ones are put in front. Averages and linear recurrences reduce each
stretch to what it does to a state, chain the stretches and run each from its state. State machines and windows
that go by a flag need whole symbols: they read these as a stream, in one task a symbol.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.folds import Average, Columns, Fold, Linear, State, checked, fold, in_order, inputs, made, with_outputs
from tickloom.plans.stages import Bounded, Running, Stage, aggregate
from tickloom.session import written
from tickloom.ship import by_group, by_group_in_arrow

#: Rows of a symbol beyond which it is spread over stretches of so many.
SPAN = 2_000_000
#: Buckets of a long symbol.
BUCKETS = 256


def long_symbols(bars: DataFrame, span: int = SPAN) -> DataFrame:
    """symbol, _bounds: times between the buckets of each symbol with more than `span` rows.

    One pass over the table, with partial aggregates. Keep it as a table where several studies read the same bars; new rows
    make the buckets less even, not the results wrong.
    """
    cuts = F.percentile_approx("time", [k / BUCKETS for k in range(1, BUCKETS)], 10 * BUCKETS)
    return bars.groupBy("symbol").agg(cuts.alias("_bounds"), F.count("*").alias("_rows")).where(F.col("_rows") > span).drop("_rows")


def bucketed(rows: DataFrame, long: DataFrame) -> DataFrame:
    """rows with `_long`, whether their symbol is one of those, and `_bucket`, the number of its bucket of times (0 for others)."""
    rows = rows.join(long, "symbol", "left").withColumn("_long", F.col("_bounds").isNotNull())
    return rows.withColumn("_bucket", F.when(F.col("_long"), F.size(F.filter("_bounds", lambda b: b < F.col("time")))).otherwise(0)).drop("_bounds")


def numbered(bars: DataFrame, long: DataFrame, span: int) -> DataFrame:
    """bars with `i`, the number of the row in its symbol, `_part`, that of its stretch, and `_long`."""
    rows = bucketed(bars, long)
    counts = rows.where("_long").groupBy("symbol", "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("symbol").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(counts.select("symbol", "_bucket", before.alias("_before")), ["symbol", "_bucket"], "left")
    own = F.row_number().over(Window.partitionBy("symbol", "_bucket").orderBy("time")) - 1
    rows = rows.withColumn("i", own + F.coalesce("_before", F.lit(0))).drop("_bucket", "_before")
    return rows.withColumn("_part", F.when(F.col("_long"), F.floor(F.col("i") / span)).otherwise(0).cast("long"))


def run_stages(rows: DataFrame, stages: list[Stage], span: int) -> DataFrame:
    """Numbered rows with the columns of all stages.

    Running aggregates and folds read the rows twice. So that this does not double from one to the next, what the first
    of them gives is written to the checkpoint folder before another one reads it.
    """
    stages, twice = list(stages), False
    while stages:
        stage = stages.pop(0)
        if not isinstance(stage, Bounded) and not (isinstance(stage, Running) and list(stage.columns.values()) == [("row", "")]):
            rows, twice = written(rows) if twice else rows, True
        if isinstance(stage, Running):
            rows = running(rows, {k: v for k, v in stage.columns.items() if v[0] != "row"})
        elif isinstance(stage, Bounded):
            some = [stage]
            while not set(stage.back) - {""} and stages and isinstance(stages[0], Bounded) and not set(stages[0].back) - {""}:
                some.append(stages.pop(0))
            rows = bounded(rows, some, span)
        else:
            rows = folded(rows, stage)
    return rows


def bounded(rows: DataFrame, stages: list[Bounded], span: int) -> DataFrame:
    """Windows that look back some rows in all, each stretch with so many rows of those before it."""
    if set(stages[0].back) - {""}:
        return rows.withColumns({k: F.expr(v) for k, v in stages[0].columns.items()})
    back = sum(stage.back.get("", 0) for stage in stages)
    last = F.when(F.col("_long"), F.floor((F.col("i") + back) / span)).otherwise(0).cast("long")
    # past the series' end there is nothing to pad
    out = rows.withColumn("_at", F.explode(F.sequence("_part", last))) if back else rows.withColumn("_at", F.col("_part"))
    for stage in stages:
        out = out.withColumns({k: F.expr(v.replace("PARTITION BY symbol ORDER", "PARTITION BY symbol, _at ORDER")) for k, v in stage.columns.items()})
    return out.where("_at = _part").drop("_at")


def running(rows: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Aggregates from the start of the series: within each stretch, and what the stretches before it come to."""
    if not columns:
        return rows
    within = "(PARTITION BY symbol, _part ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    whole = {"last_value": "max_by({0}, CASE WHEN ({0}) IS NOT NULL THEN time END)", "first_value": "min_by({0}, time)"}
    earlier = "(PARTITION BY symbol ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    totals, carried, joined = [], [], {}
    for name, (function, argument) in columns.items():
        fn, own = function.split(" ")[0], f"_all{name}"
        totals.append(F.expr(whole.get(fn, fn + "({0})").format(argument)).alias(own))
        carried.append(F.expr(aggregate("sum" if fn == "count" else function, own, earlier)).alias(own))
        joined[name] = {
            "sum": f"CASE WHEN {own} IS NULL THEN {name} WHEN {name} IS NULL THEN {own} ELSE {own} + {name} END",
            "count": f"coalesce({own}, 0) + {name}",
            "max": f"greatest({own}, {name})",
            "min": f"least({own}, {name})",
            "last_value": f"coalesce({name}, {own})",
            "first_value": f"CASE WHEN _part > 0 THEN {own} ELSE {name} END",
        }[fn]
    before = rows.where("_long").groupBy("symbol", "_part").agg(*totals).select("symbol", "_part", *carried)
    local = rows.withColumns({name: F.expr(aggregate(*call, within)) for name, call in columns.items()})
    return local.join(before, ["symbol", "_part"], "left").withColumns({name: F.expr(text) for name, text in joined.items()}).drop(*(f"_all{name}" for name in columns))


def _reduced(f: Average | Linear, columns: Columns) -> dict:
    """What a stretch does to the state of a fold."""
    if isinstance(f, Linear):
        a, b = (columns[c] for c in f.reads)
        ok = np.isfinite(a) & np.isfinite(b)
        rate, add = 1.0, 0.0
        for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            rate, add = rate * x, x * add + y
        return {"rate": rate, "add": add}
    x = columns[f.x]
    ok = np.isfinite(x)
    seen = x[ok]
    head, rest = seen[: f.n].tolist(), seen[f.n :]
    # the rest starts from nothing: what it adds is its average, what is left of a state before it falls with its length
    rate, add = (1 - f.rate) ** len(rest), float(pd.Series(np.concatenate([[0.0], rest])).ewm(alpha=f.rate, adjust=False).mean().iloc[-1])
    # maps[j]: from after the first j samples to the end
    maps = [(rate, add)]
    for v in reversed(head):
        rate, add = rate * (1 - f.rate), add + rate * f.rate * v
        maps.append((rate, add))
    return {"samples": len(seen), "head": head, "maps": maps[::-1], "gap": int(np.argmin(ok)) if not ok.all() else None, "rows": len(x)}


def _chained(f: Average | Linear, state: State, done: dict) -> State:
    """The state after a stretch."""
    if isinstance(f, Linear):
        return {"y": done["rate"] * state.get("y", 0.0) + done["add"]}
    seen, dead = state.get("seen", 0), state.get("dead", False)
    strict = f.start in ("strict", "fixed")
    if done["gap"] is not None and (f.start == "fixed" or strict and seen + done["gap"] < f.n):
        dead = True
    if dead or f.n <= 0:
        return {"dead": True}
    out = {"seen": seen + done["samples"], "total": state.get("total", 0.0), "y": state.get("y", 0.0)}
    j = min(max(0, f.n - seen), len(done["head"]))
    if j:
        out["total"] += math.fsum(done["head"][:j])
        out["y"] = out["total"] / (seen + j if f.start == "grow" else f.n)
    if seen + j >= f.n:
        rate, add = done["maps"][j]
        out["y"] = rate * out["y"] + add
    return out


def folded(rows: DataFrame, folds: list[Fold]) -> DataFrame:
    """The outputs of folds over stretches; with a state machine among them, over whole symbols."""
    if not all(isinstance(f, Average | Linear) for f in folds):
        return fold(rows, folds)
    reads = sorted({c for f in folds for c in f.reads})

    def reduce_(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("time", kind="stable")
        columns = {c: part[c].to_numpy(float, na_value=np.nan) for c in reads}
        return pd.DataFrame({"symbol": [part["symbol"].iloc[0]], "_part": [part["_part"].iloc[0]], "_done": [pickle.dumps([_reduced(f, columns) for f in folds])]})

    def chain(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("_part", kind="stable")
        states, out = [{} for _ in folds], []
        for done in parts["_done"]:
            out.append(pickle.dumps(states))
            states = [_chained(f, s, d) for f, s, d in zip(folds, states, pickle.loads(done), strict=True)]
        return pd.DataFrame({"symbol": parts["symbol"], "_part": parts["_part"], "_state": out})

    steps = by_group(rows.where("_long").select("symbol", "time", "_part", *reads), ["symbol", "_part"], reduce_, "symbol string, _part long, _done binary")
    states = by_group(steps, ["symbol"], chain, "symbol string, _part long, _state binary")
    begun = rows.join(states, ["symbol", "_part"], "left").select(*rows.columns, "_state")
    schema = with_outputs(rows.schema, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = None
        for batch in checked(batches):
            if states is None:
                kept = batch.column("_state")[0].as_py()
                states = pickle.loads(kept) if kept is not None else [{} for _ in folds]
            columns = inputs(batch, folds)
            outs = {name: made(values, pa.float64()) for f, state in zip(folds, states, strict=True) for name, values in f.resume(state, columns).items()}
            yield pa.RecordBatch.from_arrays([outs[c] if c in outs else batch.column(c) for c in schema.names], names=schema.names)

    return by_group_in_arrow(in_order(begun, "symbol", "_part"), ["symbol", "_part"], run, schema)
