"""Running indicator plans on Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import lifted
from tickloom.operators.folds import fold
from tickloom.operators.indicators import Plan, find
from tickloom.operators.stretches import SPAN, numbered, run_stages
from tickloom.plans import stages
from tickloom.plans.stages import staged, text_of

BARS = ["symbol", "time", "open", "high", "low", "close", "volume"]


def clean(bars: DataFrame, *others: str) -> DataFrame:
    """Bars, and other columns, with NaN and infinite numbers of the bars as nulls."""
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in BARS[2:]}
    return bars.select("symbol", "time", *(F.col(c).cast("double").alias(c) for c in BARS[2:]), *others).withColumns(finite)


def run_plan(bars: DataFrame, plan: Plan, long: DataFrame | None = None, span: int = SPAN) -> DataFrame:
    """symbol, time and the plan's outputs, one row a bar. Building the plan starts no job.

    All steps share one partitioning by symbol. With `long` (see `stretches.long_symbols`) the symbols in it are spread
    over stretches of `span` rows; plans with several folds or running totals are then written in between.
    """
    rows = clean(bars)
    if long is not None:
        out = run_stages(numbered(rows, long, span), staged(plan), span)
    else:
        texts = [text_of(v, 0) for step in plan.steps if isinstance(step, dict) for v in step.values()]
        out = rows.withColumn("i", F.expr(stages.aggregate("row"))) if stages.numbered(texts) else rows
        for step in plan.steps:
            out = out.withColumns({k: F.expr(text_of(v, 0)) for k, v in step.items()}) if isinstance(step, dict) else fold(out, step)
    return out.select("symbol", "time", *(F.col(v).alias(k) for k, v in plan.outputs.items()))


def sourced(bars: DataFrame, value: Column) -> DataFrame:
    """Bars that have `value` for all four prices; rows where it is missing are left out, not gaps."""
    number = value.cast("double")
    rows = bars.select("symbol", "time", number.alias("_value"), "volume").where(F.col("_value").isNotNull() & ~F.isnan("_value") & (F.abs("_value") < float("inf")))
    return rows.select("symbol", "time", *(F.col("_value").alias(c) for c in BARS[2:6]), "volume")


def indicator(bars: DataFrame, name: str, source: str | Column | None = None, long: DataFrame | None = None, span: int = SPAN, **params: float) -> DataFrame:
    """An indicator of the catalogue by name or alias, over bars keyed by symbol and time.

    With a `source` it reads that in place of prices: the name of a field (open, high, low, close, hl2, hlc3, ohlc4,
    volume), or a column of numbers, whose missing values are skipped and have nulls. `long` and `span`: see `run_plan`.
    """
    plan = find(name).plan(**params)
    if source is None:
        return run_plan(bars, plan, long, span)
    if isinstance(source, str):
        return run_plan(lifted(bars, source), plan, long, span)
    return bars.select("symbol", "time").join(run_plan(sourced(bars, source), plan, long, span), ["symbol", "time"], "left")


def chained(bars: DataFrame, *names: tuple[str, dict[str, float], str], long: DataFrame | None = None, span: int = SPAN) -> DataFrame:
    """Indicators of indicators: each (name, parameters, output) reads the output of the one before, the first the bars.

    The rows are those of `bars` with the outputs of the last; samples that an indicator lacks are skipped by the next.
    """
    out, rows = None, bars
    for k, (name, params, output) in enumerate(names):
        out = indicator(rows, name, long=long, span=span, **params)
        if k < len(names) - 1:
            if output not in out.columns:
                raise ValueError(f"{name} has no output {output}")
            rows = sourced(out.join(bars.select("symbol", "time", "volume"), ["symbol", "time"]), F.col(output))
    return bars.select("symbol", "time").join(out, ["symbol", "time"], "left")


def combined(asked: dict[str, tuple[str, dict[str, float]]]) -> Plan:
    """Several indicators as one plan with outputs `prefix_output`: their steps go side by side, folds meet in shared passes."""
    plans = {prefix: find(name).plan(**params) for prefix, (name, params) in asked.items()}
    made: dict[str, dict[str, str]] = {prefix: {} for prefix in plans}
    left = {prefix: list(plan.steps) for prefix, plan in plans.items()}
    steps: list = []
    while any(left.values()):
        # every plan goes on to its next folds, and these share one pass
        while any(own and isinstance(own[0], dict) for own in left.values()):
            columns = {}
            for prefix, own in left.items():
                if own and isinstance(own[0], dict):
                    step = own.pop(0)
                    columns |= {f"{prefix}__{x}": _renamed(text_of(v, 0), made[prefix]) for x, v in step.items()}
                    made[prefix] |= {x: f"{prefix}__{x}" for x in step}
            steps.append(columns)
        folds = []
        for prefix, own in left.items():
            if own:
                step = own.pop(0)
                outs = {x: f"{prefix}__{x}" for f in step for x in f.outs}
                folds += [f.renamed({**made[prefix], **outs}) for f in step]
                made[prefix] |= outs
        if folds:
            steps.append(folds)
    return Plan(steps, {f"{prefix}_{x}": _renamed(v, made[prefix]) for prefix, plan in plans.items() for x, v in plan.outputs.items()})


def indicators(bars: DataFrame, asked: dict[str, tuple[str, dict[str, float]]], long: DataFrame | None = None, span: int = SPAN) -> DataFrame:
    """Several indicators as columns `prefix_output` of one table: one sort, and one pass for each round of folds."""
    return run_plan(bars, combined(asked), long, span)


def _renamed(text: str, names: dict[str, str]) -> str:
    return re.sub(r"'[^']*'|\b[A-Za-z_]\w*\b", lambda m: names.get(m[0], m[0]), text) if names else text
