"""Recursive averages and state machines along a series.

A fold needs every earlier bar of its symbol, so symbols are grouped and each is read in time order; all
folds of a step share one pass and one shuffle. A group comes as a stream of Arrow batches and each fold hands its
state from one to the next, so memory does not grow with a symbol. `resume` runs a fold over some rows from the state
that the rows before have left; batches, stretches of long symbols and live series all use it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tickloom.operators.machines import average
from tickloom.ship import by_group_in_arrow

#: Plain values that a fold keeps between rows.
State = dict
#: A fold's inputs by name; gaps are NaN.
Columns = dict[str, np.ndarray]


@dataclass(frozen=True)
class Average:
    """y += alpha (x - y) once n samples have seeded it; see `seeded` for the ways of starting."""

    out: str
    x: str
    n: int
    start: str
    alpha: float = 0.0

    @property
    def rate(self) -> float:
        return self.alpha or (2 / (self.n + 1) if self.start in ("mean", "strict", "partial") else 1 / self.n)

    @property
    def outs(self) -> dict[str, str]:
        return {self.out: "double"}

    def renamed(self, names: dict[str, str]) -> Average:
        return Average(names.get(self.out, self.out), names.get(self.x, self.x), self.n, self.start, self.alpha)

    def machine(self) -> Machine:
        return Machine(self.outs, average, (self.x,), {"n": self.n, "start": self.start, "rate": self.rate})

    @property
    def reads(self) -> tuple[str, ...]:
        return (self.x,)

    def resume(self, state: State, columns: Columns) -> dict[str, np.ndarray]:
        return {self.out: averaged(state, columns[self.x], self.n, self.start, self.rate)}


@dataclass(frozen=True)
class Linear:
    """y = a y + b, from zero. Where a or b is null the value is null and y stays as it was."""

    out: str
    a: str
    b: str

    @property
    def outs(self) -> dict[str, str]:
        return {self.out: "double"}

    def renamed(self, names: dict[str, str]) -> Linear:
        return Linear(*(names.get(x, x) for x in (self.out, self.a, self.b)))

    @property
    def reads(self) -> tuple[str, ...]:
        return (self.a, self.b)

    def resume(self, state: State, columns: Columns) -> dict[str, np.ndarray]:
        y, rows = state.get("y", 0.0), np.full(len(columns[self.a]), np.nan)
        ok = np.isfinite(columns[self.a]) & np.isfinite(columns[self.b])
        made = []
        for a, b in zip(columns[self.a][ok].tolist(), columns[self.b][ok].tolist(), strict=True):
            y = a * y + b
            made.append(y)
        rows[ok], state["y"] = made, y
        return {self.out: rows}


@dataclass(frozen=True)
class Machine:
    """A state machine: `advance(state, *values, **params)` changes the state, a dict of plain values, and
    returns the outputs in order, or None for a row of nulls. Streams keep the same state between batches."""

    outs: dict[str, str]
    advance: Callable[..., tuple | None]
    reads: tuple[str, ...]
    params: dict[str, float] = field(default_factory=dict)

    def renamed(self, names: dict[str, str]) -> Machine:
        return Machine({names.get(k, k): v for k, v in self.outs.items()}, self.advance, tuple(names.get(c, c) for c in self.reads), self.params)

    def resume(self, state: State, columns: Columns) -> dict[str, list]:
        inputs = ([None if not math.isfinite(v) else v for v in columns[c].tolist()] for c in self.reads)
        rows = [self.advance(state, *values, **self.params) or (None,) * len(self.outs) for values in zip(*inputs, strict=True)]
        return {name: [r[k] for r in rows] for k, name in enumerate(self.outs)}


Fold = Average | Linear | Machine


def averaged(state: State, x: np.ndarray, n: int, start: str, rate: float) -> np.ndarray:
    """A recursive average. Gaps (null, NaN, infinite) give NaN and, but for the strict kinds, no change.

    mean: null until n samples, whose mean is the first value. strict: the same, but the first n rows must
    all be there. fixed: strict, and a later gap ends the series (Wilder). partial, smooth: sum over n from
    the first sample on. grow: mean of the samples so far.
    """
    out, ok, seen = np.full(len(x), np.nan), np.isfinite(x), state.get("seen", 0)
    if n <= 0 or state.get("dead"):
        return out
    if start in ("strict", "fixed") and not ok.all():
        gap = int(np.argmin(ok))
        if start == "fixed" or seen + gap < n:
            state["dead"], ok[gap:] = True, False
    at, samples = np.flatnonzero(ok), x[ok]
    seeds = min(max(0, n - seen), len(samples))
    if seeds:
        sums = state.get("total", 0.0) + np.cumsum(samples[:seeds])
        means = sums / (seen + np.arange(1, seeds + 1) if start == "grow" else n)
        state["total"], state["y"] = float(sums[-1]), float(means[-1])
        if start in ("partial", "smooth", "grow"):
            out[at[:seeds]] = means
        elif seen + seeds == n:
            out[at[seeds - 1]] = means[-1]
    if len(samples) > seeds:
        # the recurrence runs in compiled code
        out[at[seeds:]] = pd.Series(np.concatenate([[state["y"]], samples[seeds:]])).ewm(alpha=rate, adjust=False).mean()[1:]
        state["y"] = float(out[at[-1]])
    state["seen"] = seen + len(samples)
    return out


def seeded(x: np.ndarray, n: int, start: str, rate: float) -> list[float | None]:
    """A whole series' `averaged` with None for NaN."""
    return [None if math.isnan(v) else v for v in averaged({}, x, n, start, rate).tolist()]


def inputs(batch: pa.RecordBatch, folds: list[Fold]) -> Columns:
    """The columns that folds read, gaps as NaN."""
    return {c: batch.column(c).cast(pa.float64()).fill_null(math.nan).to_numpy() for f in folds for c in f.reads}


def made(values: np.ndarray | list, kind: pa.DataType) -> pa.Array:
    """A fold's output as a column, NaN as null."""
    return pa.array(values, kind, mask=np.isnan(values)) if isinstance(values, np.ndarray) else pa.array(values, kind)


def with_outputs(schema: T.StructType, folds: list[Fold]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(name, T.DataType.fromDDL(kind)) for f in folds for name, kind in f.outs.items())])


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """df grouped in tasks by the keys and sorted by time, with each row's number in `_order`, which `checked` reads.

    The window deals out the rows; the sort is dropped by Spark where its order is there, but windows by other keys may have
    been put between.
    """
    return df.withColumn("_order", F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY time)")).sortWithinPartitions(*keys, "time")


def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of one group, which must be in order."""
    at = 0
    for batch in batches:
        order = batch.column("_order").to_numpy()
        if (order != np.arange(at + 1, at + 1 + len(order))).any():
            raise RuntimeError("the rows of a symbol are not in order")
        at += len(order)
        yield batch


def fold(df: DataFrame, folds: list[Fold]) -> DataFrame:
    """The rows of df (symbol, time, ...) with the outputs of all folds, one shuffle by symbol."""
    schema = with_outputs(df.schema, folds)
    kinds = {name: to_arrow_type(schema[name].dataType) for f in folds for name in f.outs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list[State] = [{} for _ in folds]
        for batch in checked(batches):
            columns = inputs(batch, folds)
            outs = {name: made(values, kinds[name]) for f, state in zip(folds, states, strict=True) for name, values in f.resume(state, columns).items()}
            yield pa.RecordBatch.from_arrays([outs[c] if c in outs else batch.column(c) for c in schema.names], names=schema.names)

    return by_group_in_arrow(in_order(df, "symbol"), ["symbol"], run, schema)
