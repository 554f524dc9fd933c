"""The same plans as DuckDB SQL, to hold results against."""

from __future__ import annotations

from tickloom.operators.folds import Average, Linear
from tickloom.operators.indicators import Plan
from tickloom.operators.windows import RUNNING
from tickloom.plans.stages import text_of


def _average(a: Average, source: str) -> str:
    seen, taken = f"count({a.x}) OVER {RUNNING}", f"list({a.x}) FILTER (WHERE {a.x} IS NOT NULL) OVER {RUNNING}"
    first = f"list_sum(_l[1:{a.n}])"
    short = {"grow": f"{first} / least(_m, {a.n})", "partial": f"{first} / {a.n}", "smooth": f"{first} / {a.n}"}.get(a.start, "NULL")
    full = f"list_reduce(list_concat([{first} / {a.n}], _l[{a.n + 1}:]), lambda _y, _x: _y + {a.rate!r} * (_x - _y))"
    value = f"CASE WHEN {a.x} IS NULL THEN NULL WHEN _m < {a.n} THEN {short} ELSE {full} END"
    return f"SELECT * EXCLUDE (_l, _m), {value} AS {a.out} FROM (SELECT *, {taken} AS _l, {seen} AS _m FROM ({source}))"


def _linear(f: Linear, source: str) -> str:
    taken = f"list(struct_pack(a := CAST({f.a} AS DOUBLE), b := CAST({f.b} AS DOUBLE))) FILTER (WHERE {f.a} IS NOT NULL AND {f.b} IS NOT NULL) OVER {RUNNING}"
    end = "list_reduce(list_concat([struct_pack(a := 0.0::DOUBLE, b := 0.0::DOUBLE)], _l), lambda _y, _x: struct_pack(a := 0.0::DOUBLE, b := _x.a * _y.b + _x.b)).b"
    return f"SELECT * EXCLUDE (_l), CASE WHEN {f.a} IS NOT NULL AND {f.b} IS NOT NULL THEN {end} END AS {f.out} FROM (SELECT *, {taken} AS _l FROM ({source}))"


def plan_sql(plan: Plan, bars: str) -> str | None:
    """SQL over the query `bars`; None where a state machine has no SQL."""
    out = f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS i FROM ({bars})"
    for step in plan.steps:
        if isinstance(step, dict):
            out = f"SELECT *, {', '.join(f'{text_of(v, 1)} AS {k}' for k, v in step.items())} FROM ({out})"
            continue
        for f in step:
            if isinstance(f, Average):
                out = _average(f, out)
            elif isinstance(f, Linear):
                out = _linear(f, out)
            else:
                return None
    return f"SELECT symbol, time, {', '.join(f'{v} AS {k}' for k, v in plan.outputs.items())} FROM ({out})"
