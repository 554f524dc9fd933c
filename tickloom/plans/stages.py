"""Plans as stages that can go on from what came before.

A plan's steps mix windows with a bound, windows from the start of the series, and folds. For long symbols and for live
series these are told apart: `Running` has aggregates from the start, each of which goes on from its last value;
`Bounded` has everything else, which needs some rows before; folds go on from their state.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tickloom.operators.folds import Fold
from tickloom.operators.indicators import Plan
from tickloom.operators.windows import ORDER, RUNNING

OVER = re.compile(r" OVER \(PARTITION BY symbol(?:, (\w+))? ORDER BY time(?: ROWS BETWEEN (\w+) PRECEDING AND (?:CURRENT ROW|(\d+) PRECEDING))?\)")


@dataclass(frozen=True)
class Running:
    """Aggregates of all rows so far, by name: (function, argument). The function `row` is the number of the row, from 0."""

    columns: dict[str, tuple[str, str]]


@dataclass(frozen=True)
class Bounded:
    """Columns by text, and how many rows they look back on: in the series, and by flag among the rows that have it alike."""

    columns: dict[str, str]
    back: dict[str, int]


Stage = Running | Bounded | list[Fold]


def text_of(item: str | tuple[str, str], dialect: int) -> str:
    """The text for Spark (0) or DuckDB (1), which puts IGNORE NULLS inside."""
    text = item if isinstance(item, str) else item[dialect]
    return re.sub(r"last_value\((\w+)\) IGNORE NULLS", r"last_value(\1 IGNORE NULLS)", text) if dialect else text


def numbered(texts: list[str]) -> bool:
    """Whether a text uses `i`, the number of the row within its symbol."""
    return any(re.search(r"\bi\b", t) for t in texts)


def reach(text: str) -> dict[str, int] | None:
    """How many rows the windows of a text look back on, by the flag they go by ("" for all rows); None where one has no bound."""
    most = {"": 0}
    for m in OVER.finditer(text):
        lag = re.search(r", (\d+)\)$", text[: m.start()])
        rows = int(m[2]) if m[2] and m[2].isdigit() else int(lag[1]) if lag and not m[2] else None
        if rows is None:
            return None
        most[m[1] or ""] = max(rows, most.get(m[1] or "", 0))
    return most


def _call(text: str, end: int) -> tuple[int, str, str]:
    """The call that ends at `end`: where it begins, the function, its argument."""
    depth, at = 0, end - 1
    while True:
        depth += {")": 1, "(": -1}.get(text[at], 0)
        if not depth:
            break
        at -= 1
    name = re.search(r"\w+$", text[:at])[0]
    return at - len(name), name, text[at + 1 : end - 1]


def _without_running(text: str, found: dict[tuple[str, str], str]) -> str:
    """The text with aggregates from the start as columns, whose names are put into `found`."""
    for m in reversed([m for m in OVER.finditer(text) if m[2] == "UNBOUNDED"]):
        call, nulls = text[: m.start()], ""
        if call.endswith(" IGNORE NULLS"):
            call, nulls = call.removesuffix(" IGNORE NULLS"), " IGNORE NULLS"
        start, name, argument = _call(call, len(call))
        value = lambda fn: (lambda c: f"lag({c}, 1) OVER {ORDER}" if m[3] else c)(found.setdefault((fn, argument), f"_run{len(found)}"))  # noqa: B023, E731
        held = f"({value('sum')} / nullif({value('count')}, 0))" if name == "avg" else value(name + nulls)
        text = text[:start] + held + text[m.end() :]
    return text


def staged(plan: Plan) -> list[Stage]:
    """The plan's steps as stages; a first one numbers the rows where a text needs it."""
    texts = [{k: text_of(v, 0) for k, v in step.items()} if isinstance(step, dict) else step for step in plan.steps]
    out: list[Stage] = [Running({"i": ("row", "")})] if numbered([t for step in texts if isinstance(step, dict) for t in step.values()]) else []
    found: dict[tuple[str, str], str] = {}
    for step in texts:
        if not isinstance(step, dict):
            out.append(step)
            continue
        before = len(found)
        columns = {k: _without_running(t, found) for k, t in step.items()}
        fresh = dict(list(found.items())[before:])
        if fresh:
            out.append(Running({name: key for key, name in fresh.items()}))
        back: dict[str, int] = {}
        for text in columns.values():
            own = reach(text)
            if own is None:
                raise ValueError(f"no bound and no running aggregate: {text}")
            back = {k: max(back.get(k, 0), own.get(k, 0)) for k in {*back, *own}}
        out.append(Bounded(columns, back))
    return out


def aggregate(function: str, argument: str = "", over: str = RUNNING) -> str:
    """The text of a running aggregate."""
    if function == "row":
        return f"row_number() OVER {ORDER} - 1"
    name, _, nulls = function.partition(" ")
    return f"{name}({argument}){' ' + nulls if nulls else ''} OVER {over}"
