"""Window expressions as SQL text over one series: partitioned by symbol, ordered by time.

The same text is used in DataFrame expressions and in the queries' SQL. Frames are row counts; a null in a
frame makes a gated result null.
"""

from __future__ import annotations

ORDER = "(PARTITION BY symbol ORDER BY time)"
BEFORE = "(PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
RUNNING = "(PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def frame(n: int, part: str = "symbol") -> str:
    """The last n rows; with more columns in `part` (a flag of the step before), the last n rows that have the row's flag."""
    return f"(PARTITION BY {part} ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def gated(aggregate: str, x: str, n: int, part: str = "symbol") -> str:
    """The aggregate over the last n rows, null until there are n and while one of them is null."""
    return f"CASE WHEN count({x}) OVER {frame(n, part)} = {n} THEN {aggregate}({x}) OVER {frame(n, part)} END"


def mean(x: str, n: int, part: str = "symbol") -> str:
    return gated("avg", x, n, part)


def total(x: str, n: int, part: str = "symbol") -> str:
    return gated("sum", x, n, part)


def highest(x: str, n: int) -> str:
    return gated("max", x, n)


def lowest(x: str, n: int) -> str:
    return gated("min", x, n)


def deviation(x: str, n: int) -> str:
    return gated("stddev_pop", x, n)


def lag(x: str, k: int = 1, part: str = "symbol") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {part} ORDER BY time)" if k else f"({x})"


def prior(x: str) -> str:
    """The last value that is not null on a row before; `x` is a column."""
    return f"last_value({x}) IGNORE NULLS OVER {BEFORE}"


def rise(x: str) -> str:
    """x where it is positive, 0 where it is not, null where it is null (`greatest` would take a null for less than 0)."""
    return f"CASE WHEN {x} > 0 THEN {x} WHEN {x} IS NOT NULL THEN 0.0 END"


def running(x: str) -> str:
    return f"sum({x}) OVER {RUNNING}"


def ratio(a: str, b: str) -> str:
    """a / b, null where b is zero."""
    return f"(({a}) / nullif({b}, 0))"


def weighted(x: str, weights: list[float]) -> str:
    """Sum of weight k times the value k rows back; null until all of them are there."""
    return "(" + " + ".join(f"{w!r} * {lag(x, k)}" for k, w in enumerate(weights)) + ")"


def slope(x: str, n: int) -> str:
    """Least-squares slope of the last n values against 0..n-1, oldest first."""
    middle, spread = (n - 1) / 2, n * (n * n - 1) / 12
    return weighted(x, [(n - 1 - k - middle) / spread for k in range(n)])


def partial_mean(x: str, n: int, part: str) -> str:
    """Sum of the last n values there are, fewer at the start, always over n; `part` has a flag that x is there."""
    return f"CASE WHEN {x} IS NOT NULL THEN (sum({x}) OVER {frame(n, part)}) / {n} END"
