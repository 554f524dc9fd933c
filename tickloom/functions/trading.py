"""Orders, positions, executions and quotes: rule columns and simple derived values.

Every check returns the rows with `valid` and `reason` (the first rule broken, else null). Prices and
quantities stand on grids; ids are unique within a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
SIDES = ("buy", "sell")
POSITION_SIDES = ("long", "short")
ORDER_TYPES = ("market", "limit", "stop", "stop-limit")
ORDER_STATES = ("pending", "working", "partially-filled", "filled", "cancelled", "rejected", "expired")
TIMES_IN_FORCE = ("day", "good-till-cancelled", "immediate-or-cancel", "fill-or-kill")
LIQUIDITY = ("maker", "taker", "unknown")
INTENTS = (
    "place-order", "modify-order", "cancel-order", "close-position", "reverse-position",
    "create-stop-loss", "edit-stop-loss", "remove-stop-loss", "create-take-profit", "edit-take-profit", "remove-take-profit",
)


def on_grid(x: Column, size: float) -> Column:
    ticks = x / size
    return F.abs(ticks - F.floor(ticks + 0.5)) <= F.greatest(F.lit(1e-9), F.abs(ticks) * 1e-12)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def judged(rows: DataFrame, rules: list[tuple[str, Column]], key: str = "id") -> DataFrame:
    """rules: (reason, what must hold). A key that is null or occurs twice breaks a rule of its own."""
    many = F.count("*").over(Window.partitionBy(key))
    out = F.lit(None).cast("string")
    for reason, holds in reversed([(f"{key} is missing", F.trim(F.col(key).cast("string")) != ""), (f"{key} is not unique", many == 1), *rules]):
        out = F.when(~F.coalesce(holds, F.lit(False)), F.lit(reason)).otherwise(out)
    return rows.withColumn("reason", out).withColumn("valid", F.col("reason").isNull())


def check_orders(orders: DataFrame, tick: float, lot: float) -> DataFrame:
    """Orders (id, symbol, side, type, status, quantity, filled, limit_price, stop_price)."""
    kind, q, f = F.col("type"), F.col("quantity"), F.col("filled")
    needs = lambda kinds, p: F.when(kind.isin(*kinds), _finite(F.col(p)) & on_grid(F.col(p), tick)).otherwise(F.col(p).isNull() | on_grid(F.col(p), tick))
    return judged(
        orders,
        [
            ("unknown side", F.col("side").isin(*SIDES)),
            ("unknown type", kind.isin(*ORDER_TYPES)),
            ("unknown status", F.col("status").isin(*ORDER_STATES)),
            ("quantity is not positive", _finite(q) & (q > 0)),
            ("quantity is off the grid", on_grid(q, lot)),
            ("filled is outside the quantity", _finite(f) & (f >= 0) & (f <= q)),
            ("limit price is missing or off the grid", needs(("limit", "stop-limit"), "limit_price")),
            ("stop price is missing or off the grid", needs(("stop", "stop-limit"), "stop_price")),
        ],
    )


def check_positions(positions: DataFrame, tick: float, lot: float) -> DataFrame:
    """Positions (id, symbol, side, quantity, average_price)."""
    q = F.col("quantity")
    return judged(positions, [("unknown side", F.col("side").isin(*POSITION_SIDES)), ("quantity is not positive", _finite(q) & (q > 0)), ("quantity is off the grid", on_grid(q, lot)), ("average price is not a number", _finite(F.col("average_price")))])


def check_executions(executions: DataFrame, tick: float, lot: float) -> DataFrame:
    """Executions (id, order_id, side, quantity, price, time)."""
    q, p = F.col("quantity"), F.col("price")
    return judged(
        executions,
        [("unknown side", F.col("side").isin(*SIDES)), ("quantity is not positive", _finite(q) & (q > 0)), ("quantity is off the grid", on_grid(q, lot)), ("price is not a number", _finite(p)), ("price is off the grid", on_grid(p, tick)), ("time is missing", F.col("time").isNotNull())],
    )


def check_quotes(quotes: DataFrame, tick: float) -> DataFrame:
    """Quotes (symbol, time, bid, ask): a quote is known by its symbol, and bid is at most ask."""
    b, a = F.col("bid"), F.col("ask")
    return judged(quotes, [("bid or ask is missing", _finite(b) | _finite(a)), ("bid is off the grid", b.isNull() | on_grid(b, tick)), ("ask is off the grid", a.isNull() | on_grid(a, tick)), ("bid is over ask", b.isNull() | a.isNull() | (b <= a))], "symbol")


def check_intents(intents: DataFrame) -> DataFrame:
    """Intents (id, kind, target): what acts on an order or position has to name it."""
    kind = F.col("kind")
    return judged(intents, [("unknown kind", kind.isin(*INTENTS)), ("target is missing", (kind == "place-order") | F.col("target").isNotNull())])


def profit(realised: Column, unrealised: Column) -> Column:
    return realised + unrealised


def replaced(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """What setting a collection to `new` changes: key and change (added, updated, removed); rows that stay have none."""
    columns = [c for c in new.columns if c != key]
    before = old.select(F.col(key), F.struct(*columns).alias("_old"))
    after = new.select(F.col(key), F.struct(*columns).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "updated")
    return before.join(after, key, "full").select(key, change.alias("change")).where("change is not null")


class TradingStore:
    """The latest accepted orders, positions, executions and quotes, each a table that is set as a whole.

    A table is refused as a whole if one of its rows breaks a rule, and the version grows only with a change. Tables are
    kept as they are given: write them first where they are costly.
    """

    def __init__(self, tick: float, lot: float):
        self.version, self.tables = 0, {}
        self._checks = {"orders": lambda t: check_orders(t, tick, lot), "positions": lambda t: check_positions(t, tick, lot), "executions": lambda t: check_executions(t, tick, lot), "quotes": lambda t: check_quotes(t, tick)}
        self._keys = {"quotes": "symbol"}

    def set(self, name: str, rows: DataFrame) -> DataFrame:
        """Replace a table; returns what changed (key, change)."""
        if name not in self._checks:
            raise ValueError(f"{name} is no table of the store")
        bad = self._checks[name](rows).where("not valid").select("reason").first()
        if bad:
            raise ValueError(f"{name}: {bad[0]}")
        changes = replaced(self.tables.get(name, rows.limit(0)), rows, self._keys.get(name, "id"))
        if not changes.isEmpty():
            self.tables[name] = rows
            self.version += 1
        return changes

    def snapshot(self) -> dict[str, DataFrame]:
        return dict(self.tables)
