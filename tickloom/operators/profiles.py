"""Running volume profiles, one bar at a time."""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pandas as pd


def area(totals: list[float], at: int, share: float) -> tuple[int, int]:
    """First and last place of the area around `at` that holds `share` of the totals."""
    low = high = at
    held, goal = totals[at], share * sum(totals)
    while held < goal and (low > 0 or high < len(totals) - 1):
        below = totals[low - 1] if low > 0 else -1
        above = totals[high + 1] if high < len(totals) - 1 else -1
        down, up = below >= above, above >= below
        low, high = low - down, high + up
        held += below * down + above * up
    return low, high


def developing(share: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(bars: pd.DataFrame) -> pd.DataFrame:
        ticks: list[int] = []
        prices: list[float] = []
        totals: list[float] = []
        rows = []
        for bar in bars.sort_values("time").itertuples():
            for cell in bar.cells:
                k = bisect.bisect_left(ticks, cell["tick"])
                if k == len(ticks) or ticks[k] != cell["tick"]:
                    for held, new in ((ticks, cell["tick"]), (prices, cell["price"]), (totals, 0.0)):
                        held.insert(k, new)
                totals[k] += cell["total"]
            near = max(prices[0], min(prices[-1], bar.close))
            best = max(range(len(ticks)), key=lambda k: (totals[k], -abs(prices[k] - near), -prices[k]))
            low, high = area(totals, best, share)
            rows.append((bar.symbol, bar.time, prices[best], prices[low], prices[high], sum(totals)))
        return pd.DataFrame(rows, columns=["symbol", "time", "poc", "va_low", "va_high", "volume"])

    return run


PROFILE = "symbol string, bid_volume double, ask_volume double, volume double, n_levels long, poc double, va_low double, va_high double"


def whole(share: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One symbol's levels (price, bid, ask, near): totals, point of control (ties: nearest to `near`, then lower) and area."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("price", kind="stable")
        prices, totals = cells["price"].to_numpy(), (cells["bid"] + cells["ask"]).to_numpy()
        best = int(np.lexsort((prices, np.abs(prices - cells["near"].iloc[0]), -totals))[0])
        low, high = area(totals.tolist(), best, share)
        row = (cells["symbol"].iloc[0], cells["bid"].sum(), cells["ask"].sum(), totals.sum(), len(cells), prices[best], prices[low], prices[high])
        return pd.DataFrame([row], columns=["symbol", "bid_volume", "ask_volume", "volume", "n_levels", "poc", "va_low", "va_high"])

    return run
