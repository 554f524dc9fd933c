"""State machines that no window and no linear recurrence expresses.

Each advances by one bar and keeps its state in a dict of plain values, so batches and streams share it.
"""

from __future__ import annotations

import bisect
import math

Row = tuple | None


def average(s: dict, x: float | None, n: int, start: str, rate: float) -> Row:
    """One step of a recursive average; the ways of starting are those of `folds.seeded`."""
    strict = start in ("strict", "fixed")
    if s.get("dead") or n <= 0:
        return None
    if x is None:
        s["dead"] = (strict and s.get("seen", 0) < n) or start == "fixed"
        return None
    s["seen"] = seen = s.get("seen", 0) + 1
    if seen > n:
        s["y"] += rate * (x - s["y"])
        return (s["y"],)
    s["total"] = s.get("total", 0.0) + x
    s["y"] = s["total"] / (seen if start == "grow" else n)
    return (s["y"],) if seen == n or start in ("partial", "smooth", "grow") else None


def buckets(s: dict, close: float | None, volume: float | None, step: float) -> Row:
    """Volume so far, and by bucket of the close (cut toward zero to a multiple of `step`), in the order of prices."""
    levels = s.setdefault("levels", [])
    if close is not None and volume is not None:
        price = math.trunc(close / step) * step
        at = bisect.bisect_left(levels, [price])
        if at < len(levels) and levels[at][0] == price:
            levels[at][1] += volume
        else:
            levels.insert(at, [price, volume])
        s["total"] = s.get("total", 0.0) + volume
    return s.get("total", 0.0), [{"price": p, "volume": v} for p, v in levels]


def aroon(s: dict, high: float | None, low: float | None, length: int) -> Row:
    """Ages of the highest high and lowest low; when the extreme leaves, an age is its place in the old window."""
    if high is None or low is None:
        return None
    out = []
    for name, value, sign in (("up", high, 1), ("down", low, -1)):
        t = s.setdefault(name, {"window": [], "best": -math.inf, "age": 0})
        x, w = sign * value, t["window"]
        t["best"], t["age"] = (x, 0) if x >= t["best"] else (t["best"], t["age"] + 1)
        if len(w) == length:
            if w[0] == t["best"]:
                t["best"], t["age"] = x, 0
                for k, old in enumerate(w[1:], 1):
                    if old > t["best"]:
                        t["best"], t["age"] = old, k
            del w[0]
        w.append(x)
        out.append(100 * (length - t["age"]) / length if len(w) == length else None)
    return tuple(out)


def approval_flow(s: dict, close: float | None, volume: float | None, length: int) -> Row:
    """Volume of rising against falling closes; once formed, every close is held against the same anchor."""
    if close is None:
        return None
    if not s.get("anchor"):
        s.update(anchor=close, up=s.get("up", 0.0), down=s.get("down", 0.0), seen=s.get("seen", 0))
        return None
    s["up"] += (volume or 0.0) * (close > s["anchor"])
    s["down"] += (volume or 0.0) * (close < s["anchor"])
    s["seen"] += 1
    if s["seen"] < length:
        s["anchor"] = close
        return None
    both = s["up"] + s["down"]
    return (100 * (s["up"] - s["down"]) / both if both else None,)


def ease_of_movement(s: dict, high: float | None, low: float | None, volume: float | None, length: int) -> Row:
    """Mean of the last moves of the middle over volume; bars that emit leave the earlier bar as the anchor."""
    if high is None or low is None or volume is None:
        return None
    recent, out = s.setdefault("recent", []), None
    before = s.get("high", 0.0), s.get("low", 0.0)
    if before[0] and before[1] and high != low and volume:
        recent.append(((high + low) - sum(before)) / 2 * (high - low) / volume)
        del recent[:-length]
        if len(recent) == length:
            return (sum(recent) / length,)
    s["high"], s["low"] = high, low
    return out


def demand(s: dict, close: float | None, volume: float | None, length: int) -> Row:
    if close is None or volume is None:
        return None
    if not s.get("close") or not s.get("volume"):
        s.update(close=close, volume=volume)
        return None
    recent, move, flow = s.setdefault("recent", []), close - s["close"], volume - s["volume"]
    if move and flow:
        p, v = math.log(abs(move)), math.log(abs(flow))
        recent.append(math.copysign(1, move) * (p * v / (p - v) if p != v else 0.0))
        del recent[:-length]
        s.update(close=close, volume=volume)
    return (sum(recent) / length,) if len(recent) == length else None


def fisher(s: dict, position: float | None) -> Row:
    """position: where the middle stands in its range, less a half and halved."""
    if position is None:
        return None
    value = max(-0.999, min(0.999, 0.66 * position + 0.67 * s.get("value", 0.0)))
    main, trigger = 0.5 * math.log((1 + value) / (1 - value)), s.get("fisher", 0.0)
    s.update(value=value, fisher=main)
    return main, trigger


def mcginley(s: dict, close: float | None, seed: float | None, length: int) -> Row:
    """seed: the mean of the first `length` closes, there on the bar that completes them."""
    if "y" not in s:
        if seed is None:
            return None
        s["y"] = seed
        return (seed,)
    if close is None or not s["y"]:
        return None
    pull = 0.6 * length * (close / s["y"]) ** 4
    if not pull or not math.isfinite(pull):
        return None
    s["y"] += (close - s["y"]) / pull
    return (s["y"],)


def interleaved(s: dict, close: float | None, length: int) -> Row:
    """Momentum of an average that shares one buffer with its own earlier values."""
    if close is None:
        return None
    recent = s.setdefault("recent", [])
    recent.append(close)
    del recent[:-length]
    average = sum(recent) / length
    if len(recent) < length:
        return None
    recent.append(average)
    del recent[:-length]
    return ((average - recent[0]) / recent[0] * 100 if recent[0] else None,)


def kalman(s: dict, close: float | None, process: float, measurement: float, length: int) -> Row:
    if close is None:
        return None
    if "y" not in s:
        s.update(y=close, error=1.0, seen=0)
    else:
        error = s["error"] + max(process, 1e-12)
        gain = error / (error + max(measurement, 1e-12))
        s.update(y=s["y"] + gain * (close - s["y"]), error=(1 - gain) * error)
    s["seen"] += 1
    return (s["y"],) if s["seen"] >= length else None


def trailing_reverse(s: dict, close: float | None, length: int, multiple: float) -> Row:
    if close is None:
        return None
    if not s:
        s.update(k=close, high=close, low=close, trend=0, seen=0)
    s["k"] = (s["k"] + (close - s["k"]) / length) * multiple
    trend, turn, line = s["trend"], 0, 0.0
    for side in [1, -1] if trend == 0 else [trend]:
        edge = "high" if side > 0 else "low"
        s[edge] = max(s[edge], close) if side > 0 else min(s[edge], close)
        line = s[edge] - side * s["k"]
        if (close - line) * side <= 0:
            turn, other = -side, "low" if side > 0 else "high"
            s[other] = close
            line = close + side * s["k"]
        else:
            turn = side
    s["trend"] = turn
    s["seen"] += 1
    return (line,) if s["seen"] >= length else None


def super_trend(s: dict, high: float | None, low: float | None, close: float | None, atr: float | None, ready: float | None, multiplier: float) -> Row:
    if None in (high, low, close, atr) or not ready:
        return None
    middle = (high + low) / 2
    upper, lower = middle + multiplier * atr, middle - multiplier * atr
    if s:
        # a band moves against the trend only once the close has left it
        upper = upper if upper < s["upper"] or s["close"] > s["upper"] else s["upper"]
        lower = lower if lower > s["lower"] or s["close"] < s["lower"] else s["lower"]
        trend = (-1 if close <= lower else 1) if s["trend"] == 1 else (1 if close >= upper else -1)
    else:
        trend = 1 if close >= middle else -1
    s.update(upper=upper, lower=lower, close=close, trend=trend)
    return (lower if trend == 1 else upper), float(trend)


def parabolic(s: dict, high: float | None, low: float | None, acceleration: float, step: float, most: float) -> Row:
    """Parabolic stop and reverse; the first bar stands twice at the head of the bars looked back on."""
    if high is None or low is None:
        return None
    bars = s.setdefault("bars", [])
    bars += [(high, low)] * (2 if not bars else 1)
    if len(bars) < 3:
        return None
    del bars[:-3]
    if "long" not in s:
        top, bottom = max(b[0] for b in bars), min(b[1] for b in bars)
        rising = bars[-1][0] > bars[-2][0]
        extreme = top if rising else bottom
        s.update(long=rising, extreme=extreme, rate=acceleration, sar=extreme - (1 if rising else -1) * (top - bottom) * acceleration)
        return (s["sar"],)

    def reverse() -> float:
        stop = s["extreme"]
        s.update(long=not s["long"], rate=acceleration)
        s["extreme"] = high if s["long"] else low
        return stop

    def kept(stop: float, back: list[tuple[float, float]]) -> float:
        """The stop held outside the given bars."""
        return min([stop, *(b[1] for b in back)]) if s["long"] else max([stop, *(b[0] for b in back)])

    stop = kept(s["sar"] + s["rate"] * (s["extreme"] - s["sar"]), bars[-2:])
    if not (low > stop if s["long"] else high < stop):
        stop = reverse()
    stop = kept(stop, bars[:2])
    if any(b[1] < stop for b in bars[-2:]) if s["long"] else any(b[0] > stop for b in bars[-2:]):
        stop = reverse()
    elif high > s["extreme"] if s["long"] else low < s["extreme"]:
        s["extreme"] = high if s["long"] else low
        s["rate"] = min(most, s["rate"] + step)
    s["sar"] = stop
    return (stop,)


def zigzag(s: dict, price: float | None, deviation: float, sides: int) -> Row:
    """The extreme that a turn confirms, how many bars back it was, and whether it was a top.

    sides: 1 for tops only, -1 for bottoms only, 0 for both. A series that starts with a gap has no points.
    """
    if s.get("dead") or price is None:
        s.setdefault("first", None)
        s["dead"] = s.get("dead") or s["first"] is None
        return None
    if s.get("first") is None:
        s["first"] = price
        return None
    if "up" not in s:
        s.update(extreme=price, up=price >= s["first"], shift=0)
        return None
    reach, sign = s["extreme"] * deviation, 1 if s["up"] else -1
    if (price - s["extreme"]) * sign > 0:
        s.update(extreme=price, shift=1)
        return None
    if (s["extreme"] - price) * sign >= reach:
        out = s["extreme"], float(s["shift"]), s["up"]
        s.update(up=not s["up"], extreme=price, shift=1)
        return out if sides in (0, sign) else None
    s["shift"] += 1
    return None


def spaced(s: dict, up: float | None, down: float | None, length: int) -> Row:
    """Pivots at least `length` bars after the last one of their side."""
    out = []
    for name, value in (("up", up), ("down", down)):
        s[name] = s.get(name, 0) + 1
        fits = value is not None and s[name] >= length
        s[name] = 0 if fits else s[name]
        out.append(value if fits else None)
    return tuple(out)
