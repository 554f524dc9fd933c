"""Scalar expressions: price fields and scales, quantising, drawing measures, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {
    "open": ("open",), "high": ("high",), "low": ("low",), "close": ("close",), "volume": ("volume",),
    "hl2": ("high", "low"), "hlc3": ("high", "low", "close"), "ohlc4": ("open", "high", "low", "close"),
}
#: Fixed retracement ratios.
RATIOS = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)


def valid(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def source(field: str) -> Column:
    """A field or mean of fields of a bar; null if one of them is not a finite number."""
    parts = [F.col(c).cast("double") for c in FIELDS[field]]
    ok = parts[0].isNotNull()
    for p in parts:
        ok = ok & valid(p)
    return F.when(ok, sum(parts[1:], parts[0]) / len(parts))


def lifted(bars: DataFrame, field: str) -> DataFrame:
    """Bars whose four prices are the chosen field; volume stays unless it is the field."""
    x = source(field)
    return bars.withColumns({"open": x, "high": x, "low": x, "close": x, **({"volume": F.lit(None).cast("double")} if field == "volume" else {})})


def scaled(value: Column, kind: str, base: Column | None = None) -> Column:
    """Logarithmic, percentage or indexed-to-100 scale; null where the logarithm or the base has no meaning."""
    if kind == "logarithmic":
        return F.when(value > 0, F.ln(value))
    ratio = F.when(base > 0, value / F.nullif(base, F.lit(0.0)))
    return (ratio - 1) * 100 if kind == "percentage" else ratio * 100


def unscaled(shown: Column, kind: str, base: Column | None = None) -> Column:
    if kind == "logarithmic":
        return F.exp(shown)
    share = shown / 100 + 1 if kind == "percentage" else shown / 100
    return F.when(base > 0, share * base)


def quantised(value: Column, size: float, origin: float = 0.0) -> Column:
    """The nearest point of the grid, halves upward; never negative zero."""
    return F.lit(origin) + F.floor((value - origin) / size + 0.5) * size + 0.0


def remaining(quantity: Column, filled: Column) -> Column:
    return F.greatest(F.lit(0.0), quantity - filled)


def retracements(rows: DataFrame, p0: str, p1: str, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """A row for each ratio: level = p0 + (p1 - p0) ratio. 2 to 32 distinct ratios within -5..5."""
    if not 2 <= len(ratios) <= 32 or len(set(ratios)) < len(ratios) or any(not -5 <= r <= 5 for r in ratios):
        raise ValueError("2 to 32 distinct ratios between -5 and 5")
    levels = F.array(*(F.struct(F.lit(float(r)).alias("ratio"), (F.col(p0) + (F.col(p1) - F.col(p0)) * float(r)).alias("level")) for r in ratios))
    return rows.select("*", F.inline(levels))


def measure(p0: Column, p1: Column, t0: Column, t1: Column) -> Column:
    change = p1 - p0
    return F.struct(change.alias("change"), (change / F.nullif(F.abs(p0), F.lit(0.0)) * 100).alias("percent"), (t1 - t0).alias("span"))


def risk_reward(entry: Column, stop: Column, target: Column) -> Column:
    risk, reward = F.abs(entry - stop), F.abs(target - entry)
    base = F.nullif(F.abs(entry), F.lit(0.0))
    return F.struct(risk.alias("risk"), reward.alias("reward"), (risk / base * 100).alias("risk_percent"), (reward / base * 100).alias("reward_percent"), F.when(risk > 0, reward / F.nullif(risk, F.lit(0.0))).alias("ratio"))


def backoff(attempt: Column, initial: float, multiplier: float, most: float, jitter: float = 0.0, draw: Column | None = None) -> Column:
    """Delay before the k-th try (k from 1), spread by at most `jitter` of itself; draw is uniform in 0..1."""
    delay = F.least(F.lit(most), F.lit(initial) * F.pow(F.lit(multiplier), attempt - 1))
    return delay * (1 + F.lit(jitter) * (2 * draw - 1)) if draw is not None else delay


def preset_start(end: Column, preset: str, first: Column) -> Column:
    """Start of a date range (epoch seconds, UTC) that ends at `end`: 1D, 5D, 1M, 3M, 6M, 1Y, 5Y, YTD or All.

    Months keep the day, held to the month's end; a year to date that would be empty is one day.
    """
    when = F.timestamp_seconds(end)
    back = lambda months: F.unix_timestamp(F.date_format(F.add_months(when.cast("date"), -months), "yyyy-MM-dd"), "yyyy-MM-dd") + end % 86400
    if preset == "All":
        return first
    if preset == "YTD":
        start = F.unix_timestamp(F.date_trunc("year", when))
        return F.when(start < end, start).otherwise(end - 86400)
    days, months = {"1D": 1, "5D": 5}, {"1M": 1, "3M": 3, "6M": 6, "1Y": 12, "5Y": 60}
    return end - 86400 * days[preset] if preset in days else back(months[preset])


def search(catalog: DataFrame, text: str, favourites: bool = False) -> DataFrame:
    """Rows (id, label, category, favourite) that hold every word of the text, in any case."""
    whole = F.lower(F.concat_ws(" ", "id", "label", "category"))
    for word in text.lower().split():
        catalog = catalog.where(whole.contains(word))
    return catalog.where("favourite") if favourites else catalog


def time_label(seconds: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone), pattern)
