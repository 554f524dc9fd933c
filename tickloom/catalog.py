"""Every registered query of the library, and its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.indicators import REGISTRY, find
from tickloom.operators.stretches import long_symbols
from tickloom.plans.duck import plan_sql
from tickloom.plans import market_queries as market
from tickloom.plans.run import indicator, indicators
from tickloom.session import shared_folder
from tickloom.sources.market import bars, bars_sql
from tickloom.streaming.studies import LiveStudy
from tickloom.streaming.views import LiveViews

#: Moves numbers off exact halves, which engines round differently.
NUDGE = 1.000000000001

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zero."""
    return df.select(*((F.round(F.col(f.name).cast("double") * NUDGE, 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)) else F.col(f.name) for f in df.schema.fields))


def _levels(name: str) -> Column:
    """A list of price levels as text, in millionths, so that engines can be compared."""
    millionths = lambda x: F.round(x * 1_000_000).cast("long").cast("string")
    return F.array_join(F.transform(name, lambda b: F.concat(millionths(b["price"]), F.lit(":"), millionths(b["volume"]))), ";").alias(name)


def _plain(df: DataFrame) -> DataFrame:
    """Numbers of an indicator as doubles; time, text and flags as they are; levels as text."""
    keep = (T.StringType, T.BooleanType)
    df = df.select(*(_levels(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields))
    return rounded(df.select(*(F.col(f.name) if f.name == "time" or isinstance(f.dataType, keep) else F.col(f.name).cast("double").alias(f.name) for f in df.schema.fields)))


def _indicator_query(name: str) -> Query:
    return lambda spark, sf_dir: _plain(indicator(bars(spark, sf_dir), name))


#: SQL written by hand for plans that have none.
BY_HAND = {
    "VolumeProfileIndicator": f"""
WITH b AS ({bars_sql()}),
     h AS (SELECT a.symbol, a.time, trunc(c.close) AS price, sum(c.volume) AS volume FROM b a JOIN b c ON c.symbol = a.symbol AND c.time <= a.time GROUP BY 1, 2, 3)
SELECT symbol, time, round(sum(volume) * {NUDGE!r}, 6) + 0.0 AS value,
       string_agg(CAST(CAST(round(price * 1000000) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round(volume * 1000000) AS BIGINT) AS VARCHAR), ';' ORDER BY price) AS buckets
FROM h GROUP BY symbol, time""",
}


def _indicator_sql(name: str) -> str | None:
    if name in BY_HAND:
        return BY_HAND[name]
    plan = REGISTRY[name].plan()
    made = plan_sql(plan, bars_sql())
    if made is None:
        return None
    flags = {"up", "state", "direction_text"}
    cols = ", ".join(x if x in flags else f"round(CAST({x} AS DOUBLE) * {NUDGE!r}, 6) + 0.0 AS {x}" for x in plan.outputs)
    return f"SELECT symbol, time, {cols} FROM ({made})"


#: Columns of the market queries that are doubles, by name.
DOUBLES = (
    "open high low close volume price bid_volume ask_volume delta poc poc_volume compared_volume base relative click purchase hl2 logarithmic quantised "
    "ratio level change percent remaining total_close ha_open ha_high ha_low ha_close"
).split()


def _rounded_sql(name: str, sql: str) -> str:
    if name in market.WHOLE:
        return sql
    doubles = set(DOUBLES) | ({"total"} if name == "indicator_of_indicator" else set())
    columns = ", ".join(f"'{c}'" for c in sorted(doubles))
    return f"SELECT round(CAST(COLUMNS(lambda c: c IN ({columns})) AS DOUBLE) * {NUDGE!r}, 6) + 0.0, COLUMNS(lambda c: c NOT IN ({columns})) FROM ({sql})"


PROFILE_SQL = f"SELECT symbol, CAST(floor(close + 0.5) AS BIGINT) AS tick, sum(volume) AS volume, count(*) AS bars FROM ({bars_sql()}) GROUP BY ALL"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour bars of every symbol with ten indicators, in one pass over each symbol."""
    return _plain(indicators(bars(spark, sf_dir), TEN))


TEN: dict[str, tuple[str, dict[str, float]]] = {
    "sma": ("sma", {"length": 14}),
    "ema": ("ema", {"length": 14}),
    "bb": ("bb", {}),
    "rsi": ("rsi", {}),
    "macd": ("macd", {}),
    "atr": ("atr", {}),
    "stoch": ("stochastic", {}),
    "cci": ("cci", {}),
    "adx": ("adx", {}),
    "vwap": ("vwap", {}),
}


#: Windows with a bound and by a flag, running totals, averages, recurrences: what live and stretched plans have to carry on.
CARRIED: dict[str, tuple[str, dict[str, float]]] = {n: (n, {}) for n in ("bb", "chop", "vwap", "obv", "macd", "kama", "vidya")}


def live_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The carried indicators over all bars, which come as three micro-batches with their last bars as previews."""
    rows = bars(spark, sf_dir).withColumn("version", F.lit(1).cast("long"))
    first, last = rows.agg(F.min("time"), F.max("time")).first()
    study = LiveStudy(spark, f"{shared_folder(spark)}/study-{uuid.uuid4().hex}", CARRIED, buckets=8)
    part = F.least(F.floor(3 * (F.col("time") - first) / max(1, last - first)), F.lit(2))
    for k in range(3):
        study.run(rows.where(part == k), k)
    return _plain(study.results().drop("final"))


def _views(spark: SparkSession, sf_dir: str) -> LiveViews:
    """Daily bars and a profile that follow all bars in two micro-batches; the first has every bar's open as its close."""
    rows = bars(spark, sf_dir)
    views = LiveViews(spark, f"{shared_folder(spark)}/views-{uuid.uuid4().hex}", market.DAY, 1.0, origin=3600)
    views.run(rows.withColumns({"close": F.col("open"), "version": F.lit(1)}), 0)
    views.run(rows.withColumn("version", F.lit(2)), 1)
    return views


def live_views_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_views(spark, sf_dir).bars())


def live_views_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_views(spark, sf_dir).profile())


def stretched_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The carried indicators with every symbol cut into stretches of 50 bars."""
    rows = bars(spark, sf_dir)
    return _plain(indicators(rows, CARRIED, long_symbols(rows, 50), 50))


def together_sql(asked: dict[str, tuple[str, dict[str, float]]]) -> str:
    """The indicators' own SQL, joined by bar."""
    parts = {prefix: (find(name).plan(**params)) for prefix, (name, params) in asked.items()}
    columns = ", ".join(f"round(CAST({prefix}.{x} AS DOUBLE) * {NUDGE!r}, 6) + 0.0 AS {prefix}_{x}" for prefix, plan in parts.items() for x in plan.outputs)
    first, *others = [f"({plan_sql(plan, bars_sql())}) AS {prefix}" for prefix, plan in parts.items()]
    return f"SELECT symbol, time, {columns} FROM {first} " + " ".join(f"JOIN {other} USING (symbol, time)" for other in others)


def queries() -> dict[str, Query]:
    own = {name: (lambda spark, sf_dir, f=f: rounded(f(spark, sf_dir))) for name, f in market.QUERIES.items()}
    return {"flagship": flagship, "live_plan": live_plan, "stretched_plan": stretched_plan, "live_views_bars": live_views_bars, "live_views_profile": live_views_profile, **own, **{f"ind_{name}": _indicator_query(name) for name in REGISTRY}}


def oracle_sql() -> dict[str, str]:
    return {"flagship": together_sql(TEN), "live_plan": together_sql(CARRIED), "stretched_plan": together_sql(CARRIED), "live_views_bars": _rounded_sql("live_views_bars", market.SQL["resampled_bars"]), "live_views_profile": PROFILE_SQL, **{k: _rounded_sql(k, v) for k, v in market.SQL.items()}, **{f"ind_{name}": sql for name in REGISTRY if (sql := _indicator_sql(name))}}
