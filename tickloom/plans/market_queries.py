"""Registered queries over the market views, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import calendar, resample, scalars, trading
from tickloom.operators import compare, derived, orderflow
from tickloom.operators.stretches import long_symbols
from tickloom.operators.windows import RUNNING
from tickloom.plans.duck import plan_sql
from tickloom.plans.run import chained, indicator, run_plan
from tickloom.sources.market import BAR_SECONDS, TICKS_SQL, bars, bars_sql, ticks
from tickloom.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Queries without doubles.
WHOLE = {"weekly_bounds", "trade_order", "position_checks", "quote_checks", "session_trades", "countdown", "date_presets", "profile_modes", "trading_time", "session_neighbours", "visible_counts", "tpo_levels"}
TICK = 1.0
DAY = 86400


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _levels(spark: SparkSession, sf_dir: str, size: float = TICK) -> DataFrame:
    return orderflow.footprint_levels(ticks(spark, sf_dir), BAR_SECONDS, size)


def _foot_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderflow.footprint_bars(ticks(spark, sf_dir), BAR_SECONDS)


LEVELS_SQL = f"""
SELECT symbol, CAST(floor(time / {BAR_SECONDS}) AS BIGINT) * {BAR_SECONDS} AS time, CAST(floor(price / {TICK} + 0.5) AS BIGINT) AS tick,
       CAST(floor(price / {TICK} + 0.5) AS BIGINT) * {TICK} AS price,
       coalesce(sum(volume) FILTER (WHERE aggressor_side = 'sell'), 0) AS bid_volume, coalesce(sum(volume) FILTER (WHERE aggressor_side = 'buy'), 0) AS ask_volume,
       count(*) AS trade_count
FROM ({TICKS_SQL}) GROUP BY ALL"""

FOOT_BARS_SQL = f"""
SELECT symbol, CAST(floor(time / {BAR_SECONDS}) AS BIGINT) * {BAR_SECONDS} AS time, arg_min(price, (micros, id)) AS open, max(price) AS high,
       min(price) AS low, arg_max(price, (micros, id)) AS close
FROM ({TICKS_SQL}) GROUP BY ALL"""


@query(bars_sql())
def ohlcv_bars(spark, sf_dir):
    return bars(spark, sf_dir)


@query(f"SELECT symbol, min(time) AS time, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, sum(volume) AS volume FROM ({bars_sql()}) GROUP BY symbol, CAST(floor((time - 3600) / {DAY}) AS BIGINT)")
def resampled_bars(spark, sf_dir):
    return resample.resample(bars(spark, sf_dir), DAY, origin=3600)


@query(f"SELECT symbol, time, arg_max(price, (micros, id)) AS price FROM ({TICKS_SQL}) GROUP BY symbol, time")
def keep_last_bar(spark, sf_dir):
    rows = ticks(spark, sf_dir).select("symbol", "time", "price", F.struct("micros", "id").alias("seq"))
    return resample.keep_last(rows, "seq").select("symbol", "time", "price")


@query(f"SELECT symbol, time, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS k FROM ({bars_sql()}) WHERE time <= 1705276800) WHERE k <= 10")
def bars_page(spark, sf_dir):
    return resample.page(bars(spark, sf_dir), end=1705276800, count_back=10).select("symbol", "time", "close")


@query(LEVELS_SQL)
def footprint_levels(spark, sf_dir):
    return _levels(spark, sf_dir)


@query(f"""
SELECT symbol, time, sum(l.bid_volume) AS bid_volume, sum(l.ask_volume) AS ask_volume, sum(l.ask_volume) - sum(l.bid_volume) AS delta,
       CAST(sum(l.trade_count) AS BIGINT) AS trade_count, arg_max(l.price, struct_pack(a := l.bid_volume + l.ask_volume, b := -abs(l.price - b.close), c := -l.price)) AS poc, max(l.bid_volume + l.ask_volume) AS poc_volume
FROM ({LEVELS_SQL}) l JOIN ({FOOT_BARS_SQL}) b USING (symbol, time) GROUP BY symbol, time""")
def footprint_metrics(spark, sf_dir):
    made = orderflow.footprint_metrics(_levels(spark, sf_dir), _foot_bars(spark, sf_dir))
    return made.select("symbol", "time", "bid_volume", "ask_volume", "delta", "trade_count", "poc", "poc_volume")


@query()
def footprint_value_area(spark, sf_dir):
    made = orderflow.footprint_metrics(_levels(spark, sf_dir), _foot_bars(spark, sf_dir))
    return made.select("symbol", "time", "va_low", "va_high", "va_volume", "auction_low", "auction_high")


IMBALANCE_SQL = f"""
WITH l AS ({LEVELS_SQL}), e AS (SELECT symbol, time, min(tick) AS lo, max(tick) AS hi FROM l GROUP BY ALL),
f AS (SELECT l.*, e.lo, e.hi, coalesce(d.bid_volume, 0) AS bid_below, coalesce(u.ask_volume, 0) AS ask_above FROM l JOIN e USING (symbol, time)
      LEFT JOIN l d ON d.symbol = l.symbol AND d.time = l.time AND d.tick = l.tick - 1 LEFT JOIN l u ON u.symbol = l.symbol AND u.time = l.time AND u.tick = l.tick + 1)
SELECT symbol, time, tick, price, 'buy' AS side, ask_volume AS volume, bid_below AS compared_volume FROM f
WHERE tick > lo AND ask_volume > 0 AND (bid_below = 0 OR ask_volume / nullif(bid_below, 0) >= 3)
UNION ALL
SELECT symbol, time, tick, price, 'sell', bid_volume, ask_above FROM f WHERE tick < hi AND bid_volume > 0 AND (ask_above = 0 OR bid_volume / nullif(ask_above, 0) >= 3)"""


@query(IMBALANCE_SQL)
def imbalances(spark, sf_dir):
    return orderflow.imbalances(_levels(spark, sf_dir)).drop("ratio")


@query(f"SELECT symbol, time, side, count(*) AS n, min(price) AS low, max(price) AS high FROM (SELECT *, tick - row_number() OVER (PARTITION BY symbol, time, side ORDER BY tick) AS g FROM ({IMBALANCE_SQL.replace(str(TICK), '20.0')})) GROUP BY symbol, time, side, g HAVING count(*) >= 3")
def stacked_imbalances(spark, sf_dir):
    return orderflow.stacked(orderflow.imbalances(_levels(spark, sf_dir, 20.0)))


@query(f"""
WITH t AS (SELECT symbol, tick, price, sum(bid_volume) AS b, sum(ask_volume) AS a FROM ({LEVELS_SQL}) GROUP BY ALL),
c AS (SELECT symbol, arg_max(close, time) AS close FROM ({FOOT_BARS_SQL}) GROUP BY symbol),
n AS (SELECT t.*, greatest(min(price) OVER (PARTITION BY symbol), least(max(price) OVER (PARTITION BY symbol), close)) AS near FROM t JOIN c USING (symbol))
SELECT symbol, sum(b) AS bid_volume, sum(a) AS ask_volume, sum(a + b) AS volume, count(*) AS n_levels,
       arg_max(price, struct_pack(a := a + b, b := -abs(price - near), c := -price)) AS poc FROM n GROUP BY symbol""")
def volume_profile(spark, sf_dir):
    return orderflow.volume_profile(_levels(spark, sf_dir), _foot_bars(spark, sf_dir)).drop("va_low", "va_high")


@query()
def volume_profile_area(spark, sf_dir):
    return orderflow.volume_profile(_levels(spark, sf_dir), _foot_bars(spark, sf_dir)).select("symbol", "poc", "va_low", "va_high")


@query()
def developing_profile(spark, sf_dir):
    return orderflow.developing_profile(_levels(spark, sf_dir), _foot_bars(spark, sf_dir))


def _session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).withColumn("session", F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd"))


TPO_SQL = f"""
WITH p AS (SELECT *, strftime(to_timestamp(time) AT TIME ZONE 'UTC', '%Y-%m-%d') AS session FROM ({bars_sql()})),
q AS (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY time) - 1 AS period FROM p),
r AS (SELECT symbol, session, period, unnest(range(CAST(floor(low / 5.0 + 0.5) AS BIGINT), CAST(floor(high / 5.0 + 0.5) AS BIGINT) + 1)) AS tick FROM q)"""


@query(TPO_SQL + " SELECT symbol, session, tick, count(*) AS n, string_agg(chr(CAST(65 + period AS INTEGER)), '' ORDER BY period) AS letters FROM r GROUP BY ALL")
def tpo_levels(spark, sf_dir):
    rows = orderflow.tpo_levels(_session_bars(spark, sf_dir), 5.0)
    return rows.groupBy("symbol", "session", "tick").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("period")), orderflow.tpo_symbol), "").alias("letters"))


@query(TPO_SQL + """, l AS (SELECT symbol, session, tick, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT *, min(tick) OVER w + max(tick) OVER w AS mid FROM l WINDOW w AS (PARTITION BY symbol, session))
SELECT symbol, session, CAST(sum(n) AS BIGINT) AS total, arg_max(tick, struct_pack(a := n, b := -abs(2 * tick - mid), c := -tick)) * 5.0 AS poc, max(n) AS poc_count, count(*) FILTER (WHERE n = 1) AS single_prints FROM m GROUP BY ALL""")
def tpo_profile(spark, sf_dir):
    return orderflow.tpo_profile(_session_bars(spark, sf_dir), 5.0).select("symbol", "session", "total", "poc", "poc_count", "single_prints")


@query()
def tpo_value_area(spark, sf_dir):
    return orderflow.tpo_profile(_session_bars(spark, sf_dir), 5.0)


@query(plan_sql(derived.HEIKIN_ASHI, bars_sql()))
def heikin_ashi(spark, sf_dir):
    return run_plan(bars(spark, sf_dir), derived.HEIKIN_ASHI)


#: One box a turn, as bricks are laid: a bar stays until it moves the base no more.
RENKO_SQL = f"""
WITH RECURSIVE b AS MATERIALIZED ({bars_sql()}),
e AS (SELECT symbol, CASE WHEN max(close) > min(close) THEN max(close) - min(close) ELSE 1.0 END / 40 AS box, min(time) AS first, max(time) AS last FROM b GROUP BY symbol),
n AS MATERIALIZED (SELECT symbol, close, box, row_number() OVER (PARTITION BY symbol ORDER BY time) AS i FROM b JOIN e USING (symbol)),
r AS (SELECT symbol, 2::BIGINT AS i, close AS base, close AS base0, 0 AS after, 0 AS step, 0 AS turn FROM n WHERE i = 1
      UNION ALL SELECT symbol, i + CASE WHEN step = 0 THEN 1 ELSE 0 END, base + step * box, base0, after + step, step, turn + 1
      FROM (SELECT r.symbol, r.i, base, base0, after, turn, box, CASE WHEN close >= base + box THEN 1 WHEN close <= base - box THEN -1 ELSE 0 END AS step FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i)),
m AS (SELECT symbol, first, last, base0 + (after - step) * box AS s, base0 + (after - step) * box + step * box AS f, row_number() OVER (PARTITION BY symbol ORDER BY turn) - 1 AS j, count(*) OVER (PARTITION BY symbol) AS c FROM r JOIN e USING (symbol) WHERE step <> 0)
SELECT symbol, CAST(floor(CASE WHEN c = 1 OR last <= first THEN CAST(first + j AS DOUBLE) ELSE first + j / greatest(c - 1, 1) * (last - first) END * 1000) AS BIGINT) AS time_ms, s AS open, greatest(s, f) AS high, least(s, f) AS low, f AS close FROM m"""

FIGURE_SQL = f"""
WITH RECURSIVE b AS MATERIALIZED ({bars_sql()}),
e AS (SELECT symbol, CASE WHEN max(high) > min(low) THEN max(high) - min(low) ELSE 1.0 END / 50 AS box, min(time) AS first, max(time) AS last FROM b GROUP BY symbol),
n AS MATERIALIZED (SELECT symbol, close, box, row_number() OVER (PARTITION BY symbol ORDER BY time) AS i FROM b JOIN e USING (symbol)),
r AS (SELECT symbol, i, close AS grid, 0 AS way, close AS top, close AS bottom, 0 AS part, close AS start, 0 AS mode FROM n WHERE i = 1
      UNION ALL
      SELECT symbol, i, grid, CASE mode WHEN 0 THEN way WHEN 1 THEN 1 WHEN 4 THEN 1 ELSE -1 END, CASE mode WHEN 1 THEN floor((close - grid) / box) * box + grid WHEN 4 THEN close ELSE top END,
             CASE mode WHEN 2 THEN ceil((close - grid) / box) * box + grid WHEN 3 THEN close ELSE bottom END, part + CASE WHEN mode >= 3 THEN 1 ELSE 0 END,
             CASE WHEN mode = 1 AND way = 0 THEN bottom WHEN mode = 2 AND way = 0 THEN top WHEN mode = 3 THEN top - box WHEN mode = 4 THEN bottom + box ELSE start END, mode
      FROM (SELECT n.symbol, n.i, n.close, n.box, r.grid, r.way, r.top, r.bottom, r.part, r.start,
                   CASE WHEN way >= 0 AND n.close >= top + box THEN 1 WHEN way <= 0 AND n.close <= bottom - box THEN 2
                        WHEN way = 1 AND n.close <= top - 2 * box THEN 3 WHEN way = -1 AND n.close >= bottom + 2 * box THEN 4 ELSE 0 END AS mode
            FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)),
c AS (SELECT symbol, part, arg_max(start, i) AS s, arg_max(CASE WHEN way = 1 THEN top ELSE bottom END, i) AS f FROM r WHERE mode > 0 GROUP BY symbol, part),
m AS (SELECT c.*, first, last, row_number() OVER (PARTITION BY symbol ORDER BY part) - 1 AS j, count(*) OVER (PARTITION BY symbol) AS n FROM c JOIN e USING (symbol))
SELECT symbol, CAST(floor(CASE WHEN n = 1 OR last <= first THEN CAST(first + j AS DOUBLE) ELSE first + j / greatest(n - 1, 1) * (last - first) END * 1000) AS BIGINT) AS time_ms, s AS open, greatest(s, f) AS high, least(s, f) AS low, f AS close FROM m"""


def _in_ms(bars: DataFrame) -> DataFrame:
    """Bars with their time in whole milliseconds, which engines round alike."""
    return bars.select("symbol", F.floor(F.col("time") * 1000).alias("time_ms"), "open", "high", "low", "close")


@query(RENKO_SQL)
def renko(spark, sf_dir):
    return _in_ms(derived.renko(bars(spark, sf_dir)))


@query(FIGURE_SQL)
def point_and_figure(spark, sf_dir):
    return _in_ms(derived.point_and_figure(bars(spark, sf_dir)))


@query(f"SELECT symbol, time, base, (close / base - 1) * 100 AS relative FROM (SELECT *, first_value(close) OVER (PARTITION BY symbol ORDER BY CASE WHEN time >= 1704672000 THEN 0 ELSE 1 END, time) AS base FROM ({bars_sql()}))")
def relative_performance(spark, sf_dir):
    return compare.relative(bars(spark, sf_dir), F.col("close"), start=1704672000)


@query(f"SELECT CAST(floor(time / {BAR_SECONDS}) AS BIGINT) AS time, max(close) FILTER (WHERE symbol = 'click') AS click, max(close) FILTER (WHERE symbol = 'purchase') AS purchase FROM ({bars_sql()}) WHERE symbol IN ('click', 'purchase') GROUP BY ALL")
def aligned_series(spark, sf_dir):
    rows = bars(spark, sf_dir).select("symbol", F.floor(F.col("time") / BAR_SECONDS).alias("time"), F.col("close").alias("value"))
    return compare.aligned({s: rows.where(F.col("symbol") == s).drop("symbol") for s in ("click", "purchase")})


@query(f"""
WITH b AS ({bars_sql()}), t AS (SELECT DISTINCT symbol, CAST(floor(time / 50000) AS BIGINT) * 50000 AS time FROM b),
p AS (SELECT t.symbol, t.time, x.time AS tx, x.close AS cx FROM t ASOF LEFT JOIN b x ON t.symbol = x.symbol AND t.time >= x.time),
q AS (SELECT p.*, y.time AS ty, y.close AS cy FROM p ASOF LEFT JOIN b y ON p.symbol = y.symbol AND p.time <= y.time)
SELECT symbol, time, CASE WHEN ty IS NULL OR time - tx <= ty - time THEN tx ELSE ty END AS matched_time, CASE WHEN ty IS NULL OR time - tx <= ty - time THEN cx ELSE cy END AS close FROM q""")
def as_of_nearest(spark, sf_dir):
    all_bars = bars(spark, sf_dir)
    left = all_bars.select("symbol", (F.floor(F.col("time") / 50000) * 50000).alias("time")).distinct()
    return compare.as_of(left, all_bars, "close")


@query(SQL["as_of_nearest"])
def as_of_stretched(spark, sf_dir):
    """The same with every symbol of more than 50 rows spread over buckets of its times."""
    all_bars = bars(spark, sf_dir)
    left = all_bars.select("symbol", (F.floor(F.col("time") / 50000) * 50000).alias("time")).distinct()
    long = long_symbols(left.unionByName(all_bars.select("symbol", "time")), 50)
    return compare.as_of(left, all_bars, "close", long=long)


@query(f"""
WITH r AS (SELECT symbol, time, close, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS i, CAST(ceil(count(*) OVER (PARTITION BY symbol) / 50.0) AS BIGINT) AS size FROM ({bars_sql()}))
SELECT symbol, CAST(floor(i / size) AS BIGINT) AS bucket, min(time) AS time, arg_min(close, time) AS open, max(close) AS high, min(close) AS low, arg_max(close, time) AS close, count(close) AS n FROM r GROUP BY ALL""")
def overview(spark, sf_dir):
    return compare.overview(bars(spark, sf_dir), F.col("close"), most=50)


@query(f"SELECT symbol, count(*) FILTER (WHERE time < 1704672000) AS before, count(*) FILTER (WHERE time BETWEEN 1704672000 AND 1705276800) AS inside, count(*) FILTER (WHERE time > 1705276800) AS after FROM ({bars_sql()}) GROUP BY symbol")
def visible_counts(spark, sf_dir):
    return compare.counts_around(bars(spark, sf_dir), 1704672000, 1705276800)


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS i FROM ({bars_sql()})), e AS (SELECT symbol, min(i) FILTER (WHERE time >= 1704672000) AS a, max(i) FILTER (WHERE time <= 1705276800) AS b FROM r GROUP BY symbol) SELECT symbol, time, close FROM r JOIN e USING (symbol) WHERE i BETWEEN a - 2 AND b + 2")
def visible_range(spark, sf_dir):
    return compare.visible(bars(spark, sf_dir), 1704672000, 1705276800, padding=2).select("symbol", "time", "close")


@query(f"SELECT symbol, time, close FROM ({bars_sql()}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) > 3")
def popped_bars(spark, sf_dir):
    return compare.popped(bars(spark, sf_dir), 3).select("symbol", "time", "close")


@query(f"SELECT symbol, time, CASE WHEN time % 3 = 0 THEN close + 1 ELSE close END AS close, CASE WHEN time % 3 = 0 THEN 2 ELSE 1 END AS version FROM ({bars_sql()})")
def upserted_bars(spark, sf_dir):
    old = bars(spark, sf_dir).select("symbol", "time", "close", F.lit(1).alias("version"))
    return compare.upserted(old, old.where("time % 3 = 0").select("symbol", "time", (F.col("close") + 1).alias("close"), F.lit(2).alias("version")))


@query(f"SELECT symbol, time, (high + low) / 2 AS hl2, ln(close) AS logarithmic, floor(close / 0.25 + 0.5) * 0.25 AS quantised FROM ({bars_sql()})")
def scalar_fields(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "time", scalars.source("hl2").alias("hl2"), scalars.scaled(F.col("close"), "logarithmic").alias("logarithmic"), scalars.quantised(F.col("close"), 0.25).alias("quantised"))


@query(f"SELECT symbol, time, ratio, low + (high - low) * ratio AS level FROM ({bars_sql()}), (SELECT unnest([0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0]::DOUBLE[]) AS ratio)")
def fibonacci_levels(spark, sf_dir):
    return scalars.retracements(bars(spark, sf_dir), "low", "high").select("symbol", "time", "ratio", "level")


@query(f"SELECT symbol, time, close - open AS change, (close - open) / nullif(abs(open), 0) * 100 AS percent, (high - close) / nullif(close - low, 0) AS ratio FROM ({bars_sql()})")
def measures(spark, sf_dir):
    m, r = scalars.measure(F.col("open"), F.col("close"), F.col("time"), F.col("time")), scalars.risk_reward(F.col("close"), F.col("low"), F.col("high"))
    return bars(spark, sf_dir).select("symbol", "time", m["change"].alias("change"), m["percent"].alias("percent"), r["ratio"].alias("ratio"))


SCHEDULE = calendar.Schedule("America/New_York", (calendar.SessionRule("main", (1, 2, 3, 4, 5), "09:30", "16:00"),), frozenset({"2024-01-15"}))
_SESSIONS_SQL = "SELECT strftime(d, '%Y-%m-%d') AS day, CAST(epoch(d) AS BIGINT) + 52200 AS a, CAST(epoch(d) AS BIGINT) + 75600 AS b FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-15', INTERVAL 1 DAY)) AS d) WHERE isodow(d) <= 5 AND d <> TIMESTAMP '2024-01-15'"


def _sessions(spark: SparkSession) -> DataFrame:
    return calendar.sessions(spark, SCHEDULE, "2024-01-01", "2024-02-15")


@query(f"SELECT symbol, time, id, day || '/main' AS session FROM ({TICKS_SQL}) JOIN ({_SESSIONS_SQL}) ON time >= a AND time < b")
def session_trades(spark, sf_dir):
    return calendar.with_session(ticks(spark, sf_dir).select("symbol", "time", "id"), _sessions(spark)).where("session is not null").select("symbol", "time", "id", "session")


@query(f"""
SELECT symbol, day || '/main' AS session, 'regular' AS kind, a AS session_open, b AS session_close, min(time) AS time, arg_min(price, (micros, id)) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, (micros, id)) AS close, sum(volume) AS volume, count(*) AS trade_count
FROM ({TICKS_SQL}) JOIN ({_SESSIONS_SQL}) ON time >= a AND time < b GROUP BY symbol, day, a, b""")
def session_bars(spark, sf_dir):
    """Bars of whole sessions, by the windows that a stream of trades has."""
    trades = ticks(spark, sf_dir).withColumn("ts", F.timestamp_micros("micros"))
    return live.live_session_bars(trades, _sessions(spark))


#: A second market, whose hours overlap those of the first for an hour.
BERLIN = calendar.Schedule("Europe/Berlin", (calendar.SessionRule("day", (1, 2, 3, 4, 5), "08:00", "16:30"),))
_BERLIN_SQL = "SELECT CAST(epoch(d) AS BIGINT) + 25200 AS a, CAST(epoch(d) AS BIGINT) + 55800 AS b FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-15', INTERVAL 1 DAY)) AS d) WHERE isodow(d) <= 5"


@query(f"""
WITH s AS ({_SESSIONS_SQL}), x AS (SELECT symbol, time, close FROM ({bars_sql(900)}) JOIN ({_BERLIN_SQL}) ON time >= a AND time < b WHERE symbol = 'purchase' UNION ALL SELECT symbol, time, close FROM ({bars_sql(900)}) JOIN s ON time >= a AND time < b WHERE symbol = 'click'),
p AS (SELECT *, CAST((SELECT coalesce(sum(greatest(0, least(b, x.time) - a)), 0) FROM s) AS BIGINT) AS trading_time FROM x WHERE time < (SELECT max(b) FROM s))
SELECT trading_time, arg_max(close, time) FILTER (WHERE symbol = 'click') AS click, arg_max(close, time) FILTER (WHERE symbol = 'purchase') AS purchase FROM p GROUP BY trading_time""")
def session_alignment(spark, sf_dir):
    """Quarter-hour closes of one series in New York's hours and of another in Berlin's, on the clock of New York's sessions."""
    rows, own = bars(spark, sf_dir, 900), _sessions(spark)
    part = lambda name, table: calendar.trading_rows(rows.where(F.col("symbol") == name).select("time", F.col("close").alias("value")), table)
    berlin = calendar.sessions(spark, BERLIN, "2024-01-01", "2024-02-15")
    return compare.aligned_on_sessions({"click": part("click", own), "purchase": part("purchase", berlin)}, own)


@query(f"SELECT t.symbol, t.time, t.id, CAST((SELECT coalesce(sum(greatest(0, least(b, t.time) - a)), 0) FROM ({_SESSIONS_SQL})) AS BIGINT) AS trading_time FROM ({TICKS_SQL}) t")
def trading_time(spark, sf_dir):
    return calendar.projected(ticks(spark, sf_dir).select("symbol", "time", "id"), _sessions(spark))


@query(f"SELECT t.symbol, t.time, t.id, min(a) FILTER (WHERE a >= t.time) AS next_open, max(b) FILTER (WHERE b <= t.time) AS previous_close FROM ({TICKS_SQL}) t, ({_SESSIONS_SQL}) GROUP BY ALL")
def session_neighbours(spark, sf_dir):
    return calendar.neighbours(ticks(spark, sf_dir).select("symbol", "time", "id"), _sessions(spark))


@query(f"SELECT symbol, time, close, CASE WHEN b IS NULL THEN time + {BAR_SECONDS} ELSE least(time + {BAR_SECONDS}, b) END AS close_time FROM ({bars_sql()}) LEFT JOIN ({_SESSIONS_SQL}) ON time >= a AND time < b")
def bar_bounds(spark, sf_dir):
    return calendar.bar_close(bars(spark, sf_dir).select("symbol", "time", "close"), BAR_SECONDS, _sessions(spark))


@query("""SELECT o_orderkey AS id, o_orderstatus AS status, greatest(0, q - f) AS remaining, CASE WHEN o_orderstatus NOT IN ('O', 'F', 'P') THEN 'unknown status' WHEN q <= 0 THEN 'quantity is not positive' WHEN f > q THEN 'filled is outside the quantity' END AS reason
FROM (SELECT o_orderkey, o_orderstatus, sum(l_quantity) AS q, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS f FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)""")
def order_checks(spark, sf_dir):
    orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    sums = items.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("q"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0)).alias("f"))
    rows = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")).join(sums, "id")
    judged = trading.judged(rows, [("unknown status", F.col("status").isin("O", "F", "P")), ("quantity is not positive", F.col("q") > 0), ("filled is outside the quantity", F.col("f") <= F.col("q"))])
    return judged.select("id", "status", scalars.remaining(F.col("q"), F.col("f")).alias("remaining"), "reason")


@query(f"SELECT symbol, time, sum(close) OVER {RUNNING} AS total FROM (SELECT symbol, time, close FROM ({bars_sql()}) WHERE close > open)")
def indicator_of_indicator(spark, sf_dir):
    """A running study over another's samples: missing ones are skipped, not carried."""
    some = bars(spark, sf_dir).where("close > open").select("symbol", "time", "close")
    return some.select("symbol", "time", F.expr(f"sum(close) OVER {RUNNING}").alias("total"))


@query(f"""
SELECT symbol, time, CASE WHEN n < time THEN 'pending' WHEN n < e THEN 'open' ELSE 'closed' END AS state, greatest(0, least(n, e) - time) AS elapsed, e - time - greatest(0, least(n, e) - time) AS remaining_seconds
FROM (SELECT symbol, time, time + 18000 * (1 - 2 * (time % 2)) + 7200 * (time % 3) AS n, time + {BAR_SECONDS} AS e FROM ({bars_sql()}))""")
def countdown(spark, sf_dir):
    now = F.col("time") + 18000 * (1 - 2 * (F.col("time") % 2)) + 7200 * (F.col("time") % 3)
    c = calendar.countdown(now, F.col("time"), F.col("time") + BAR_SECONDS)
    return bars(spark, sf_dir).select("symbol", "time", c["state"].alias("state"), c["elapsed"].alias("elapsed"), c["remaining"].alias("remaining_seconds"))


@query(f"""
SELECT symbol, time, time - 432000 AS five_days, CAST(epoch(t - INTERVAL 1 MONTH) AS BIGINT) AS one_month, CAST(epoch(t - INTERVAL 1 YEAR) AS BIGINT) AS one_year,
       CASE WHEN CAST(epoch(date_trunc('year', t)) AS BIGINT) < time THEN CAST(epoch(date_trunc('year', t)) AS BIGINT) ELSE time - 86400 END AS year_to_date
FROM (SELECT symbol, time, make_timestamp(time * 1000000) AS t FROM ({bars_sql()}))""")
def date_presets(spark, sf_dir):
    at = lambda p: scalars.preset_start(F.col("time"), p, F.lit(0))
    return bars(spark, sf_dir).select("symbol", "time", at("5D").alias("five_days"), at("1M").alias("one_month"), at("1Y").alias("one_year"), at("YTD").alias("year_to_date"))


@query(f"SELECT symbol, CASE WHEN min(m) = max(m) AND min(m) = 'exact' THEN 'ready' WHEN min(m) = max(m) THEN 'approximate' ELSE 'mixed' END AS status, coalesce(string_agg(DISTINCT r, ',' ORDER BY r), '') AS reasons FROM (SELECT symbol, CASE WHEN symbol < 'm' THEN 'exact' WHEN time % 2 = 0 AND symbol < 'q' THEN 'exact' ELSE 'approximate' END AS m, CASE WHEN symbol < 'm' OR (time % 2 = 0 AND symbol < 'q') THEN NULL WHEN time % 3 = 0 THEN 'candles' ELSE 'gaps' END AS r FROM ({bars_sql()})) GROUP BY symbol")
def profile_modes(spark, sf_dir):
    exact = (F.col("symbol") < "m") | ((F.col("time") % 2 == 0) & (F.col("symbol") < "q"))
    rows = bars(spark, sf_dir).select("symbol", F.when(exact, "exact").otherwise("approximate").alias("data_mode"), F.when(exact, None).when(F.col("time") % 3 == 0, "candles").otherwise("gaps").alias("reason"))
    return orderflow.profile_modes(rows)


@query(f"SELECT symbol, time, price, id FROM ({TICKS_SQL}) WHERE abs(price - floor(price / 0.05 + 0.5) * 0.05) > greatest(1e-12, abs(price) * 3.552713678800501e-15, 0.05e-9)")
def off_grid_trades(spark, sf_dir):
    return orderflow.off_grid(ticks(spark, sf_dir), "price", 0.05).select("symbol", "time", "price", "id")


@query(f"SELECT symbol, time, CASE WHEN count(*) OVER w = 5 THEN avg((high + low) / 2) OVER w END AS level FROM ({bars_sql()}) WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS 4 PRECEDING)")
def indicator_of_field(spark, sf_dir):
    """A moving average of the middle of each bar."""
    return indicator(bars(spark, sf_dir), "sma", source="hl2", length=5).withColumnRenamed("value", "level")


@query(f"""
WITH m AS (SELECT symbol, time, close - lag(close, 5) OVER (PARTITION BY symbol ORDER BY time) AS x FROM ({bars_sql()})),
s AS (SELECT symbol, time, CASE WHEN count(*) OVER w = 3 THEN avg(x) OVER w END AS level FROM m WHERE x IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS 2 PRECEDING))
SELECT symbol, time, level FROM m LEFT JOIN s USING (symbol, time)""")
def indicator_chain(spark, sf_dir):
    """A moving average of momentum: it reads the other's samples and skips those it lacks."""
    return chained(bars(spark, sf_dir), ("momentum", {"length": 5}, "value"), ("sma", {"length": 3}, "value")).withColumnRenamed("value", "level")


@query(f"""
WITH s AS ({_SESSIONS_SQL}), own AS (SELECT symbol, time, date_trunc('week', CAST(day AS DATE)) AS w FROM ({bars_sql()}) JOIN s ON time >= a AND time < b)
SELECT symbol, time, (SELECT max(b) FROM s WHERE date_trunc('week', CAST(day AS DATE)) >= w AND date_trunc('week', CAST(day AS DATE)) < w + INTERVAL 14 DAY) AS close_time FROM own""")
def weekly_bounds(spark, sf_dir):
    """Where two-week bars that begin with each bar end; bars outside the sessions have none and are left out."""
    return calendar.weekly_close(bars(spark, sf_dir).select("symbol", "time"), _sessions(spark), 2).where("close_time is not null")


@query(f"SELECT symbol, count(*) AS n_levels, sum(bid_volume + ask_volume) AS volume FROM ({LEVELS_SQL}) WHERE time >= (SELECT a FROM ({_SESSIONS_SQL}) WHERE a <= 1704900600 AND b > 1704900600) AND time < (SELECT b FROM ({_SESSIONS_SQL}) WHERE a <= 1704900600 AND b > 1704900600) GROUP BY symbol")
def session_profile(spark, sf_dir):
    """Levels and volume of the session that holds an anchor (10 January 2024, 15:30 UTC)."""
    some = orderflow.profile_range(_levels(spark, sf_dir), "session", (0, 0), sessions=_sessions(spark), anchor=1704900600)
    return some.groupBy("symbol").agg(F.count("*").alias("n_levels"), F.sum(F.col("bid_volume") + F.col("ask_volume")).alias("volume"))


#: Trades in an order of arrival that is not theirs: every hundredth comes two places late.
_ARRIVED_SQL = f"SELECT symbol, time, id % 9999 AS id, id % 7 AS sequence, id + CASE WHEN id % 100 = 0 THEN 2 ELSE 0 END + CASE WHEN id % 100 = 0 THEN 0.5 ELSE 0 END AS arrival FROM ({TICKS_SQL})"


@query(f"""
WITH t AS ({_ARRIVED_SQL}),
p AS (SELECT *, lag(time) OVER (PARTITION BY symbol ORDER BY arrival) AS before, lag(sequence) OVER (PARTITION BY symbol, time ORDER BY arrival) AS last, row_number() OVER (PARTITION BY symbol, id ORDER BY arrival) AS nth FROM t)
SELECT symbol, time, id, CASE WHEN time < before THEN 'time goes back' WHEN time = before AND sequence < last THEN 'sequence goes back' WHEN nth > 1 THEN 'id occurs twice' END AS reason FROM p WHERE reason IS NOT NULL""")
def trade_order(spark, sf_dir):
    """Trades that break the order of arrival."""
    id_, late = F.col("id"), F.col("id") % 100 == 0
    rows = ticks(spark, sf_dir).select("symbol", "time", (id_ % 9999).alias("id"), (id_ % 7).alias("sequence"), (id_ + F.when(late, 2.5).otherwise(0.0)).alias("arrival"))
    return orderflow.order_faults(rows).select("symbol", "time", "id", "reason")


@query("""
SELECT id, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'id is not unique' WHEN l_returnflag = 'R' THEN 'unknown side' WHEN l_quantity % 2 <> 0 THEN 'quantity is off the grid' END AS reason
FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag, l_quantity FROM lineitem)""")
def position_checks(spark, sf_dir):
    """Line items read as positions: returned ones have no side that is known, and a lot is two."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = F.when(F.col("l_returnflag") == "A", "long").when(F.col("l_returnflag") == "N", "short").otherwise("none")
    q = F.col("l_quantity").cast("double")
    rows = items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("s").alias("symbol"), side.alias("side"), q.alias("quantity"), F.lit(10.0).alias("average_price"))
    return trading.check_positions(rows, 0.5, 2.0).select("id", "reason")


@query("""
SELECT CAST(ps AS VARCHAR) AS symbol, CASE WHEN ps % 5 = 0 THEN 'bid or ask is missing' WHEN ps % 3 = 1 THEN 'bid is over ask' END AS reason FROM (SELECT p_partkey AS ps FROM part)""")
def quote_checks(spark, sf_dir):
    """Quotes made of parts: some have neither side, some have the bid over the ask."""
    k = F.col("p_partkey")
    price = lambda x: F.when(k % 5 != 0, x.cast("double"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.cast("string").alias("symbol"), F.lit(1).alias("time"), price(F.when(k % 3 == 1, 12).otherwise(10)).alias("bid"), price(F.lit(11)).alias("ask"))
    return trading.check_quotes(rows, 0.5).select("symbol", "reason")


@query(f"SELECT symbol, time, CASE WHEN abs(open - m) <= least(abs(high - m), abs(low - m), abs(close - m)) THEN open WHEN abs(high - m) <= least(abs(low - m), abs(close - m)) THEN high WHEN abs(low - m) <= abs(close - m) THEN low ELSE close END AS level FROM (SELECT *, (open + close) / 3 AS m FROM ({bars_sql()}))")
def nearest_price(spark, sf_dir):
    """The price of each bar that a pointer at a third of open plus close would hold to."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    return bars(spark, sf_dir).select("symbol", "time", compare.nearest_value(prices, (F.col("open") + F.col("close")) / 3).alias("level"))
