"""Trading sessions, bar bounds and trading time.

A schedule is a few rules; its sessions over a span of dates are made on the driver, because daylight-saving
gaps need the zone's rules, and number a few for each day. All work on bars joins that small table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("pre", "regular", "post")
SESSIONS = "id string, kind string, trading_date string, open long, close long"


@dataclass(frozen=True)
class SessionRule:
    """Opens and closes at hh:mm local time on ISO weekdays (1 Monday); the close may be some days later."""

    id: str
    weekdays: tuple[int, ...]
    open: str
    close: str
    kind: str = "regular"
    close_day: int = 0

    def minutes(self) -> tuple[int, int]:
        clock = lambda t: int(t[:2]) * 60 + int(t[3:])
        return clock(self.open), clock(self.close) + 1440 * self.close_day


@dataclass(frozen=True)
class Schedule:
    zone: str
    rules: tuple[SessionRule, ...]
    holidays: frozenset[str] = frozenset()
    overrides: dict[str, tuple[SessionRule, ...]] = field(default_factory=dict)

    def check(self) -> Schedule:
        """Raises ValueError unless ids are unique, sessions last up to a day and none overlap within a week."""
        ZoneInfo(self.zone)
        if len({r.id for r in self.rules}) < len(self.rules):
            raise ValueError("session ids repeat")
        if set(self.overrides) & self.holidays:
            raise ValueError("a holiday cannot have its own sessions")
        spans = []
        for r in [*self.rules, *(x for o in self.overrides.values() for x in o)]:
            start, end = r.minutes()
            if r.kind not in KINDS or not 0 < end - start <= 1440 or not set(r.weekdays) <= set(range(1, 8)):
                raise ValueError(f"bad session {r.id}")
        for r in self.rules:
            start, end = r.minutes()
            spans += [((d - 1) * 1440 + start + w, (d - 1) * 1440 + end + w) for d in r.weekdays for w in (0, 10080)]
        spans.sort()
        if any(a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False)):
            raise ValueError("sessions overlap")
        return self


def _moment(day: date, minutes: int, zone: ZoneInfo, later: bool) -> int:
    """UTC seconds of a local time: the earlier reading of an hour that happens twice for an open, the later for a close."""
    local = datetime(day.year, day.month, day.day) + timedelta(minutes=minutes)
    moment = local.replace(tzinfo=zone, fold=int(later))
    if moment.astimezone(ZoneInfo("UTC")).astimezone(zone).replace(tzinfo=None) != local:
        raise ValueError(f"{local} does not exist in {zone.key}")
    return int(moment.timestamp())


def sessions(spark: SparkSession, schedule: Schedule, first: str, last: str) -> DataFrame:
    """id, kind, trading_date, open, close (UTC seconds, close not included) for the dates first..last."""
    schedule.check()
    zone, day, end, rows = ZoneInfo(schedule.zone), date.fromisoformat(first), date.fromisoformat(last), []
    while day <= end:
        name = day.isoformat()
        rules = () if name in schedule.holidays else schedule.overrides.get(name, tuple(r for r in schedule.rules if day.isoweekday() in r.weekdays))
        for r in rules:
            a, b = r.minutes()
            rows.append((f"{name}/{r.id}", r.kind, name, _moment(day, a, zone, False), _moment(day, b, zone, True)))
        day += timedelta(days=1)
    rows.sort(key=lambda r: r[3])
    if any(a[4] > b[3] for a, b in zip(rows, rows[1:], strict=False)):
        raise ValueError("sessions overlap")
    return spark.createDataFrame(rows, SESSIONS)


def with_session(rows: DataFrame, table: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Rows (time) with the session that contains them; rows outside every session have nulls.

    The join is on the UTC day: a session is listed on each day it touches, so no row meets all sessions.
    """
    days = F.explode(F.sequence(F.floor(F.col("open") / 86400), F.floor((F.col("close") - 1) / 86400)))
    listed = table.where(F.col("kind").isin(*kinds)).select(days.alias("_day"), F.col("id").alias("session"), "kind", "trading_date", F.col("open").alias("session_open"), F.col("close").alias("session_close"))
    on = (F.floor(rows["time"] / 86400) == F.col("_day")) & (rows["time"] >= F.col("session_open")) & (rows["time"] < F.col("session_close"))
    return rows.join(listed, on, "left").drop("_day")


def trading_rows(rows: DataFrame, table: DataFrame, kinds: tuple[str, ...] = ("regular",)) -> DataFrame:
    return with_session(rows, table, kinds).where("session is not null").select(*rows.columns)


def _by_day(table: DataFrame, start: Column, end: Column, *columns: Column) -> tuple[DataFrame, int, int]:
    """Stretches of time (end not included) listed on each UTC day they touch, and the first and last of these days.

    A null start or end reaches to all earlier or later times: rows of those look up the first or last day.
    """
    day = lambda t: F.floor(t / 86400)
    rows = table.select(start.alias("_start"), end.alias("_end"), *columns)
    first, last = rows.agg(F.min(F.coalesce(day(F.col("_start")), day(F.col("_end") - 1))), F.max(F.coalesce(day(F.col("_end") - 1), day(F.col("_start"))))).first()
    first, last = (first or 0), (last or 0)
    days = F.sequence(F.coalesce(day(F.col("_start")), F.lit(first)), F.coalesce(day(F.col("_end") - 1), F.lit(last)))
    return rows.where(F.coalesce(F.col("_end") > F.col("_start"), F.lit(True))).withColumn("_day", F.explode(days)), first, last


def _looked_up(rows: DataFrame, found: tuple[DataFrame, int, int], time: str = "time") -> DataFrame:
    """Rows with the columns of the stretch that holds their time; a join by day, so no row meets all stretches."""
    listed, first, last = found
    day = F.greatest(F.lit(first), F.least(F.lit(last), F.floor(F.col(time) / 86400)))
    on = (day == F.col("_day")) & (F.col("_start").isNull() | (F.col(time) >= F.col("_start"))) & (F.col("_end").isNull() | (F.col(time) < F.col("_end")))
    return rows.join(listed, on, "left").drop("_day", "_start", "_end")


def neighbours(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (time) with next_open (first open at or after) and previous_close (last close at or before)."""
    w = Window.orderBy("at")
    opens = table.select(F.col("open").alias("at")).distinct().select("at", (F.lag("at").over(w) + 1).alias("since"))
    closes = table.select(F.col("close").alias("at")).distinct().select("at", F.lead("at").over(w).alias("until"))
    ahead = _by_day(opens, F.col("since"), F.col("at") + 1, F.col("at").alias("next_open"))
    behind = _by_day(closes, F.col("at"), F.col("until"), F.col("at").alias("previous_close"))
    return _looked_up(_looked_up(rows, ahead), behind)


def bar_close(bars: DataFrame, seconds: int, table: DataFrame | None = None) -> DataFrame:
    """Bars with close_time: open plus the interval, no later than the session's close where there is one."""
    end = F.col("time") + seconds
    if table is None:
        return bars.withColumn("close_time", end)
    joined = with_session(bars, table)
    return joined.withColumn("close_time", F.least(end, F.coalesce("session_close", end))).select(*bars.columns, "close_time")


def daily_close(bars: DataFrame, table: DataFrame, days: int = 1) -> DataFrame:
    """Bars with close_time: the last close of the trading date reached after `days` dates, the bar's own first."""
    dates = table.groupBy("trading_date").agg(F.max("close").alias("day_close"))
    ranked = dates.withColumn("k", F.dense_rank().over(Window.orderBy("trading_date")))
    ends = ranked.select((F.col("k") - (days - 1)).alias("k"), F.col("day_close").alias("close_time"))
    own = with_session(bars, table).join(F.broadcast(ranked.select("trading_date", "k")), "trading_date", "left")
    return own.join(F.broadcast(ends), "k", "left").select(*bars.columns, "close_time")


def weekly_close(bars: DataFrame, table: DataFrame, weeks: int = 1) -> DataFrame:
    """Bars with close_time: the last close before the ISO week that begins `weeks` weeks after the bar's own trading week."""
    week = F.floor(F.datediff(F.date_trunc("week", F.col("trading_date")), F.lit("1970-01-05")) / 7)
    closes = table.groupBy(week.alias("week")).agg(F.max("close").alias("close"))
    ahead = Window.orderBy("week").rangeBetween(0, weeks - 1)
    ends = closes.select("week", F.max("close").over(ahead).alias("close_time"))
    own = with_session(bars, table).withColumn("week", week)
    return own.join(F.broadcast(ends), "week", "left").select(*bars.columns, "close_time")


def countdown(now: Column, start: Column, end: Column) -> Column:
    state = F.when(now < start, "pending").when(now < end, "open").otherwise("closed")
    gone = F.greatest(F.lit(0), F.least(now, end) - start)
    return F.struct(state.alias("state"), gone.alias("elapsed"), (end - start - gone).alias("remaining"), (gone / F.nullif(end - start, F.lit(0))).alias("progress"))


def projected(rows: DataFrame, table: DataFrame, kinds: tuple[str, ...] = ("regular",)) -> DataFrame:
    """Rows with trading_time: open seconds of all earlier sessions plus those of the one at hand.

    Closed time collapses, so a row outside every session stands where the next one opens.
    """
    w = Window.orderBy("open")
    spans = table.where(F.col("kind").isin(*kinds)).select("open", "close", F.coalesce(F.sum(F.col("close") - F.col("open")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("close").over(w).alias("last_close"))
    found = _by_day(spans, F.col("last_close"), F.col("close"), F.col("open").alias("_open"), F.col("before").alias("_before"))
    return _looked_up(rows, found).withColumn("trading_time", F.col("_before") + F.greatest(F.lit(0), F.col("time") - F.col("_open"))).select(*rows.columns, "trading_time")


def unprojected(rows: DataFrame, table: DataFrame, kinds: tuple[str, ...] = ("regular",)) -> DataFrame:
    """The inverse: rows (trading_time) with the time it stands for; a boundary is the next session's open."""
    w = Window.orderBy("open")
    spans = table.where(F.col("kind").isin(*kinds)).select("open", (F.col("close") - F.col("open")).alias("size"), F.coalesce(F.sum(F.col("close") - F.col("open")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    found = _by_day(spans, F.col("before"), F.col("before") + F.col("size"), F.col("open").alias("_open"), F.col("before").alias("_before"))
    return _looked_up(rows, found, "trading_time").withColumn("time", F.col("_open") + F.col("trading_time") - F.col("_before")).select(*rows.columns, "time")
