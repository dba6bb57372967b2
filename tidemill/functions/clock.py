"""Clock rules of the currency market. Times are UTC without a zone (timestamp_ntz).

The market week runs from Sunday 17:00 to Friday 17:00 in New York. Summer time changes fall in the
weekend, so every week has exactly five days of open time, and open time since a fixed week has a closed form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
WEEK_OPEN_SECONDS = 5 * 86400
SESSION_HOURS = (7, 12, 16, 22)


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a time without zone."""
    return F.floor(epoch_micros(ts) / 1_000_000).cast("long")


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(F.to_timestamp_ltz(ts))


def at_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def new_york(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(NEW_YORK), ts)


def from_new_york(local: Column) -> Column:
    return F.convert_timezone(F.lit(NEW_YORK), F.lit("UTC"), local)


def trading_day(ts: Column) -> Column:
    """The New York date, from 17:00 on the next one, Saturdays and Sundays moved to Monday."""
    day = F.to_date(new_york(ts) + F.expr("INTERVAL 7 HOURS"))
    return F.date_add(day, F.when(F.weekday(day) == 5, 2).when(F.weekday(day) == 6, 1).otherwise(0))


def fx_day_start(ts: Column) -> Column:
    """The last 17:00 in New York, as UTC."""
    local = F.date_trunc("day", new_york(ts) - F.expr("INTERVAL 17 HOURS")).cast("timestamp_ntz")
    return from_new_york(local + F.expr("INTERVAL 17 HOURS"))


def week_sunday(ts: Column) -> Column:
    """The New York date of the Sunday whose 17:00 opened the week."""
    day = F.to_date(new_york(ts) - F.expr("INTERVAL 17 HOURS"))
    return F.date_sub(day, (F.weekday(day) + 1) % 7)


def fx_week_start(ts: Column) -> Column:
    return from_new_york(week_sunday(ts).cast("timestamp_ntz") + F.expr("INTERVAL 17 HOURS"))


def session_start(ts: Column) -> Column:
    """The last of 07:00, 12:00, 16:00 and 22:00 UTC."""
    hour = F.hour(ts)
    back = F.lit(2) + hour
    for h in SESSION_HOURS:
        back = F.when(hour >= h, hour - h).otherwise(back)
    start = F.date_trunc("hour", ts).cast("timestamp_ntz")
    return start - F.make_dt_interval(hours=back)


def open_seconds(ts: Column) -> Column:
    """Seconds of open market from a fixed week to ts; differences count open time between two moments."""
    sunday = week_sunday(ts)
    weeks = F.floor(F.datediff(sunday, F.lit("1969-12-28").cast("date")) / 7)
    within = epoch(ts) - epoch(fx_week_start(ts))
    return weeks * WEEK_OPEN_SECONDS + F.greatest(F.lit(0), F.least(within, F.lit(WEEK_OPEN_SECONDS)))


def open_seconds_between(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), open_seconds(end) - open_seconds(start))


def expected_minutes(month: Column) -> Column:
    """Minutes of open market in the month that begins on a date."""
    first = month.cast("timestamp_ntz")
    return F.floor((open_seconds(F.add_months(month, 1).cast("timestamp_ntz")) - open_seconds(first)) / 60)


def is_summer_time(ts: Column) -> Column:
    """Whether New York is four hours behind."""
    return epoch(new_york(ts)) - epoch(ts) == -4 * 3600


def fixed_est_to_utc(ts: Column) -> Column:
    """A clock five hours behind UTC all year."""
    return ts + F.expr("INTERVAL 5 HOURS")
