"""Calendar columns of an activity row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_TIME_FORMAT = "MM/dd/yyyy HH:mm:ss"
DAY_ZERO = "2009-12-28"
WORK_FROM = 7 * 60 + 30
WORK_TO = 17 * 60 + 30


def parse_log_time(text: Column) -> Column:
    return F.to_timestamp_ntz(text, F.lit(LOG_TIME_FORMAT))


def sunday_on_or_before(ts: Column) -> Column:
    day = F.to_date(ts)
    return F.date_sub(day, F.dayofweek(day) - 1)


def week_number(ts: Column, first_sunday: Column) -> Column:
    return F.floor(F.datediff(F.to_date(ts), first_sunday) / 7).cast("int")


def day_number(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit(DAY_ZERO).cast("date"))


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def after_hours(ts: Column) -> Column:
    """Minute of day outside 07:30..17:30; seconds do not count, so 17:30:59 is inside."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (minute < WORK_FROM) | (minute > WORK_TO)


def weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def time_code(ts: Column) -> Column:
    """1 work hours, 2 after hours, 3 weekend, 4 weekend after hours."""
    return F.lit(1) + after_hours(ts).cast("int") + F.lit(2) * weekend(ts).cast("int")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def hour_fraction(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / F.lit(60)
