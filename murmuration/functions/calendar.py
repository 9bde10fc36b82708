"""Calendar fields, from ``yyyy-MM-dd HH:mm[:ss]`` text or from a timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = range(1, 8)  # Monday is 1
MINUTE_SLOTS = range(6)


def day_text(stamp: Column) -> Column:
    return F.split(stamp, " ")[0]


def time_text(stamp: Column) -> Column:
    return F.split(stamp, " ")[1]


def hour_text(time: Column) -> Column:
    return F.split(time, ":")[0]


def minute_text(time: Column) -> Column:
    return F.split(time, ":")[1]


def weekday_name(day: Column) -> Column:
    """``MONDAY`` ... ``SUNDAY``."""
    return F.upper(F.date_format(day, "EEEE"))


def month_name(day: Column) -> Column:
    """``JANUARY`` ... ``DECEMBER``."""
    return F.upper(F.date_format(day, "MMMM"))


def iso_weekday(stamp: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(stamp) + F.lit(1)


def minute_slot(stamp: Column, minutes: int = 10) -> Column:
    return F.floor(F.minute(stamp) / F.lit(minutes)).cast("int")


def hour_label(hour: Column) -> Column:
    """``00:00`` ... ``23:00``."""
    return F.format_string("%02d:00", hour)


def run_stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
