"""Timestamps: parsing, the calendar parts of a comment, display texts.

Comments carry wall-clock times without zone. All parts are taken from the date or the clock
fields directly, so that the session's time zone and its clock changes have no say.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally.functions.columns import as_column


def utc_clock(instant: Column | str) -> Column:
    """A timestamp with zone as the clock time in UTC."""
    micros = F.unix_micros(as_column(instant))
    seconds = (micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def parse_timestamp(text: Column | str) -> Column:
    """Text to ``timestamp_ntz``; NULL where it is no timestamp.

    A text with a UTC offset is moved to UTC, so that all values compare on one clock.
    """
    column = F.trim(as_column(text))
    has_offset = column.rlike(r"\d{2}:\d{2}.*(Z|[+-]\d{2}(:?\d{2})?)$")
    moved = utc_clock(column.try_cast("timestamp"))
    return F.when(has_offset, moved).otherwise(column.try_cast("timestamp_ntz"))


def month_start(ts: Column | str) -> Column:
    """The first day of the month, as a date."""
    return F.trunc(F.to_date(as_column(ts)), "month")


def _day_format(ts: Column | str, pattern: str) -> Column:
    return F.date_format(F.to_date(as_column(ts)), pattern)


def month_text(ts: Column | str) -> Column:
    """``Jan 2024``"""
    return _day_format(ts, "MMM yyyy")


def month_short(ts: Column | str) -> Column:
    return _day_format(ts, "MMM")


def day_name(ts: Column | str) -> Column:
    return _day_format(ts, "EEEE")


def display_time(ts: Column | str) -> Column:
    """``Jan 05, 2024 at 03:07 PM``"""
    column = as_column(ts)
    hour = F.hour(column)
    clock = F.format_string("%02d:%02d", (hour + 11) % 12 + 1, F.minute(column))
    half = F.when(hour < 12, F.lit(" AM")).otherwise(F.lit(" PM"))
    return F.concat(_day_format(column, "MMM dd, yyyy 'at' "), clock, half)


def elapsed_text(seconds: Column | str) -> Column:
    """Seconds as ``H:MM:SS``, from a day on with ``N day(s), `` before it; halves round to even."""
    whole = F.bround(as_column(seconds).cast("double"), 0).cast("long")
    days = F.floor(whole / 86_400)
    rest = F.pmod(whole, F.lit(86_400))
    clock = F.format_string(
        "%d:%02d:%02d",
        F.floor(rest / 3600),
        F.floor(rest % 3600 / 60),
        rest % 60,
    )
    unit = F.when(F.abs(days) == 1, F.lit(" day, ")).otherwise(F.lit(" days, "))
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), unit, clock))
