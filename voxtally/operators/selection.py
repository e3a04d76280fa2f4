"""Order statistics by descent: the part of a table that begins at a given place of the newest-first order.

Rows are not sorted to find a place. They are counted by ranges of time, the range that holds the place is looked
into again, and so on until it has few rows. Each look is one aggregate with a bounded number of groups, and from the
second on its range of times is a filter that reaches the file scan. Among very many rows of one instant the
descent goes on over ranges of the key.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, TimestampNTZType, TimestampType

from voxtally.operators.ranking import global_row_number

#: Ranges that a look divides the rows into.
RANGES = 1024
EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Axis:
    """A column whose values are whole numbers to count by, and are compared as literals of the column's type."""

    name: str
    number: Column
    literal: object

    def between(self, low: int, high: int) -> Column:
        column = F.col(self.name)
        return (column >= self.literal(low)) & (column <= self.literal(high))


def time_axis(df: DataFrame, name: str) -> Axis:
    """Microseconds since 1970; of a time without zone, or a date, without any regard to zones."""
    kind, column = df.schema[name].dataType, F.col(name)
    if isinstance(kind, TimestampType):
        return Axis(name, F.unix_micros(column), lambda x: F.timestamp_micros(F.lit(x)))
    days = F.datediff(column, F.lit("1970-01-01")).cast("long") * 86_400_000_000
    if isinstance(kind, DateType):
        return Axis(name, days, lambda x: F.lit((EPOCH + timedelta(microseconds=x)).date().isoformat()).cast("date"))
    if not isinstance(kind, TimestampNTZType):
        raise TypeError(f"{name} is no time but {kind.simpleString()}")
    seconds = F.hour(column).cast("long") * 3600 + F.minute(column) * 60
    number = days + seconds * 1_000_000 + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("long")
    shown = lambda x: F.lit((EPOCH + timedelta(microseconds=x)).isoformat(sep=" ")).cast("timestamp_ntz")
    return Axis(name, number, shown)


def key_axis(name: str) -> Axis:
    return Axis(name, F.col(name).cast("long"), F.lit)


@dataclass
class Found:
    """The range ``low`` to ``high`` that holds a place, with ``rows`` rows; ``before`` rows lie above it.

    ``floor`` is a value down to which enough rows follow the place, None if only the whole table may do.
    """

    low: int
    high: int
    before: int
    rows: int
    floor: int | None = None


def _floor_div(number: Column, width: int) -> Column:
    """Whole division that rounds down, of any long; Spark's own rounds towards zero."""
    if width == 1:
        return number
    below = (number < 0) & (number % F.lit(width) != 0)
    return F.call_function("div", number, F.lit(width)) - F.when(below, 1).otherwise(0)


def descend(df: DataFrame, axis: Axis, low: int, high: int, place: int, size: int, few: int) -> Found | None:
    """The range of at most ``few`` rows, or of one value, that holds the ``place``-th largest row (from 0).

    None if there are not so many rows.
    """
    found = Found(low, high, 0, -1)
    while True:
        width = -(-(found.high - found.low + 1) // RANGES)
        inside = df.filter(axis.between(found.low, found.high))
        counted = inside.groupBy(_floor_div(axis.number, width).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
        before, held = found.before, None
        for row in sorted(counted, key=lambda r: -r.part):
            start = max(row.part * width, found.low)
            if held is None and before + row.n > place:
                held = Found(start, min((row.part + 1) * width - 1, found.high), before, row.n, found.floor)
            before += row.n
            if held is not None and before >= place + size:
                held.floor = start
                break
        if held is None or held.rows <= few or width == 1:
            return held
        found = held


def rows_from(df: DataFrame, ts: str, key: str, place: int, size: int, few: int) -> tuple[DataFrame, int]:
    """Rows of ``df`` that hold the ``size`` rows from ``place`` on in the newest-first order, and how many lead them.

    That order is by ``ts`` and then ``key``, both falling, rows without time last.
    """
    axis, stamp = time_axis(df, ts), F.col(ts)
    timed, low, high = df.agg(F.count(ts), F.min(axis.number), F.max(axis.number)).first()
    if place >= timed:
        untimed = df.filter(stamp.isNull())
        limit, before = _key_limit(untimed, key, place - timed, size, few)
        return untimed.filter(limit), place - timed - before
    found = descend(df, axis, low, high, place, size, few)
    if found is None:
        return df.limit(0), 0
    kept = stamp <= axis.literal(found.high)
    if found.rows > few:  # one instant
        same = stamp == axis.literal(found.high)
        limit, before = _key_limit(df.filter(same), key, place - found.before, size, few)
        kept &= ~same | limit
        found.before += before
    if found.floor is not None:
        return df.filter(kept & (stamp >= axis.literal(found.floor))), place - found.before
    return df.filter(kept | stamp.isNull()), place - found.before


def _key_limit(rows: DataFrame, key: str, place: int, size: int, few: int) -> tuple[Column, int]:
    """A condition on the key that the rows from ``place`` on fulfil, and how many rows that do not stand before them."""
    if isinstance(rows.schema[key].dataType, IntegralType):
        low, high = rows.agg(F.min(key), F.max(key)).first()
        found = None if low is None else descend(rows, key_axis(key), low, high, place, size, few)
        return (F.lit(False), place) if found is None else (F.col(key) <= F.lit(found.high), found.before)
    before = place // few * few  # keys that are no whole numbers are numbered, of this instant only
    numbered = global_row_number(rows.select(key), [F.col(key).desc()], "_row")
    first = numbered.filter(F.col("_row") == before + 1).first()
    return (F.lit(False), place) if first is None else (F.col(key) <= F.lit(first[key]), before)
