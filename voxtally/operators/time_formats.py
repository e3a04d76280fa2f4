"""Finding out in which formats a column of texts writes its times.

A text fits at most one layout, by its separators and digits. In layouts like 03/04/2024 day and month may
stand in either order: each value that makes sense in one order only is a vote for it. All votes come from one
aggregate over the column, one row a layout, and votes of several batches are added up. The order with more votes
holds for the whole layout; without any, or with equally many, a default does. Values that
do not fit their layout's order, or no layout at all, are rejected and counted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.columns import as_column
from voxtally.functions.times import parse_timestamp

DAY_FIRST, MONTH_FIRST, ONLY = "day first", "month first", "only"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_WEEKDAY = r"(?:(?:[Mm]on|[Tt]ue|[Ww]ed|[Tt]hu|[Ff]ri|[Ss]at|[Ss]un)[a-z]*,? +)?"
#: Hour, minute, second, fraction and half of the day; all of it may be absent.
_CLOCK = r"(?:,? +|T)(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6}))?)?(?: ?([AaPp])\.?[Mm]\.?)?"


@dataclass(frozen=True)
class Layout:
    """A pattern whose first three groups are the parts of a date in the order ``parts``, then those of a clock."""

    name: str
    date: str
    parts: str
    clock: str = rf"(?:{_CLOCK})?"

    @property
    def pattern(self) -> str:
        return f"^{self.date}{self.clock}$"

    @property
    def orders(self) -> tuple[str, ...]:
        return (DAY_FIRST, MONTH_FIRST) if self.parts == "??y" else (ONLY,)

    def reading(self, text: Column, order: str = ONLY) -> Column:
        """The time that the text tells in this layout and order, NULL if it tells none."""
        group = lambda i: F.regexp_extract(text, self.pattern, i)
        parts = {ONLY: self.parts, DAY_FIRST: "dmy", MONTH_FIRST: "mdy"}[order]
        cells = {part: group(i) for i, part in enumerate(parts, 1)}
        number = lambda c: c.try_cast("int")
        year = number(cells["y"])
        year = F.when(F.length(cells["y"]) == 2, year + F.when(year < 69, 2000).otherwise(1900)).otherwise(year)
        if "n" in parts:
            name = F.lower(cells["n"])
            begins = F.transform(F.lit(list(MONTHS)), lambda month: F.startswith(month, name))  # three letters or more
            month = F.nullif(F.array_position(begins, True), F.lit(0)).cast("int")
        else:
            month = number(cells["m"])
        hour, half = F.coalesce(number(group(4)), F.lit(0)), F.lower(group(8))
        clock = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
        second = F.concat(F.coalesce(F.nullif(group(6), F.lit("")), F.lit("0")), F.lit("."), F.rpad(group(7), 6, "0"))
        found = F.try_make_timestamp_ntz(
            year, month, number(cells["d"]), clock, F.coalesce(number(group(5)), F.lit(0)), second.try_cast("decimal(16,6)")
        )
        return F.when(text.rlike(self.pattern), found)


LAYOUTS = (
    Layout("1/2/2024", r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})", "??y"),
    Layout("1-2-2024", r"(\d{1,2})-(\d{1,2})-(\d{4}|\d{2})", "??y"),
    Layout("1.2.2024", r"(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})", "??y"),
    Layout("2024/1/2", r"(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "ymd"),
    Layout("2 Jan 2024", rf"{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?[ -]+([A-Za-z]{{3,9}})\.?,?[ -]+(\d{{4}})", "dny"),
    Layout("Jan 2, 2024", rf"{_WEEKDAY}([A-Za-z]{{3,9}})\.? +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}})", "ndy"),
    Layout("20240102", r"(\d{4})(\d{2})(\d{2})", "ymd", r"(?:[T ]?(\d{2})(\d{2})(?:(\d{2})(?:\.(\d{1,6}))?)?)?()"),
)
ISO = "2024-01-02"
VOTES = ("n", "day_first", "month_first", "only_day_first", "only_month_first")


def _layout_of(text: Column) -> Column:
    """The name of the layout that a text fits, NULL for none."""
    found = F.when(parse_timestamp(text).isNotNull(), ISO)
    for layout in LAYOUTS:
        found = found.when(text.rlike(layout.pattern), layout.name)
    return found


def votes(df: DataFrame, column: str) -> DataFrame:
    """``layout, n, day_first, month_first, only_day_first, only_month_first``, from one pass.

    ``n`` texts fit the layout, so many make sense with either order, and so many with one only. In a layout without a
    choice both orders are the same. The row without a layout counts the texts that fit none.
    """
    text, name = F.col("text"), F.col("layout")
    rows = df.select(F.trim(F.col(column).cast("string")).alias("text")).filter("text is not null")
    rows = rows.withColumn("layout", _layout_of(text))
    first, second = F.when(name == ISO, True), F.when(name == ISO, True)
    for layout in LAYOUTS:
        first = first.when(name == layout.name, layout.reading(text, layout.orders[0]).isNotNull())
        second = second.when(name == layout.name, layout.reading(text, layout.orders[-1]).isNotNull())
    rows = rows.select("layout", first.otherwise(False).alias("day"), second.otherwise(False).alias("month"))
    counts = ("true", "day", "month", "day and not month", "month and not day")
    return rows.groupBy("layout").agg(*(F.count_if(F.expr(x)).alias(vote) for vote, x in zip(VOTES, counts, strict=True)))


def merged(*parts: DataFrame) -> DataFrame:
    """The votes of several batches, added up."""
    together = reduce(DataFrame.unionByName, parts)
    return together.groupBy("layout").agg(*(F.sum(vote).alias(vote) for vote in VOTES))


def decided(counted: DataFrame, day_first: bool = False) -> DataFrame:
    """``layout, order, parsed, rejected, undecided``: the order that holds in each layout that occurs.

    ``undecided`` texts make sense in both orders. ``day_first`` is the default where votes do not tell.
    """
    lead = F.col("only_day_first") - F.col("only_month_first")
    by_day = (lead > 0) | ((lead == 0) & F.lit(day_first))
    two = F.col("layout").isin([x.name for x in LAYOUTS if len(x.orders) == 2])
    order = F.when(two & by_day, DAY_FIRST).when(two, MONTH_FIRST).when(F.col("layout").isNotNull(), ONLY)
    parsed = F.when(by_day, F.col("day_first")).otherwise(F.col("month_first"))
    both = F.col("day_first") - F.col("only_day_first")
    return counted.filter("n > 0").select(
        "layout",
        order.alias("order"),
        parsed.alias("parsed"),
        (F.col("n") - parsed).alias("rejected"),
        F.when(two, both).otherwise(0).alias("undecided"),
    )


def parse_inferred(df: DataFrame, column: str, orders: dict[str, str] | None = None, day_first: bool = False) -> DataFrame:
    """The column as ``timestamp_ntz``, read in the layouts and orders that its own texts tell; NULL where rejected.

    ``orders`` names the order of layouts if it is known already (from other batches, say).
    """
    if orders is None:
        orders = {r.layout: r.order for r in decided(votes(df, column), day_first).collect() if r.layout}
    text = F.trim(as_column(column).cast("string"))
    found = [parse_timestamp(text)] if ISO in orders else []
    found += [layout.reading(text, orders[layout.name]) for layout in LAYOUTS if layout.name in orders]
    return df.withColumn(column, F.coalesce(*found) if found else F.lit(None).cast("timestamp_ntz"))
