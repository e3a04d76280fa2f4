"""Finding and paging comments, newest first."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.functions.text import preview
from voxtally.operators.comments import TIME
from voxtally.operators.ranking import global_row_number
from voxtally.operators.selection import rows_from

KEY = "comment_id"
PAGE_SIZE = 30  # fixed value
# Up to this many rows, texts included, a top-k may hold; deeper pages are found by counting.
HEAP_ROWS = 3_000

# The periods on offer.
PERIODS = {"All time": None, "Last 7 days": 7, "Last 30 days": 30, "Last 90 days": 90}


def search(df: DataFrame, query: str, text: str = "text", literal: bool = False) -> DataFrame:
    r"""Rows whose text matches the query in any case; NULL texts never do.

    The query is a regular expression, with classes like ``\w`` over all scripts, unless
    ``literal``. Spark itself tries it on one row first, so that a broken expression fails here, not
    in the middle of a job.
    """
    if not query:
        return df
    if literal:
        found = F.lower(text).contains(F.lower(F.lit(query)))
    else:
        df.sparkSession.range(1).select(F.lit("").rlike(f"(?iU){query}")).collect()
        found = F.col(text).rlike(f"(?iU){query}")
    return df.filter(F.coalesce(found, F.lit(False)))


def filter_label(df: DataFrame, sentiment: str = "All", label: str = "label") -> DataFrame:
    return df if sentiment == "All" else df.filter(F.col(label) == sentiment)


def filter_recent(
    df: DataFrame, period: str | int | None, as_of: datetime | None = None, ts: str = TIME
) -> DataFrame:
    """Rows of the last days, counted back from the instant ``as_of`` (default now).

    Stored times are in UTC, and so is an ``as_of`` without offset; one with an offset is converted.

    The cutoff is a literal, so on a stored column the filter reaches the file scan.
    """
    days = PERIODS[period] if isinstance(period, str) else period
    if days is None:
        return df
    until = as_of or datetime.now(UTC)
    if until.tzinfo is not None:
        until = until.astimezone(UTC).replace(tzinfo=None)
    cutoff = until - timedelta(days=days)
    return df.filter(F.col(ts) >= F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz"))


def newest_order(ts: str = TIME, key: str = KEY):
    return [F.col(ts).desc_nulls_last(), F.col(key).desc()]


def newest_first(df: DataFrame, ts: str = TIME, key: str = KEY) -> DataFrame:
    return df.orderBy(*newest_order(ts, key))


def page_count(total: int, size: int = PAGE_SIZE) -> int:
    return (total + size - 1) // size


def page(
    df: DataFrame,
    number: int = 1,
    size: int = PAGE_SIZE,
    total: int | None = None,
    ts: str = TIME,
    key: str = KEY,
) -> DataFrame:
    """One page of the newest-first list; a number out of range gives the nearest page.

    Pass ``total`` if the number of rows is known, it saves a count. Early pages are a
    distributed top-k. For deep ones the page's range of times is found by counting, without a sort or
    shuffle of the rows, and the page is a top-k of that range. :func:`page_after` walks on from a page
    without counts.
    """
    if number > 1:
        total = df.count() if total is None else total
        number = min(number, max(page_count(total, size), 1))
    number = max(number, 1)
    skipped = (number - 1) * size
    if skipped + size <= HEAP_ROWS:
        return newest_first(df, ts, key).offset(skipped).limit(size)
    if skipped >= total:
        return df.limit(0)
    rows, leading = rows_from(df, ts, key, skipped, size, HEAP_ROWS)
    return newest_first(rows, ts, key).offset(leading).limit(size)


def page_after(
    df: DataFrame, last_ts: datetime | None, last_key: int, size: int = PAGE_SIZE, ts: str = TIME, key: str = KEY
) -> DataFrame:
    """The page behind the row ``(last_ts, last_key)``: a plain filter and a top-k."""
    if last_ts is None:
        later = F.col(ts).isNull() & (F.col(key) < last_key)
    else:
        at = F.lit(last_ts.isoformat(sep=" ")).cast("timestamp_ntz")
        later = (F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < last_key)) | F.col(ts).isNull()
    return newest_first(df.filter(later), ts, key).limit(size)


def page_summary(df: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """``total, pages, page, first_row, last_row`` of a page; an empty list has page 1, rows 0."""
    counted = df.agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / size)
    number_column = F.greatest(F.lit(1), F.least(F.lit(number), F.col("pages")))
    first = (F.col("page") - 1) * size + 1
    return (
        counted.withColumn("pages", pages)
        .withColumn("page", number_column)
        .withColumn("first_row", F.when(F.col("total") > 0, first).otherwise(0))
        .withColumn("last_row", F.least(F.col("page") * size, F.col("total")))
    )


def number_pages(df: DataFrame, size: int = PAGE_SIZE, ts: str = TIME, key: str = KEY) -> DataFrame:
    """Every row with its place in the newest-first list and its page."""
    numbered = global_row_number(df, newest_order(ts, key))
    return numbered.withColumn("page", F.ceil(F.col("row_number") / size))


def latest(df: DataFrame, n: int = 5, ts: str = "ts", key: str = KEY) -> DataFrame:
    """The last ``n`` rows by time, oldest of them first."""
    last = newest_first(df, ts, key).limit(n)
    return last.orderBy(F.col(ts).asc_nulls_first(), F.col(key).asc())


def analysis_log(
    df: DataFrame, ts: str = TIME, text: str = "text", sentiment: str = "sentiment", model: str = "model", key: str = KEY
) -> DataFrame:
    """Rows of the analysis log: key, time, shortened text, sentiment and the scorer that gave it."""
    return df.select(
        F.col(key),
        F.col(ts).alias("ts"),
        preview(text).alias("text"),
        F.col(sentiment).alias("sentiment"),
        F.col(model).alias("model"),
    )
