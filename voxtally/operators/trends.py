"""Counts over the enriched comments: totals, months, trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.functions.labels import NEGATIVE, POSITIVE
from voxtally.functions.numbers import percent
from voxtally.functions.times import month_start, month_text
from voxtally.operators.comments import TIME


def _one():
    return F.count(F.lit(1))


def sentiment_totals(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: total, per sentiment count and percent; zeros for an empty table."""
    counted = df.agg(
        _one().alias("total"),
        F.count_if(F.col(label) == POSITIVE).alias("positive"),
        F.count_if(F.col(label) == NEGATIVE).alias("negative"),
    )
    return with_percents(counted)


def with_percents(counted: DataFrame) -> DataFrame:
    return counted.withColumns(
        {
            "positive_percent": percent("positive", "total"),
            "negative_percent": percent("negative", "total"),
        }
    )


def monthly_counts(df: DataFrame, ts: str = TIME) -> DataFrame:
    """Rows per calendar month; rows without a time belong to none."""
    month = month_start(ts)
    return df.filter(F.col(ts).isNotNull()).groupBy(month.alias("month_start")).agg(_one().alias("n"))


def monthly_peak(df: DataFrame, ts: str = TIME) -> DataFrame:
    """The largest monthly count, 0 for an empty table."""
    return monthly_counts(df, ts).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_count"))


def monthly_trend(df: DataFrame, ts: str = TIME, label: str = "label", month_only_order: bool = False) -> DataFrame:
    """Positive and Negative counts per month, in calendar order.

    Conditional counts on the month give the pivoted table with one small shuffle; the month
    texts are made from the finished groups. ``month_only_order`` sorts by month number alone,
    so that several years interleave.
    """
    grouped = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(month_start(ts).alias("month_start"))
        .agg(
            F.count_if(F.col(label) == POSITIVE).alias(POSITIVE),
            F.count_if(F.col(label) == NEGATIVE).alias(NEGATIVE),
        )
    )
    return named_months(grouped, month_only_order)


def named_months(grouped: DataFrame, month_only_order: bool = False) -> DataFrame:
    """The trend of finished groups ``month_start, Positive, Negative``."""
    named = grouped.select(
        F.month("month_start").alias("month_num"),
        month_text("month_start").alias("month"),
        POSITIVE,
        NEGATIVE,
        "month_start",
    )
    order = ["month_num", "month"] if month_only_order else ["month_start"]
    return named.orderBy(*order).drop("month_start")
