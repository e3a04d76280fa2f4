"""Raw comments to the enriched table all reports read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtally.functions.labels import canonical_label
from voxtally.functions.times import day_name, month_short, month_text, parse_timestamp, utc_clock

TIME = "createTimeISO"


def with_timestamps(df: DataFrame, ts: str = TIME) -> DataFrame:
    """The time column as ``timestamp_ntz``, whatever it was read as."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.TimestampNTZType):
        return df
    if isinstance(kind, T.TimestampType):
        return df.withColumn(ts, utc_clock(ts))
    if isinstance(kind, T.DateType):
        return df.withColumn(ts, F.col(ts).cast("timestamp_ntz"))
    return df.withColumn(ts, parse_timestamp(F.col(ts).cast("string")))


def rejected_timestamps(df: DataFrame, ts: str = TIME) -> DataFrame:
    """One row ``rejected``: how many non-NULL texts are no timestamp."""
    bad = F.col(ts).isNotNull() & parse_timestamp(F.col(ts).cast("string")).isNull()
    return df.agg(F.count_if(bad).alias("rejected"))


def enrich_comments(df: DataFrame, ts: str = TIME, label: str = "label") -> DataFrame:
    """Add date, month, hour and day name and bring the label to Positive/Negative."""
    when = F.col(ts)
    return with_timestamps(df, ts).withColumns(
        {
            "date": F.to_date(when),
            "month": month_text(when),
            "hour": F.hour(when),
            "day_name": day_name(when),
            label: canonical_label(label),
            "month_short": month_short(when),
            "month_num": F.month(when),
        }
    )
