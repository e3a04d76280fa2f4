"""Scoring comments as they arrive. The rules are plain columns, so a stream is scored by the
same code as a table, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxtally.functions.scoring import score_texts
from voxtally.operators.browse import KEY, analysis_log
from voxtally.operators.comments import TIME, with_timestamps


def score_stream(stream: DataFrame, text: str = "text", ts: str = TIME, key: str = KEY) -> DataFrame:
    """Log rows (key, time, shortened text, sentiment, scorer) of a stream of comments."""
    scored = score_texts(with_timestamps(stream, ts), text).withColumns(
        {"sentiment": F.col("rule_sentiment"), "model": F.lit("Rule-Based")}
    )
    return analysis_log(scored, ts=ts, text=text, key=key)


def append_log_stream(log: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append the scored stream to the log table, each row once even over restarts."""
    writer = log.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
