"""Where comments come from: a stored table, or generated samples."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.labels import NEGATIVE, POSITIVE
from voxtally.sources.csv import read_csv

CANDIDATES = (
    "comments.parquet",
    "data/comments.parquet",
    "../comments.parquet",
    "comments.csv",
    "data/comments.csv",
    "../comments.csv",
)
SAMPLE_START, SAMPLE_END = date(2024, 1, 1), date(2024, 12, 27)
SAMPLE_POSITIVE = 0.67


def _read(spark: SparkSession, path: str) -> DataFrame:
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path)
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind in ("xls", "xlsx"):
        raise ValueError(f"{path}: spreadsheets have no Spark reader, save the sheet as CSV or Parquet")
    return spark.read.parquet(path)


def load_comments(
    spark: SparkSession, candidates: tuple[str, ...] = CANDIDATES, sample_if_missing: bool = False
) -> DataFrame:
    """The first of the candidate paths that exists, by its suffix as Parquet, CSV or JSON.

    A table without ``comment_id`` gets one by its place in the files; write it out once to keep
    the numbers. Nothing found is an error, unless samples are asked for instead.
    """
    for path in candidates:
        try:
            frame = _read(spark, path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        if "comment_id" not in frame.columns:
            frame = frame.withColumn("comment_id", F.monotonically_increasing_id())
        return frame
    if sample_if_missing:
        return sample_comments(spark)
    raise FileNotFoundError(f"none of {', '.join(candidates)} exists")


def sample_comments(
    spark: SparkSession, start: date = SAMPLE_START, end: date = SAMPLE_END, seed: int = 42
) -> DataFrame:
    """One comment per day with a random label, two thirds of them Positive."""
    days = spark.range((end - start).days + 1)
    label = F.when(F.rand(seed) < SAMPLE_POSITIVE, POSITIVE).otherwise(NEGATIVE)
    return days.select(
        F.col("id").alias("comment_id"),
        F.date_add(F.lit(start), F.col("id").cast("int")).cast("timestamp_ntz").alias("createTimeISO"),
        label.alias("label"),
        F.concat(F.lit("Sample comment "), F.col("id").cast("string")).alias("text"),
    )
