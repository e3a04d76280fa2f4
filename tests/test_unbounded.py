"""Small tables that turn out not to be small are joined by a shuffle, with the same results."""

import pytest
from pyspark.sql import functions as F

from voxtally import session
from voxtally.operators import browse, classes, splits, words


@pytest.fixture
def nothing_is_small(monkeypatch, spark):
    monkeypatch.setattr(session, "bounded_table", lambda df, *bounds: None)
    monkeypatch.setattr(splits, "bounded_table", lambda df, *bounds: None)
    monkeypatch.setattr(classes, "bounded_table", lambda df, *bounds: None)
    monkeypatch.setattr(words, "bounded_table", lambda df, *bounds: None)
    monkeypatch.setattr(classes, "bounded_broadcast", lambda df: df)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def skewed(spark):
    label = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 7).cast("string"))
    return spark.range(2000).select("id", label.alias("label"), F.concat_ws(" ", F.lit("the"), F.col("id") % 9, label).alias("text"))


@pytest.fixture(scope="module")
def bounded(spark, skewed):
    return results(skewed)


def results(frame):
    timed = frame.select(F.col("id").alias("comment_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("createTimeISO"))
    return {
        "split": rows(splits.stratified_split(frame.drop("text"), "id", "label", 0.3, stratify=True, bucket_rows=5)),
        "three": rows(splits.three_way_split(frame.drop("text"), "id", "label")),
        "weights": rows(classes.with_class_weights(frame.select("id", "label"), "label")),
        "codes": rows(classes.encode_labels(frame.select("id", "label"), "label", classes.label_index(frame, "label"))),
        "encoded": rows(words.encode_fixed_length(frame, words.vocabulary(frame, size=5), "id", max_length=6)),
        "pages": rows(browse.number_pages(timed)),
    }


def test_same_results_without_broadcast(skewed, bounded, nothing_is_small):
    assert results(skewed) == bounded


def test_bound_is_checked(spark):
    frame = spark.range(100)
    assert session.bounded_table(frame, max_rows=100).num_rows == 100
    assert session.bounded_table(frame, max_rows=99) is None
    assert session.bounded_table(frame, max_bytes=50) is None
    assert session.bounded_broadcast(frame, max_rows=10) is frame


def test_written_table(spark):
    frame = spark.range(10).select("id", F.rand().alias("x"))
    table = session.written(frame)
    assert table.dtypes == frame.dtypes and rows(table) == rows(table)
    assert session.written(frame.limit(0)).count() == 0
