import itertools
import random
from datetime import datetime, timedelta

import pytest

from voxtally.operators import trends
from voxtally.operators.trend_store import TrendStore

SCHEMA = "comment_id long, createTimeISO timestamp_ntz, label string"


def rows_of(count):
    rng = random.Random(3)
    start = datetime(2023, 11, 20)
    return [
        (i, None if rng.random() < 0.1 else start + timedelta(hours=rng.randint(0, 3000)), rng.choice(("Positive", "Negative", "Other", None)))
        for i in range(count)
    ]


@pytest.fixture(scope="module")
def rows():
    return rows_of(120)


def same(store, df):
    listed = lambda x: sorted(map(str, x.collect()))
    assert listed(store.monthly_trend()) == listed(trends.monthly_trend(df))
    assert listed(store.monthly_counts()) == listed(trends.monthly_counts(df))
    assert listed(store.sentiment_totals()) == listed(trends.sentiment_totals(df))


@pytest.mark.parametrize("order", [*itertools.permutations("abc"), "abacbca"])
def test_any_order_and_repetition_of_batches(spark, rows, tmp_path, order):
    """Batches overlap and repeat rows of their own."""
    parts = {"a": rows[:60] + rows[:9], "b": rows[40:100], "c": rows[90:] + rows[:5]}
    store = TrendStore(spark, str(tmp_path / "store"))
    for name in order:
        store.apply(spark.createDataFrame(parts[name], SCHEMA), name)
    same(store, spark.createDataFrame(rows, SCHEMA))


def test_a_batch_that_broke_off_is_applied_again(spark, rows, tmp_path, monkeypatch):
    store = TrendStore(spark, str(tmp_path / "store"))
    store.apply(spark.createDataFrame(rows[:50], SCHEMA), "a")
    put, failing = TrendStore._put, ["keys"]

    def broken(self, found, table, batch):
        if table in failing:
            raise OSError("lost")
        put(self, found, table, batch)

    monkeypatch.setattr(TrendStore, "_put", broken)
    rest = spark.createDataFrame(rows[30:], SCHEMA)
    with pytest.raises(OSError, match="lost"):
        store.apply(rest, "b")
    failing.clear()
    store.apply(rest, "b")
    same(store, spark.createDataFrame(rows, SCHEMA))


def test_empty_stores_and_batches(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    store = TrendStore(spark, str(tmp_path / "store"))
    same(store, empty)
    store.apply(empty, "a")
    same(store, empty)
    with pytest.raises(ValueError, match="id of a batch"):
        store.apply(empty, "a/b")


def test_reports_read_counts_only(spark, rows, tmp_path):
    store = TrendStore(spark, str(tmp_path / "store"))
    store.apply(spark.createDataFrame(rows, SCHEMA), "a")
    assert all("/counts/" in path for path in store.monthly_trend().inputFiles())
