"""Deep pages by counting against a sort of everything."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voxtally.operators import browse, selection

KINDS = {"timestamp_ntz": datetime, "timestamp": datetime, "date": date}


def rows_of(seed, count, kind, keys="spread"):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        at = datetime(1969, 12, 25) + timedelta(microseconds=rng.choice((rng.randint(0, 10**15), rng.randint(0, 50), 7)))
        stamp = None if rng.random() < 0.1 else at.date() if kind == "date" else at
        out.append((stamp, {"spread": rng.randint(-(2**62), 2**62) * 2 + i % 2, "dense": i, "text": f"k{i:05d}"}[keys]))
    return out


def newest(rows):
    timed = sorted((r for r in rows if r[0] is not None), reverse=True)
    return timed + sorted((r for r in rows if r[0] is None), key=lambda r: r[1], reverse=True)


@pytest.mark.parametrize(
    ("kind", "keys"), [("timestamp_ntz", "spread"), ("timestamp_ntz", "text"), ("timestamp", "dense"), ("date", "dense")]
)
def test_pages_of_any_depth(spark, monkeypatch, kind, keys):
    monkeypatch.setattr(browse, "HEAP_ROWS", 20)
    monkeypatch.setattr(selection, "RANGES", 16)
    rows = rows_of(5, 400, kind, keys)
    df = spark.createDataFrame(rows, f"t {kind}, k {'string' if keys == 'text' else 'long'}").withColumn("x", F.lit(1))
    want = newest(rows)
    last = -(-len(rows) // 7)
    for number in (3, 4, 9, 20, 41, last - 8, last - 1, last, last + 5):
        got = [tuple(r)[:2] for r in browse.page(df, number, 7, ts="t", key="k").collect()]
        at = (min(number, last) - 1) * 7
        assert got == want[at : at + 7], number


@pytest.mark.parametrize("keys", ["dense", "text"])
def test_a_hot_instant(spark, monkeypatch, keys):
    """A third of the rows share one time."""
    monkeypatch.setattr(browse, "HEAP_ROWS", 25)
    rows = [(datetime(2024, 1, 1, 12) if i % 3 == 0 else datetime(2024, 1, 1) + timedelta(minutes=i), i) for i in range(900)]
    rows = [(t, f"{k:04d}" if keys == "text" else k) for t, k in rows]
    df = spark.createDataFrame(rows, f"t timestamp_ntz, k {'string' if keys == 'text' else 'long'}")
    want = newest(rows)
    for number in (8, 14, 20, 30, 45):
        assert [tuple(r) for r in browse.page(df, number, 20, ts="t", key="k").collect()] == want[(number - 1) * 20 : number * 20]


def test_times_without_zone_do_not_depend_on_the_sessions(spark, monkeypatch):
    """Hours that a zone's clock change leaves out or repeats keep their order."""
    monkeypatch.setattr(browse, "HEAP_ROWS", 5)
    rows = [(datetime(2024, 3, 31, 1) + timedelta(minutes=10 * i), i) for i in range(40)]
    rows += [(datetime(2024, 10, 27, 1) + timedelta(minutes=10 * i), 100 + i) for i in range(40)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.createDataFrame([(t.isoformat(sep=" "), k) for t, k in rows], "s string, k long")
        df = df.select(F.col("s").cast("timestamp_ntz").alias("t"), "k")
        got = [r.k for n in range(2, 17) for r in browse.page(df, n, 5, ts="t", key="k").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [k for _, k in newest(rows)][5:]


def test_a_deep_page_sorts_and_shuffles_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    stamp = F.timestamp_micros(F.col("id") * 997_000_000).cast("timestamp_ntz")
    spark.range(40_000).select(stamp.alias("t"), F.col("id").alias("k"), F.lit("text").alias("x")).write.parquet(path)
    df = spark.read.parquet(path)
    page = browse.page(df, 900, ts="t", key="k")
    assert [r.k for r in page.collect()] == [40_000 - 1 - i for i in range(899 * 30, 900 * 30)]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert "GreaterThanOrEqual(t," in plan and "LessThanOrEqual(t," in plan


def test_empty_tables_and_pages_out_of_range(spark, monkeypatch):
    monkeypatch.setattr(browse, "HEAP_ROWS", 5)
    empty = spark.createDataFrame([], "t timestamp_ntz, k long")
    assert browse.page(empty, 9, ts="t", key="k").count() == 0
    few = spark.createDataFrame([(None, i) for i in range(30)], "t timestamp_ntz, k long")
    assert [r.k for r in browse.page(few, 3, 10, ts="t", key="k").collect()] == list(range(9, -1, -1))
    assert browse.page(few, 9, 10, total=1000, ts="t", key="k").count() == 0
    with pytest.raises(TypeError, match="no time"):
        browse.page(few.select(F.col("k").alias("t"), "k"), 3, 10, ts="t", key="k")
