from datetime import datetime

import pytest

from voxtally.operators import time_formats as op


def column(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string")


def parsed(spark, texts, **options):
    return [r.t for r in op.parse_inferred(column(spark, texts), "t", **options).orderBy("i").collect()]


CASES = {
    "2024-03-04 05:06:07": datetime(2024, 3, 4, 5, 6, 7),
    "2024-03-04T05:06:07+02:00": datetime(2024, 3, 4, 3, 6, 7),
    "2024/3/4 5:06": datetime(2024, 3, 4, 5, 6),
    "Mon, 04 Mar 2024 05:06:07": datetime(2024, 3, 4, 5, 6, 7),
    "4th March 2024": datetime(2024, 3, 4),
    "Mar 4, 2024 05:06 PM": datetime(2024, 3, 4, 17, 6),
    "Sept 30, 2024 12:00 am": datetime(2024, 9, 30),
    "4-Mar-2024 12:30 p.m.": datetime(2024, 3, 4, 12, 30),
    "20240304": datetime(2024, 3, 4),
    "20240304T050607.25": datetime(2024, 3, 4, 5, 6, 7, 250000),
    "29 Feb 2023": None, "Foo 4, 2024": None, "Mar 4, 2024 13:06 PM": None, "Mar 4, 2024 0:06 AM": None, "20241304": None,
    "2024/13/1": None, "tomorrow": None, "": None, "4 Ma 2024": None, "1/2/024": None, "3/4/2024 25:00": None,
}


def test_layouts(spark):
    assert dict(zip(CASES, parsed(spark, list(CASES)), strict=True)) == CASES


@pytest.mark.parametrize("sep", "/-.")
def test_votes_decide_the_order(spark, sep):
    at = lambda day, month: f"{day}{sep}{month}{sep}2024 10:00"
    by_day = [at(3, 4), at(25, 4), at(26, 5), at(4, 27)]
    assert parsed(spark, by_day) == [datetime(2024, 4, 3, 10), datetime(2024, 4, 25, 10), datetime(2024, 5, 26, 10), None]
    by_month = [at(3, 4), at(25, 4), at(4, 27), at(5, 28)]
    assert parsed(spark, by_month) == [datetime(2024, 3, 4, 10), None, datetime(2024, 4, 27, 10), datetime(2024, 5, 28, 10)]
    assert parsed(spark, [at(3, 4)]) == [datetime(2024, 3, 4, 10)]
    assert parsed(spark, [at(3, 4)], day_first=True) == [datetime(2024, 4, 3, 10)]


def test_layouts_are_decided_apart_and_counted(spark):
    texts = ["3/4/2024", "25/4/24", "4/25/2024", "26/4/1969", "3.4.2024", "4.30.2024", "2024-01-01", "x", "y", None, "99/99/2024"]
    df = column(spark, texts)
    found = {r.layout: tuple(r)[1:] for r in op.decided(op.votes(df, "t")).collect()}
    assert found == {
        "1/2/2024": ("day first", 3, 2, 1),
        "1.2.2024": ("month first", 2, 0, 1),
        "2024-01-02": ("only", 1, 0, 0),
        None: (None, 0, 2, 0),
    }
    assert parsed(spark, texts)[:6] == [
        datetime(2024, 4, 3), datetime(2024, 4, 25), None, datetime(1969, 4, 26), datetime(2024, 3, 4), datetime(2024, 4, 30)
    ]


def test_votes_of_batches_add_up(spark):
    texts = ["3/4/2024", "25/4/2024", "4/25/2024", "26/4/2024", "x", "2024-01-01"]
    whole = op.votes(column(spark, texts), "t")
    parts = op.merged(*(op.votes(column(spark, texts[i::3]), "t") for i in range(3)))
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    orders = {r.layout: r.order for r in op.decided(parts).collect()}
    assert parsed(spark, ["3/4/2024"], orders=orders) == [datetime(2024, 4, 3)]


def test_nothing_to_parse(spark):
    assert parsed(spark, [None, "soon"]) == [None, None] and parsed(spark, []) == []
    assert op.decided(op.votes(column(spark, []), "t")).count() == 0
