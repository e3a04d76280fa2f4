import math
import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from voxtally.functions import labels, numbers, text, times
from voxtally.operators.comments import with_timestamps


def python_clean(value):
    if value is None:
        return ""
    value = " ".join(value.split())
    return re.sub(r"[^\w\s.,!?-]", "", value).strip()


def test_clean_text_follows_the_rules(values):
    given = [None, "", "  a \t b\n", "a & b", "(hai)", "naïve – café!", "x  y\x1cz", "😀", "don't -ok?"]
    assert values(given, text.clean_text("x")) == [python_clean(g) for g in given]
    assert values(["a & b"], text.clean_text("x")) == ["a  b"]


def test_clean_text_on_random_unicode(values):
    rng = random.Random(5)
    alphabet = "aZé中ñ09_ \t\n\x1d\x85 .,!?-&$#()\"'“”€😀ßØ"
    given = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    assert values(given, text.clean_text("x")) == [python_clean(g) for g in given]
    given += ["&", " $ ", "", "-", "\x85", "é", None]
    assert values(given, text.has_clean_text("x")) == [bool(python_clean(g)) for g in given]


def test_trim_lower_and_title(values):
    assert values(["  Terima KASIH\n"], text.trim_lower("x")) == ["terima kasih"]
    assert values(["  not positive "], text.trim_title("x")) == ["Not Positive"]


def test_preview_cuts_after_eighty(values):
    long = "a" * 81
    assert values(["b" * 80, long, None], text.preview("x")) == ["b" * 80, "a" * 80 + "...", None]


def test_tokens(values):
    assert values(["Baik, luar_biasa 2x!", "", None], text.tokens("x")) == [["baik", "luar_biasa", "2x"], [], []]


def test_canonical_label(values):
    given = [" positive ", "Not Positive", "NEGATIVE", "neutral", None, "positive negative"]
    expected = ["Positive", "Positive", "Negative", "Negative", "Negative", "Positive"]
    assert values(given, labels.canonical_label("x")) == expected


def test_training_labels_are_exact(values):
    given = ["Positive", "positive", "Negative", "negative", " POSITIVE", "POSITIVE", None]
    assert values(given, labels.label_to_int("x")) == [1, 1, 0, 0, None, None, None]
    assert values([0, 1, None], labels.label_name("x"), "int") == ["Negative", "Positive", None]


def test_parse_timestamp(values):
    given = ["2024-01-05 15:07:09", "2024-01-05T23:30:00+08:00", "2024-01-05T15:30:00.5Z", "2024-01-05", "soon", None]
    expected = [
        datetime(2024, 1, 5, 15, 7, 9),
        datetime(2024, 1, 5, 15, 30),
        datetime(2024, 1, 5, 15, 30, 0, 500000),
        datetime(2024, 1, 5),
        None,
        None,
    ]
    assert values(given, times.parse_timestamp("x")) == expected


def test_calendar_texts(values):
    moment = [datetime(2024, 1, 5, 15, 7)]
    column = F.col("x")
    assert values(moment, times.month_text(column), "timestamp_ntz") == ["Jan 2024"]
    assert values(moment, times.month_short(column), "timestamp_ntz") == ["Jan"]
    assert values(moment, times.day_name(column), "timestamp_ntz") == ["Friday"]
    assert values(moment, times.display_time(column), "timestamp_ntz") == ["Jan 05, 2024 at 03:07 PM"]


def test_session_zone_does_not_matter(spark, values):
    """02:30 does not exist in New York on this day, yet a comment may carry it."""
    moment = [datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 1, 0, 0), datetime(2024, 3, 31, 23, 59)]
    texts = ["2024-03-10 02:30:00", "2024-03-10T02:30:00Z", "2024-03-10T02:30:00-04:00"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        shown = values(moment, times.display_time("x"), "timestamp_ntz")
        months = values(moment, times.month_start("x"), "timestamp_ntz")
        parsed = values(texts, times.parse_timestamp("x"))
        instant = spark.sql("SELECT timestamp'2024-03-10 12:00:00' AS createTimeISO")
        moved = with_timestamps(instant).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert shown == ["Mar 10, 2024 at 02:30 AM", "Mar 01, 2024 at 12:00 AM", "Mar 31, 2024 at 11:59 PM"]
    assert {str(m) for m in months} == {"2024-03-01"}
    assert parsed == [datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 6, 30)]
    assert moved == datetime(2024, 3, 10, 16)


def test_elapsed_text_matches_timedelta(values):
    given = [0.0, 0.5, 1.5, 59.6, 3600.0, 86399.5, 86400.0, 172801.2, 8640000.0]
    expected = [str(timedelta(seconds=int(round(g)))) for g in given]
    assert values(given, times.elapsed_text("x"), "double") == expected


def test_to_number(values):
    given = ["1", " 2.5 ", "-3e2", "+.5", "7.", "1d", "3f", "0x1p3", "abc", "", None, "inf", "-Infinity", "nan", "1_0"]
    expected = [1.0, 2.5, -300.0, 0.5, 7.0, None, None, None, None, None, None, math.inf, -math.inf, None, None]
    assert values(given, numbers.to_number("x")) == expected


def test_percent_of_nothing_is_zero(spark):
    frame = spark.createDataFrame([(1, 4), (0, 0)], "a int, b int").select(numbers.percent("a", "b"))
    assert [r[0] for r in frame.collect()] == [25.0, 0.0]


def test_softmax_and_argmax(spark):
    frame = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1000.0, 0.0],)], "x array<double>")
    rows = frame.select(numbers.softmax("x"), numbers.argmax("x")).collect()
    exps = [math.exp(-2), 1, 1]
    assert all(abs(a - b / sum(exps)) < 1e-12 for a, b in zip(rows[0][0], exps))
    assert rows[0][1] == 1
    assert rows[1][0] == [1.0, 0.0] and rows[1][1] == 0


def test_fast_classes_hold_the_same_characters(spark):
    """Every code point, by the classes that are scanned and those that the rules state."""
    code = "i", F.decode(F.unhex(F.lpad(F.hex("i"), 8, "0")), "UTF-32").alias("c")
    chars = spark.range(0x110000).withColumnRenamed("id", "i").filter("i NOT BETWEEN 55296 AND 57343").select(*code)
    pairs = ((f"[{text.BLANK}]", text._BLANKS), (f"[^{text.WORD}{text.BLANK}.,!?-]", text._SYMBOLS))
    for slow, fast in pairs:
        told = chars.agg(F.count_if(F.col("c").rlike(slow)), F.count_if(F.col("c").rlike(slow) != F.col("c").rlike(fast))).first()
        assert told[0] > 0 and told[1] == 0
