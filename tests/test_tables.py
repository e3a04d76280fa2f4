from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voxtally.operators import browse, classes, cleaning, columns, comments, trends
from voxtally.operators.features import Standardizer
from voxtally.operators.ranking import global_row_number, top_per_group


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (1, "2024-01-31 23:59:00", " positive ", "Terima kasih"),
        (2, "2024-01-01 00:00:00", "NEGATIVE", "buruk (sekali)"),
        (3, "2025-01-15 12:00:00", None, None),
        (4, None, "Positive", "ok"),
        (5, "2024-03-01 01:00:00", "Positive", "ok. jadi"),
    ]
    return spark.createDataFrame(rows, "comment_id long, createTimeISO string, label string, text string")


@pytest.fixture(scope="module")
def enriched(raw):
    return comments.enrich_comments(raw)


def test_enriched_columns(enriched):
    row = enriched.filter("comment_id = 1").first().asDict()
    assert row["label"] == "Positive" and row["month"] == "Jan 2024" and row["month_short"] == "Jan"
    assert (row["month_num"], row["hour"], row["day_name"], str(row["date"])) == (1, 23, "Wednesday", "2024-01-31")
    assert dict(enriched.dtypes)["createTimeISO"] == "timestamp_ntz"


def test_rejected_timestamps(spark):
    frame = spark.createDataFrame([("2024-01-01",), ("x",), (None,)], "createTimeISO string")
    assert comments.rejected_timestamps(frame).first()[0] == 1


def test_totals_count_rows_without_time(enriched):
    row = trends.sentiment_totals(enriched).first()
    assert (row.total, row.positive, row.negative) == (5, 3, 2)
    assert (row.positive_percent, row.negative_percent) == (60.0, 40.0)
    empty = trends.sentiment_totals(enriched.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0.0, 0.0)


def test_months_and_trend(enriched):
    counts = {r.month_start.strftime("%Y-%m"): r.n for r in trends.monthly_counts(enriched).collect()}
    assert counts == {"2024-01": 2, "2024-03": 1, "2025-01": 1}
    assert trends.monthly_peak(enriched).first()[0] == 2
    assert trends.monthly_peak(enriched.limit(0)).first()[0] == 0
    trend = [(r.month, r.Positive, r.Negative) for r in trends.monthly_trend(enriched).collect()]
    assert trend == [("Jan 2024", 1, 1), ("Mar 2024", 1, 0), ("Jan 2025", 0, 1)]
    by_month = [r.month for r in trends.monthly_trend(enriched, month_only_order=True).collect()]
    assert by_month == ["Jan 2024", "Jan 2025", "Mar 2024"]


def test_trend_takes_one_shuffle_before_its_sort(enriched):
    plan = trends.monthly_trend(enriched)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_search(enriched):
    def ids(query, **options):
        return sorted(r.comment_id for r in browse.search(enriched, query, **options).collect())

    assert ids("TERIMA") == [1]
    assert ids("ok.") == [5]
    assert ids("ok.", literal=True) == [5]
    assert ids("^ok$") == [4]
    assert ids("(sekali)", literal=True) == [2]
    assert ids("") == [1, 2, 3, 4, 5]
    assert ids(r"^\w+ \w+$") == [1]
    with pytest.raises(Exception):
        browse.search(enriched, "(")


def test_label_and_period_filters(enriched):
    assert browse.filter_label(enriched, "All").count() == 5
    assert browse.filter_label(enriched, "Negative").count() == 2
    as_of = datetime(2024, 3, 31, 1, 0)
    assert [r.comment_id for r in browse.filter_recent(enriched, "Last 30 days", as_of).orderBy("comment_id").collect()] == [3, 5]
    assert browse.filter_recent(enriched, "Last 30 days", datetime(2024, 3, 31, 1, 1)).count() == 1
    assert browse.filter_recent(enriched, "All time").count() == 5


def test_time_filter_reaches_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    recent = browse.filter_recent(events, 7, datetime(2024, 1, 28), ts="ts").select("event_id")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "GreaterThanOrEqual(ts" in pushed


@pytest.fixture(scope="module")
def hot_times(spark):
    """A third of the rows share one instant, some have none."""
    at = F.when(F.col("id") % 3 == 0, F.lit("2024-02-01")).when(F.col("id") % 50 == 1, None).otherwise(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).cast("string")
    )
    return spark.range(1000).select(F.col("id").alias("comment_id"), at.cast("timestamp_ntz").alias("createTimeISO"))


def expected_order(frame):
    rows = [(r.createTimeISO, r.comment_id) for r in frame.collect()]
    dated = sorted((r for r in rows if r[0]), reverse=True)
    return [r[1] for r in dated] + sorted((r[1] for r in rows if not r[0]), reverse=True)


def test_pages_joined_are_the_sorted_table(hot_times, monkeypatch):
    order = expected_order(hot_times)
    for number in (1, 2, 17, 34):
        got = [r.comment_id for r in browse.page(hot_times, number).collect()]
        assert got == order[(number - 1) * 30 : number * 30]
    assert [r.comment_id for r in browse.page(hot_times, 99).collect()] == order[990:]
    assert [r.comment_id for r in browse.page(hot_times, -2).collect()] == order[:30]
    numbered = {r.comment_id: (r.row_number, r.page) for r in browse.number_pages(hot_times).collect()}
    assert [numbered[i] for i in order] == [(n, (n - 1) // 30 + 1) for n in range(1, 1001)]
    monkeypatch.setattr(browse, "HEAP_ROWS", 50)
    assert [r.comment_id for r in browse.page(hot_times, 17).collect()] == order[480:510]


def test_walking_by_key_visits_every_row_once(hot_times):
    order = expected_order(hot_times)
    seen = browse.page(hot_times, 1, size=300).collect()
    while True:
        last = seen[-1]
        more = browse.page_after(hot_times, last.createTimeISO, last.comment_id, size=300).collect()
        if not more:
            break
        seen += more
    assert [r.comment_id for r in seen] == order


def test_page_summary(enriched):
    row = browse.page_summary(enriched, 2, size=2).first()
    assert (row.total, row.pages, row.page, row.first_row, row.last_row) == (5, 3, 2, 3, 4)
    assert tuple(browse.page_summary(enriched, 9, size=2).first()) == (5, 3, 3, 5, 5)
    assert tuple(browse.page_summary(enriched.limit(0), 3).first()) == (0, 0, 1, 0, 0)


def test_latest_is_oldest_first(enriched):
    got = [r.comment_id for r in browse.latest(enriched, 3, ts="createTimeISO").collect()]
    assert got == [1, 5, 3]


def test_global_row_number_spreads_equal_values(spark):
    frame = spark.range(5000).select("id", F.lit(1).alias("same"))
    numbered = global_row_number(frame, [F.col("same"), F.col("id").desc()])
    assert numbered.filter(F.col("row_number") != 5000 - F.col("id")).count() == 0
    assert numbered.count() == 5000


def test_top_per_group_with_a_hot_group(spark):
    frame = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), "id")
    got = top_per_group(frame, "g", [F.desc("id")], 5, spread_by="id")
    rows = {(r.g, r["rank"]): r.id for r in got.collect()}
    assert [rows["hot", i] for i in range(1, 6)] == [2999, 2998, 2996, 2995, 2993]
    assert [rows["cold", i] for i in range(1, 6)] == [2997, 2994, 2991, 2988, 2985]


def test_class_tables(spark):
    frame = spark.createDataFrame([("a",)] * 3 + [("b",), (None,)], "label string")
    assert {(r.label, r.n) for r in classes.class_weights(frame, "label").collect()} == {("a", 3), ("b", 1)}
    weights = {r.label: r.weight for r in classes.class_weights(frame, "label").collect()}
    assert weights == {"a": 4 / 6, "b": 2.0}
    assert tuple(classes.class_summary(frame, "label").first()) == (2, 1)
    assert classes.with_class_weights(frame, "label").filter("weight = 2.0").count() == 1
    total = classes.class_distribution(frame, "label").agg(F.sum("percent")).first()[0]
    assert abs(total - 100) < 1e-9


def test_label_index_orders_numbers_by_value(spark):
    frame = spark.createDataFrame([(10,), (9,), (2,), (9,)], "y int")
    index = classes.label_index(frame, "y")
    coded = classes.encode_labels(frame, "y", index)
    assert {(r.y, r.label_index) for r in coded.collect()} == {(2, 0), (9, 1), (10, 2)}
    back = classes.decode_labels(coded.withColumn("p", F.col("label_index").cast("double")), "p", index, "decoded")
    assert back.filter("decoded != y").count() == 0


def test_headers_and_targets(spark):
    frame = spark.createDataFrame([(1, 2, 3)], [" f1 ", "My Score ", "SCORE"])
    frame = columns.trim_headers(frame)
    assert frame.columns == ["f1", "My Score", "SCORE"]
    assert columns.find_target_contains(frame) == "My Score"
    assert columns.find_target_exact(frame) == "SCORE"
    assert columns.find_target_exact(frame.drop("SCORE")) == "My Score"
    assert columns.find_target_contains(frame.select("f1")) is None
    assert columns.rename_target(frame, "SCORE").columns[-1] == "Score"
    x, y = columns.split_target(frame, "SCORE")
    assert x.columns == ["f1", "My Score"] and y.columns == ["SCORE"]


def test_null_columns_coercion_and_summary(spark):
    rows = [("1", None, "x", 1.0), ("2d", None, "y", float("nan")), (None, None, "3", 2.0)]
    frame = spark.createDataFrame(rows, "a string, b string, c string, d double")
    kept = columns.drop_null_columns(frame)
    assert kept.columns == ["a", "c", "d"]
    assert columns.drop_null_columns(frame, keep=("b",)).columns == ["a", "b", "c", "d"]
    numeric = columns.coerce_numeric(kept, ["a", "c", "d"])
    assert [tuple(r) for r in numeric.collect()] == [(1.0, None, 1.0), (None, None, None), (None, 3.0, 2.0)]
    assert tuple(cleaning.dropna_summary(kept).first()) == (3, 2, 1)
    assert cleaning.drop_incomplete(kept).count() == 1
    packed = columns.pack_features(kept, ["a", "d"])
    assert packed.columns == ["c", "values"]
    assert [tuple(r) for r in columns.complete_features(packed).collect()] == [("x", [1.0, 1.0])]


def test_truth_columns_are_numbers_only_when_pure(spark):
    rows = [("True", "true", "x"), ("false", "7", "y"), (None, None, None)]
    frame = spark.createDataFrame(rows, "a string, b string, c string")
    profile = columns.column_profile(frame, frame.columns)
    assert profile == {"a": (2, 2), "b": (2, 1), "c": (2, 0)} and columns.truth_columns(profile) == ["a"]
    packed = columns.pack_features(frame, ["a", "b"], truths=["a"])
    assert [r["values"] for r in packed.collect()] == [[1.0, None], [0.0, 7.0], [None, None]]


def test_guards(spark):
    frame = spark.range(20).select((F.col("id") % 2).alias("y"))
    assert cleaning.require_trainable(frame, "y") == (20, 2)
    with pytest.raises(ValueError, match="empty"):
        cleaning.require_trainable(frame.limit(0), "y")
    with pytest.raises(ValueError, match="class"):
        cleaning.require_trainable(frame.filter("y = 0"), "y")
    with pytest.raises(ValueError, match="rows"):
        cleaning.require_trainable(frame.limit(6), "y")


def test_text_training_rows(spark):
    rows = [(1, " good & bad ", "Positive"), (2, "&", "Positive"), (3, "x", " POSITIVE"), (4, None, "negative"), (5, "y", "negative")]
    got = cleaning.text_training_rows(spark.createDataFrame(rows, "id long, ENGLISH string, Sentiment string"))
    assert [(r.id, r.ENGLISH, r.label) for r in got.orderBy("id").collect()] == [(1, "good  bad", 1), (5, "y", 0)]


def test_standardizer_uses_population_deviation(spark):
    frame = spark.createDataFrame([([1.0, 5.0],), ([2.0, 5.0],), ([3.0, 5.0],)], "values array<double>")
    scaler = Standardizer.fit(frame)
    assert scaler.means == (2.0, 5.0)
    assert abs(scaler.deviations[0] - (2 / 3) ** 0.5) < 1e-12 and scaler.deviations[1] == 1.0
    scaled = sorted(r[0] for r in scaler.transform(frame).select("scaled").collect())
    assert abs(scaled[2][0] - 1.5**0.5) < 1e-12 and [s[1] for s in scaled] == [0.0, 0.0, 0.0]
