"""Every registered query by name: ``(spark, folder of the tables) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions import labels as label_functions
from voxtally.functions import numbers, scoring, text, times
from voxtally.operators import (
    browse,
    classes,
    cleaning,
    columns,
    comments,
    features,
    metrics,
    runs,
    search_index,
    splits,
    time_formats,
    trend_store,
    trends,
    words,
)
from voxtally.plans import epochs, forest, kernel_svm, nystrom, text_classifier, views
from voxtally.session import new_table_path, written
from voxtally.sinks import results
from voxtally.sources import csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

AS_OF = datetime(2024, 6, 15, 12, 30)


def query(function):
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    chosen = names or [n for n, kind in df.dtypes if kind == "double"]
    return df.withColumns({n: F.round(n, digits) for n in chosen})


# ---- time, labels, text ----------------------------------------------------------------------


@query
def enrich_comments(spark, sf_dir):
    return comments.enrich_comments(views.comments(spark, sf_dir)).drop("text")


@query
def parsed_timestamps(spark, sf_dir):
    """Times as text, some with a UTC offset, some broken."""
    kind = F.col("event_id") % 4
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    written = (
        F.when(kind == 0, plain)
        .when(kind == 1, F.concat(plain, F.lit("+08:00")))
        .when(kind == 2, F.concat(plain, F.lit("Z")))
        .otherwise(F.concat(F.lit("not a time "), F.col("event_id").cast("string")))
    )
    events = views.table(spark, sf_dir, "events").select("event_id", written.alias("createTimeISO"))
    return comments.with_timestamps(events)


@query
def rejected_timestamps(spark, sf_dir):
    written = F.when(F.col("event_id") % 5 > 0, F.col("ts").cast("string")).otherwise("on some day")
    return comments.rejected_timestamps(views.table(spark, sf_dir, "events").select(written.alias("createTimeISO")))


def _written_times(spark, sf_dir):
    """Times in three layouts by the number of the event; every eleventh is out of its layout's order or no time."""
    kind = F.col("event_id") % 3
    shown = (
        F.when(F.col("event_id") % 11 == 5, F.concat(F.lit("12/"), F.dayofmonth("ts") + 12, F.lit("/2024")))
        .when(kind == 0, F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
        .when(kind == 1, times.display_time("ts"))
        .otherwise(F.date_format("ts", "yyyyMMdd HHmmss"))
    )
    shown = F.regexp_replace(shown, " at ", " ")
    return views.table(spark, sf_dir, "events").select("event_id", shown.alias("createTimeISO"))


@query
def inferred_times(spark, sf_dir):
    """Times read in the layouts that the column itself tells, day and month by majority."""
    return time_formats.parse_inferred(_written_times(spark, sf_dir), "createTimeISO")


@query
def time_formats_found(spark, sf_dir):
    """The layouts of the column, the order that holds in each, and how many texts it rejects."""
    return time_formats.decided(time_formats.votes(_written_times(spark, sf_dir), "createTimeISO"))


@query
def display_times(spark, sf_dir):
    shown = times.display_time("createTimeISO").alias("shown_at")
    return views.comments(spark, sf_dir).select("comment_id", shown)


@query
def elapsed_times(spark, sf_dir):
    seconds = F.col("value") * 3600.5
    return views.table(spark, sf_dir, "events").select("event_id", times.elapsed_text(seconds).alias("elapsed"))


@query
def canonical_label(spark, sf_dir):
    return views.comments(spark, sf_dir).select(
        "comment_id", label_functions.canonical_label("label").alias("label")
    )


@query
def normalized_text(spark, sf_dir):
    """Trimmed and lower-cased texts of the conversations."""
    return views.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.trim_lower("text").alias("text")
    )


@query
def clean_text(spark, sf_dir):
    return views.texts(spark, sf_dir).select("doc_id", text.clean_text("text").alias("text"))


@query
def text_training_rows(spark, sf_dir):
    return cleaning.text_training_rows(views.text_training(spark, sf_dir))


@query
def csv_documents(spark, sf_dir):
    """The documents written as CSV, line breaks and quotes included, and read back in several tasks."""
    path = new_table_path(spark)
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    views.texts(spark, sf_dir).write.options(**options).csv(path)
    return csv.read_csv(spark, path).select(F.col("doc_id").cast("long"), "text")


# ---- trends and classes ----------------------------------------------------------------------


def _enriched(spark, sf_dir):
    return comments.enrich_comments(views.comments(spark, sf_dir))


@query
def sentiment_totals(spark, sf_dir):
    return rounded(trends.sentiment_totals(_enriched(spark, sf_dir)))


@query
def monthly_counts(spark, sf_dir):
    return trends.monthly_counts(_enriched(spark, sf_dir))


@query
def monthly_counts_orders(spark, sf_dir):
    """The same count over the orders of several years."""
    orders = views.table(spark, sf_dir, "orders").select("o_orderdate")
    return trends.monthly_counts(orders, "o_orderdate")


@query
def monthly_peak(spark, sf_dir):
    return trends.monthly_peak(_enriched(spark, sf_dir))


@query
def monthly_trend(spark, sf_dir):
    return trends.monthly_trend(_enriched(spark, sf_dir))


def _stored_trends(spark, sf_dir):
    """The comments taken in by three batches that overlap; the first one comes twice."""
    rows = _enriched(spark, sf_dir).drop("text")
    store = trend_store.TrendStore(spark, new_table_path(spark))
    place = F.col("comment_id") % 10
    for name, part in (("a", place < 5), ("b", place.between(3, 7)), ("a", place < 5), ("c", place > 6)):
        store.apply(rows.filter(part), name)
    return store


@query
def stored_trend(spark, sf_dir):
    """The monthly trend from the counts of batches."""
    return _stored_trends(spark, sf_dir).monthly_trend()


@query
def stored_totals(spark, sf_dir):
    return rounded(_stored_trends(spark, sf_dir).sentiment_totals())


@query
def class_distribution(spark, sf_dir):
    rows = cleaning.text_training_rows(views.text_training(spark, sf_dir))
    return rounded(classes.class_distribution(rows, "label"))


@query
def class_summary(spark, sf_dir):
    return classes.class_summary(views.features(spark, sf_dir), "label")


@query
def class_weights(spark, sf_dir):
    rows = cleaning.text_training_rows(views.text_training(spark, sf_dir))
    return rounded(classes.class_weights(rows, "label"))


@query
def weighted_rows(spark, sf_dir):
    """Class weights joined back to the rows."""
    rows = views.features(spark, sf_dir).select("vec_id", "label")
    return rounded(classes.with_class_weights(rows, "label"))


# ---- browsing --------------------------------------------------------------------------------


@query
def search_comments(spark, sf_dir):
    return browse.search(_enriched(spark, sf_dir), "Terima Kasih").select("comment_id", "label")


@query
def search_pattern(spark, sf_dir):
    return browse.search(_enriched(spark, sf_dir), "luar biasa|gagal (total|semua)").select("comment_id", "label")


def _indexed(spark, sf_dir):
    rows = _enriched(spark, sf_dir).select("comment_id", "label", "text")
    return search_index.build_index(rows, new_table_path(spark))


@query
def indexed_search(spark, sf_dir):
    """The search for a phrase by the index of trigrams."""
    return _indexed(spark, sf_dir).search("terima kasih").select("comment_id", "label")


@query
def indexed_pattern(spark, sf_dir):
    """The search for a pattern with alternatives by the index of trigrams."""
    return _indexed(spark, sf_dir).search("luar biasa|gagal (total|semua)").select("comment_id", "label")


@query
def filter_by_label(spark, sf_dir):
    return browse.filter_label(_enriched(spark, sf_dir), "Positive").select("comment_id", "label", "month")


@query
def filter_recent(spark, sf_dir):
    return browse.filter_recent(_enriched(spark, sf_dir), "Last 90 days", AS_OF).select("comment_id", "createTimeISO")


@query
def filter_recent_events(spark, sf_dir):
    """The same filter on a stored column, where it reaches the file scan."""
    events = views.table(spark, sf_dir, "events")
    recent = browse.filter_recent(events, "Last 7 days", datetime(2024, 1, 28, 6), ts="ts")
    return recent.select("event_id", "ts", "event_type")


@query
def comments_page(spark, sf_dir):
    shown = _enriched(spark, sf_dir).select("comment_id", "createTimeISO", "label", "text")
    return browse.page(shown, 3).withColumn("shown_at", times.display_time("createTimeISO"))


@query
def deep_page(spark, sf_dir):
    """A page far down the list of all events."""
    return browse.page(views.table(spark, sf_dir, "events"), 200, ts="ts", key="event_id")


@query
def next_page(spark, sf_dir):
    """The page behind a given row, without counting or skipping."""
    shown = _enriched(spark, sf_dir).select("comment_id", "createTimeISO", "label")
    return browse.page_after(shown, datetime(2024, 6, 1), 0)


@query
def page_summary(spark, sf_dir):
    return browse.page_summary(browse.filter_label(_enriched(spark, sf_dir), "Negative"), 2)


@query
def page_numbers(spark, sf_dir):
    return browse.number_pages(_enriched(spark, sf_dir).select("comment_id", "createTimeISO"))


@query
def page_numbers_events(spark, sf_dir):
    """Every event's page, newest first."""
    events = views.table(spark, sf_dir, "events").select("event_id", "ts")
    return browse.number_pages(events, ts="ts", key="event_id")


def _log(spark, sf_dir):
    scored = score_with_model(spark, sf_dir)
    return browse.analysis_log(scored)


@query
def analysis_log(spark, sf_dir):
    return _log(spark, sf_dir)


@query
def latest_items(spark, sf_dir):
    return browse.latest(_log(spark, sf_dir), 5)


# ---- scoring and words -----------------------------------------------------------------------


@query
def lexicon_counts(spark, sf_dir):
    scored = scoring.score_texts(views.comments(spark, sf_dir))
    return scored.select("comment_id", "positive_terms", "negative_terms")


@query
def pattern_counts(spark, sf_dir):
    scored = scoring.score_texts(views.comments(spark, sf_dir))
    return scored.select("comment_id", "positive_patterns", "negative_patterns")


@query
def rule_sentiment(spark, sf_dir):
    scored = scoring.score_texts(views.comments(spark, sf_dir))
    return scored.select("comment_id", "positive", "negative", "rule_sentiment")


@query
def score_conversations(spark, sf_dir):
    """Any table with a text column can be scored."""
    scored = scoring.score_texts(views.table(spark, sf_dir, "conversations"))
    return scored.select("conv_id", "turn", "positive", "negative", "rule_sentiment")


def score_with_model(spark, sf_dir):
    """Scored comments; the toxicity label stands in for a model that answers for some of them."""
    answers = views.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("comment_id"), label_functions.label_name(1 - F.col("toxic")).alias("model_sentiment")
    )
    scored = scoring.score_texts(views.comments(spark, sf_dir).join(answers, "comment_id", "left"))
    return scored.withColumns(
        {
            "sentiment": scoring.model_or_rule("model_sentiment"),
            "model": scoring.scorer_used("model_sentiment"),
        }
    )


@query
def model_or_rule(spark, sf_dir):
    return score_with_model(spark, sf_dir).select("comment_id", "sentiment", "model")


@query
def lexicon_weights(spark, sf_dir):
    return words.lexicon_usage(views.comments(spark, sf_dir))


@query
def word_freq(spark, sf_dir):
    return words.word_freq(_enriched(spark, sf_dir))


@query
def vocabulary(spark, sf_dir):
    return words.vocabulary(views.comments(spark, sf_dir))


@query
def encode_fixed_length(spark, sf_dir):
    rows = views.comments(spark, sf_dir).select("comment_id", "label", "text")
    encoded = words.encode_fixed_length(rows, words.vocabulary(rows), "comment_id", label="label")
    return encoded.select(
        "comment_id",
        "label",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), " ").alias("attention_mask"),
    )


@query
def softmax_label(spark, sf_dir):
    """Embeddings read as logits: class and its probability."""
    probabilities = views.table(spark, sf_dir, "embeddings").select(
        "vec_id", numbers.softmax("embedding").alias("p"), numbers.argmax("embedding").alias("predicted")
    )
    return rounded(
        probabilities.select(
            "vec_id",
            "predicted",
            F.array_max("p").alias("top_probability"),
            F.element_at("p", 1).alias("first_probability"),
        )
    )


# ---- features --------------------------------------------------------------------------------


def _written_numbers(spark, sf_dir):
    """Events with a number written as text, in many ways a parser has to accept or refuse."""
    n = F.col("event_id") % 9
    value = F.col("value").cast("string")
    written = (
        F.when(n == 0, F.concat(value, F.lit("d")))
        .when(n == 1, F.concat(F.lit("  "), value, F.lit(" ")))
        .when(n == 2, F.concat(value, F.lit("e2")))
        .when(n == 3, F.lit(""))
        .when(n == 4, F.concat(F.lit("-"), value))
        .when(n == 5, F.lit("n/a"))
        .otherwise(value)
    )
    return views.table(spark, sf_dir, "events").select(
        "event_id",
        written.alias("written"),
        F.col("event_type").alias("kind"),
        F.when(F.col("value") < 0, F.lit("x")).alias("nothing"),
        F.col("value"),
    )


@query
def drop_null_columns(spark, sf_dir):
    """``nothing`` has no value and goes; ``kind`` stays although it is no number."""
    return columns.drop_null_columns(_written_numbers(spark, sf_dir))


@query
def coerce_numeric(spark, sf_dir):
    return columns.coerce_numeric(_written_numbers(spark, sf_dir).drop("nothing"), ["written", "kind", "value"])


@query
def coerce_text_columns(spark, sf_dir):
    """Only text columns are coerced, then incomplete rows go."""
    rows = _written_numbers(spark, sf_dir).select("event_id", "written", "value")
    return cleaning.drop_incomplete(columns.coerce_text_columns(rows, ["written", "value"]))


@query
def dropna_summary(spark, sf_dir):
    rows = columns.coerce_numeric(_written_numbers(spark, sf_dir).select("event_id", "written"), ["written"])
    return cleaning.dropna_summary(rows)


@query
def label_index(spark, sf_dir):
    """Event types numbered in alphabetical order, on every row."""
    rows = views.table(spark, sf_dir, "events").select("event_id", "event_type")
    return classes.encode_labels(rows, "event_type", classes.label_index(rows, "event_type"))


@query
def standardize(spark, sf_dir):
    """Features scaled by what the training side of a 60/40 split shows."""
    vectors = views.packed_features(spark, sf_dir)
    rows = splits.stratified_split(vectors, "vec_id", "label", 0.4)
    scaled = features.Standardizer.fit(rows.filter("split = 'train'")).transform(rows)
    spread = columns.spread_array(scaled.select("vec_id", "split", "scaled"), "scaled", views.EMBEDDING_WIDTH)
    return rounded(spread, 5)


# ---- splits ----------------------------------------------------------------------------------


@query
def stratified_split(spark, sf_dir):
    rows = views.features(spark, sf_dir).select("vec_id", "label")
    return splits.stratified_split(rows, "vec_id", "label", 0.4)


@query
def stratified_folds(spark, sf_dir):
    rows = views.features(spark, sf_dir).select("vec_id", "label")
    return splits.stratified_folds(rows, "vec_id", "label", 5)


@query
def stratified_folds_orders(spark, sf_dir):
    """Seven folds of the orders, by status."""
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return splits.stratified_folds(rows, "o_orderkey", "o_orderstatus", 7)


@query
def stratified_split_orders(spark, sf_dir):
    """An 80/20 split of the orders, by status."""
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return splits.stratified_split(rows, "o_orderkey", "o_orderstatus", 0.2)


@query
def plain_split(spark, sf_dir):
    """Some class has one row only, so the split takes no account of classes."""
    rows = views.table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") == 0, "once").otherwise(F.col("event_type")).alias("kind")
    )
    return splits.stratified_split(rows, "event_id", "kind", 0.2)


@query
def three_way_split(spark, sf_dir):
    rows = views.text_training(spark, sf_dir).select("id", "Sentiment")
    return splits.three_way_split(rows, "id", "Sentiment")


@query
def split_distribution(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("event_id", "event_type")
    return splits.split_distribution(splits.three_way_split(rows, "event_id", "event_type"), "event_type")


@query
def split_ratios(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return splits.split_ratios(rows, "vec_id", "label")


# ---- evaluation ------------------------------------------------------------------------------


@query
def accuracy(spark, sf_dir):
    return rounded(metrics.accuracy(views.predictions(spark, sf_dir)))


@query
def weighted_prf(spark, sf_dir):
    return rounded(metrics.weighted_prf(views.predictions(spark, sf_dir)))


@query
def classification_report(spark, sf_dir):
    return metrics.classification_report(views.predictions(spark, sf_dir), digits=6)


@query
def rule_report(spark, sf_dir):
    """The rule scorer's report against the labels, with four digits."""
    return metrics.classification_report(views.scored_labels(spark, sf_dir), digits=4)


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(views.predictions(spark, sf_dir))


@query
def confusion_table(spark, sf_dir):
    """The same with a column per predicted class."""
    return metrics.confusion_table(views.predictions(spark, sf_dir), list(range(10)))


@query
def label_axis(spark, sf_dir):
    return metrics.label_axis(views.predictions(spark, sf_dir))


@query
def confusion_cells(spark, sf_dir):
    return metrics.confusion_cells(views.scored_labels(spark, sf_dir))


@query
def batch_accuracy(spark, sf_dir):
    return rounded(metrics.batch_accuracy(views.predictions(spark, sf_dir), "id"))


@query
def prediction_samples(spark, sf_dir):
    rows = written(cleaning.text_training_rows(views.text_training(spark, sf_dir)))
    split = splits.three_way_split(rows, "id", "label")
    scored = scoring.score_texts(split.filter("split = 'test'"), "ENGLISH")
    guess = (F.col("rule_sentiment") == "Positive").cast("int")
    return metrics.prediction_samples(scored.withColumn("prediction", guess), "id", "ENGLISH")


@query
def summary_report(spark, sf_dir):
    """Split sizes, class counts, confusion cells and scores of the rule scorer, as one table."""
    rows = views.scored_labels(spark, sf_dir)
    events = views.table(spark, sf_dir, "events").select("event_id", "event_type")
    sizes = splits.three_way_split(events, "event_id", "event_type").groupBy("split").count()
    return results.report_table(
        {"cells": metrics.confusion_cells(rows), "months": trends.monthly_peak(_enriched(spark, sf_dir))},
        {"split": sizes, "classes": classes.class_counts(rows, "label")},
    )


# ---- runs ------------------------------------------------------------------------------------


def _runs(spark, sf_dir):
    return runs.runs_long(views.scorer_runs_wide(spark, sf_dir))


@query
def runs_long(spark, sf_dir):
    return rounded(_runs(spark, sf_dir))


@query
def best_run(spark, sf_dir):
    return rounded(runs.best_run(_runs(spark, sf_dir)))


@query
def gain_over_baseline(spark, sf_dir):
    return rounded(runs.gain_over_baseline(_runs(spark, sf_dir)))


@query
def stage_gain(spark, sf_dir):
    return rounded(runs.stage_gain(_runs(spark, sf_dir)))


@query
def split_effect(spark, sf_dir):
    return rounded(runs.split_effect(_runs(spark, sf_dir)))


@query
def early_stop(spark, sf_dir):
    traced = runs.early_stop(views.history(spark, sf_dir))
    return rounded(traced.drop("stop_step"))


@query
def best_epoch(spark, sf_dir):
    return rounded(runs.best_epoch(views.history(spark, sf_dir)))


# ---- schema ----------------------------------------------------------------------------------


@query
def trimmed_headers(spark, sf_dir):
    customers = views.table(spark, sf_dir, "customer")
    padded = customers.select(F.col("c_custkey").alias("  c_custkey"), F.col("c_acctbal").alias("\tc_acctbal  "))
    return columns.trim_headers(padded)


@query
def target_column(spark, sf_dir):
    """A score under a padded name in mixed case, found and renamed."""
    events = views.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("Score kind"), "event_id", F.col("value").alias(" sCORE ")
    )
    trimmed = columns.trim_headers(events)
    return columns.rename_target(trimmed, columns.find_target_exact(trimmed)).drop("Score kind")


@query
def target_and_features(spark, sf_dir):
    """The first column that contains the word is the target; what is left are the features."""
    events = views.table(spark, sf_dir, "events").select("event_id", F.col("value").alias("Final_Score"), "user_id")
    features_side, _ = columns.split_target(events, columns.find_target_contains(events))
    return features_side


@query
def title_labels(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.upper("event_type"), F.lit("\t"))
    return views.table(spark, sf_dir, "events").select("event_id", text.trim_title(padded).alias("label"))


@query
def trainable_counts(spark, sf_dir):
    rows, found = cleaning.require_trainable(cleaning.text_training_rows(views.text_training(spark, sf_dir)), "label")
    return spark.createDataFrame([(rows, found)], "n_rows long, n_classes long")


# ---- models: test sides, which SQL can tell ---------------------------------------------------


@query
def forest_test_side(spark, sf_dir):
    return _forest(spark, sf_dir).predictions.select("vec_id", "label")


@query
def kernel_svm_test_side(spark, sf_dir):
    data = kernel_svm.prepare(views.features(spark, sf_dir), "label", "vec_id")
    return data.rows.filter("split = 'test'").select("vec_id", F.col("target").alias("label"))


@query
def text_classifier_test_side(spark, sf_dir):
    run = text_classifier.train_text_classifier(views.text_training(spark, sf_dir))
    return run.predict().select("id", "label")


# ---- models: results without an SQL counterpart ----------------------------------------------


def _forest(spark, sf_dir):
    return forest.train_forest(views.features(spark, sf_dir), "label", "vec_id")


@query
def forest_predictions(spark, sf_dir):
    return _forest(spark, sf_dir).predictions.drop("probability")


@query
def forest_importances(spark, sf_dir):
    return forest.feature_importances(_forest(spark, sf_dir))


@query
def forest_report(spark, sf_dir):
    return _forest(spark, sf_dir).report(digits=6)


@query
def kernel_svm_predictions(spark, sf_dir):
    return kernel_svm.train_kernel_svm(views.features(spark, sf_dir), "label", "vec_id").predictions


@query
def kernel_svm_nystrom_predictions(spark, sf_dir):
    """The machine with landmarks of the training side instead of random features."""
    data = kernel_svm.prepare(views.features(spark, sf_dir), "label", "vec_id")
    return kernel_svm.fit(data, dimension=128, iterations=20, kernel_map="nystrom").predictions


@query
def nystrom_error(spark, sf_dir):
    """How far landmarks are from the exact kernel, over all rows."""
    rows = views.packed_features(spark, sf_dir)
    points = nystrom.landmarks(rows, "vec_id", "values", 0.001, 64)
    return nystrom.error_bound(rows, "values", points, 0.001)


@query
def grid_search(spark, sf_dir):
    data = kernel_svm.prepare(views.features(spark, sf_dir), "label", "vec_id")
    return kernel_svm.grid_search(data, {"C": [10.0, 100.0], "gamma": [0.001]}, folds=3, dimension=256, iterations=20)


@query
def text_classifier_predictions(spark, sf_dir):
    run = text_classifier.train_text_classifier(views.text_training(spark, sf_dir))
    return run.predict().drop("text", "probability")


def _epochs(spark, sf_dir):
    return epochs.train(views.text_training(spark, sf_dir))


@query
def text_classifier_history(spark, sf_dir):
    """The seven figures of each logged epoch."""
    return _epochs(spark, sf_dir).history()


@query
def text_classifier_early_stop(spark, sf_dir):
    """The trace of early stopping over all epochs that ran, with the epoch whose weights were kept."""
    run = _epochs(spark, sf_dir)
    traced = runs.early_stop(run.epochs(), run.settings.patience)
    return traced.join(run.best_epoch().select("run_id", "best_epoch"), "run_id")


@query
def text_classifier_kept_predictions(spark, sf_dir):
    """The test side by the weights of the best epoch."""
    return _epochs(spark, sf_dir).predict().drop("probability")


@query
def classified_comments(spark, sf_dir):
    """A classifier fitted on the labelled documents answers first, the rules where it gave nothing."""
    run = text_classifier.train_text_classifier(views.text_training(spark, sf_dir))
    answered = text_classifier.classify(
        views.comments(spark, sf_dir).withColumnRenamed("text", "ENGLISH").drop("label"), run.model
    )
    decided = scoring.score_texts(answered, "ENGLISH").select(
        "comment_id",
        scoring.model_or_rule("model_sentiment").alias("sentiment"),
        scoring.scorer_used("model_sentiment").alias("model"),
    )
    return decided
