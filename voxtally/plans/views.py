"""The tables the registered queries work on, derived from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.labels import canonical_label
from voxtally.functions.scoring import score_texts, sentiment_of
from voxtally.operators.columns import spread_array
from voxtally.operators.runs import STAGES
from voxtally.operators.splits import SPLIT_RATIOS, ratio_column, split_ratios

EMBEDDING_WIDTH = 64

# Lead the positive score needs at each stage of the scorer experiment.
STAGE_MARGINS = dict(zip(STAGES, (3, 1, -1, 0)))

# Phrases appended to a comment's text by its number modulo 6, so that scores vary.
PHRASES = (
    "sangat baik, terima kasih",
    "tidak suka, gagal total",
    "good but hard",
    "luar biasa happy",
    "masalah besar",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` of all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``comment_id, createTimeISO, label, text``: a raw comment per document."""
    documents = texts(spark, sf_dir).withColumnRenamed("doc_id", "comment_id")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("comment_id"), "ts")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("comment_id"), "quality")
    number = F.col("comment_id") % 6
    phrase = F.lit("")
    for i, words in reversed(list(enumerate(PHRASES))):
        phrase = F.when(number == i, words).otherwise(phrase)
    shift = F.make_dt_interval((F.col("comment_id") % 400).cast("int"))
    return (
        events.join(documents, "comment_id")
        .join(labels, "comment_id", "left")
        .select(
            "comment_id",
            (F.col("ts") + shift).alias("createTimeISO"),
            F.when(F.col("quality") == 1, " positive ").when(F.col("quality") == 0, "NEGATIVE").alias("label"),
            F.concat("text", F.lit(" "), phrase).alias("text"),
        )
    )


def text_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, ENGLISH, Sentiment``: labelled documents; toxic ones carry a label that is not accepted."""
    documents = texts(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("ENGLISH"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    sentiment = (
        F.when(F.col("toxic") == 1, " POSITIVE").when(F.col("quality") == 1, "Positive").otherwise("negative")
    )
    return documents.join(labels, "id").select("id", "ENGLISH", sentiment.alias("Sentiment"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, f01 .. f64``"""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return spread_array(vectors, "embedding", EMBEDDING_WIDTH)


def packed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, values``"""
    values = F.col("embedding").cast("array<double>").alias("values")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", values)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, prediction``: every seventh vector gets the next class as its guess."""
    missed = (F.col("vec_id") % 7 == 0).cast("int")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", ((F.col("label") + missed) % 10).alias("prediction")
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, prediction`` (0/1): the rule scorer against the label, on labelled comments."""
    scored = score_texts(comments(spark, sf_dir).filter("label IS NOT NULL"))
    return scored.select(
        F.col("comment_id").alias("id"),
        (canonical_label("label") == "Positive").cast("int").alias("label"),
        (F.col("rule_sentiment") == "Positive").cast("int").alias("prediction"),
    )


def scorer_runs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, split_ratio`` and an accuracy per stage, measured on the test side of each ratio.

    Models are the term scores, the pattern scores and both; the stages set how far positive has
    to lead. All accuracies come from one aggregate over the scored comments.
    """
    labelled = comments(spark, sf_dir).filter("label IS NOT NULL")
    scored = score_texts(split_ratios(labelled, "comment_id", "label")).drop("text")
    truth = canonical_label("label")
    scores = {
        "terms": ("positive_terms", "negative_terms"),
        "patterns": ("positive_patterns", "negative_patterns"),
        "rules": ("positive", "negative"),
    }
    cells, rows = [], []
    for model, columns in scores.items():
        for ratio in SPLIT_RATIOS:
            in_test = F.col(ratio_column(ratio)) == "test"
            names = []
            for stage, margin in STAGE_MARGINS.items():
                name = f"{model}|{ratio}|{stage}"
                hit = (sentiment_of(*columns, margin) == truth).cast("double")
                cells.append((100.0 * F.avg(F.when(in_test, hit))).alias(name))
                names.append(F.col(f"`{name}`").alias(stage))
            rows.append(F.struct(F.lit(model).alias("model"), F.lit(ratio).alias("split_ratio"), *names))
    return scored.agg(*cells).select(F.inline(F.array(*rows)))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, epoch, val_acc``: a run per user, an epoch per day, the share of events without error."""
    ok = (F.col("event_type") != "error").cast("int")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("run_id"), F.dayofmonth("ts").alias("epoch"))
        .agg(F.avg(ok).alias("val_acc"))
    )
