"""Evaluation of predictions. Everything but the four named cells of the binary case comes from
the confusion counts, so the predictions are read and pre-aggregated once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.functions.labels import label_name
from voxtally.operators.ranking import global_row_number


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = F.coalesce(F.col(label) == F.col(prediction), F.lit(False))
    return df.agg(F.avg(hit.cast("double")).alias("accuracy"))


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``label, prediction, n`` of the pairs that occur."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def label_axis(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Sorted classes that occur as label or as prediction."""
    pairs = confusion_counts(df, label, prediction)
    return pairs.select(F.explode(F.array("label", "prediction")).alias("label")).distinct().orderBy("label")


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``label, prediction, n`` over all pairs of classes, zero cells included.

    The zero cells are laid out from the class list and added up with the counted pairs. The
    class list is taken from the same counts (it keeps their sum, so that both sides have one
    plan), and Spark computes them once.
    """
    pairs = confusion_counts(df, label, prediction)
    classes = pairs.select(F.explode(F.array("label", "prediction")).alias("c"), "n").agg(
        F.array_sort(F.collect_set("c")).alias("classes"), F.sum("n").alias("rows")
    )
    cells = (
        classes.filter(F.col("rows") > 0)
        .select("classes", F.explode("classes").alias("label"))
        .select("label", F.explode("classes").alias("prediction"))
        .withColumn("n", F.lit(0).cast("long"))
    )
    summed = pairs.unionByName(cells).groupBy("label", "prediction").agg(F.sum("n").alias("n"))
    return summed.orderBy("label", "prediction")


def confusion_table(df: DataFrame, classes: list, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The confusion matrix with one row per true and one column per predicted class."""
    matrix = confusion_matrix(df, label, prediction)
    cells = [F.sum(F.when(F.col("prediction") == c, F.col("n")).otherwise(0)).alias(str(c)) for c in classes]
    return matrix.groupBy("label").agg(*cells).orderBy("label")


def confusion_cells(
    df: DataFrame, label: str = "label", prediction: str = "prediction", positive=1
) -> DataFrame:
    """One row ``tn, fp, fn, tp`` of a binary prediction."""
    truth, guess = F.col(label) == positive, F.col(prediction) == positive
    return df.agg(
        F.count_if(~truth & ~guess).alias("tn"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(truth & guess).alias("tp"),
    )


def _ratio(part: str, whole: str):
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def class_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``class, precision, recall, f1, support`` plus hits per class; undefined ratios are 0."""
    pair = F.array(
        F.struct(
            F.col("label").alias("class"),
            F.col("n").alias("support"),
            F.lit(0).cast("long").alias("predicted"),
            F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hits"),
        ),
        F.struct(
            F.col("prediction").alias("class"),
            F.lit(0).cast("long").alias("support"),
            F.col("n").alias("predicted"),
            F.lit(0).cast("long").alias("hits"),
        ),
    )
    sums = (
        confusion_counts(df, label, prediction)
        .select(F.inline(pair))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    both = F.col("precision") + F.col("recall")
    return sums.withColumns({"precision": _ratio("hits", "predicted"), "recall": _ratio("hits", "support")}).withColumn(
        "f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0))
    )


def _weighted(column: str):
    total = F.sum("support")
    return F.when(total > 0, F.sum(F.col(column) * F.col("support")) / total).otherwise(F.lit(0.0))


def weighted_prf(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and the support-weighted precision, recall and F1."""
    hits = F.when(F.sum("support") > 0, F.sum("hits") / F.sum("support")).otherwise(F.lit(0.0))
    return class_scores(df, label, prediction).agg(
        hits.alias("accuracy"), *[_weighted(c).alias(c) for c in ("precision", "recall", "f1")]
    )


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", digits: int | None = None
) -> DataFrame:
    """``class, precision, recall, f1, support``: a row per class, then accuracy (in ``f1``),
    macro and weighted average.

    One rollup over the class table gives class rows and the three summary rows together.
    """
    names = ("precision", "recall", "f1")
    rolled = (
        class_scores(df, label, prediction)
        .withColumn("class", F.col("class").cast("string"))
        .rollup("class")
        .agg(
            F.grouping("class").alias("all_classes"),
            F.sum("support").alias("support"),
            F.sum("hits").alias("hits"),
            *[F.avg(c).alias(f"macro_{c}") for c in names],
            *[_weighted(c).alias(f"weighted_{c}") for c in names],
        )
    )
    support = F.col("support")

    def row(position, name, values):
        cells = [v.cast("double").alias(n) for n, v in zip(names, values)]
        return F.struct(F.lit(position).alias("position"), name.alias("class"), *cells, support.alias("support"))

    nothing = F.lit(None)
    summary = F.array(
        row(1, F.lit("accuracy"), (nothing, nothing, F.col("hits") / support)),
        row(2, F.lit("macro avg"), [F.col(f"macro_{c}") for c in names]),
        row(3, F.lit("weighted avg"), [F.col(f"weighted_{c}") for c in names]),
    )
    single = F.array(row(0, F.col("class"), [F.col(f"macro_{c}") for c in names]))
    report = rolled.select(F.inline(F.when(F.col("all_classes") == 1, summary).otherwise(single)))
    if digits is not None:
        report = report.withColumns({c: F.round(c, digits) for c in names})
    return report.orderBy("position", "class").drop("position")


def batch_accuracy(
    df: DataFrame, key: str, label: str = "label", prediction: str = "prediction", batch_rows: int = 16
) -> DataFrame:
    """Mean of the accuracies of consecutive batches in key order; the last may be short.

    Only key and hit go through the global numbering.
    """
    hit = F.coalesce(F.col(label) == F.col(prediction), F.lit(False)).cast("double")
    numbered = global_row_number(df.select(F.col(key), hit.alias("hit")), [F.col(key).asc()], "place")
    batch = F.floor((F.col("place") - 1) / batch_rows)
    return (
        numbered.groupBy(batch.alias("batch"))
        .agg(F.avg("hit").alias("batch_accuracy"))
        .agg(F.avg("batch_accuracy").alias("batch_accuracy"), F.count(F.lit(1)).alias("batches"))
    )


def prediction_samples(
    df: DataFrame, key: str, text: str, label: str = "label", prediction: str = "prediction", n: int = 20
) -> DataFrame:
    """The first rows by key with text, both labels and their names, and whether they agree."""
    return (
        df.orderBy(key)
        .limit(n)
        .select(
            F.col(key),
            F.col(text).alias("text"),
            F.col(label).alias("true_label"),
            F.col(prediction).alias("predicted_label"),
            label_name(label).alias("true_sentiment"),
            label_name(prediction).alias("predicted_sentiment"),
            (F.col(label) == F.col(prediction)).alias("correct"),
        )
    )
