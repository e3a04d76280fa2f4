"""Writing histories, results, reports, models and the analysis log. Large tables are written as
Spark writes them, in parts; only tables of a known small size become one file."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.operators.metrics import confusion_matrix, prediction_samples, weighted_prf

REPORT_SAMPLES = 20


def write_history_csv(history: DataFrame, path: str) -> None:
    history.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_test_results(
    predictions: DataFrame,
    path: str,
    label: str = "label",
    prediction: str = "prediction",
    best_validation_accuracy: float | None = None,
    config: dict[str, Any] | None = None,
) -> None:
    """The predictions as a Parquet table under ``predictions``, metrics and confusion counts as one JSON
    row under ``metrics``. The figures are taken from the stored predictions, so all three agree."""
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    predictions = predictions.sparkSession.read.schema(predictions.schema).parquet(f"{path}/predictions")
    cells = confusion_matrix(predictions, label, prediction).agg(
        F.array_sort(F.collect_list(F.struct("label", "prediction", "n"))).alias("confusion_matrix")
    )
    scores = weighted_prf(predictions, label, prediction).withColumnRenamed("f1", "f1_score").first().asDict()
    row = cells.withColumns(
        {
            **{name: F.lit(value) for name, value in scores.items()},
            "best_validation_accuracy": F.lit(best_validation_accuracy).cast("double"),
            "config": F.lit(json.dumps(config or {}, sort_keys=True)),
        }
    )
    row.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def write_prediction_samples(
    predictions: DataFrame, path: str, key: str, text: str, label: str = "label", prediction: str = "prediction"
) -> None:
    samples = prediction_samples(predictions, key, text, label, prediction, REPORT_SAMPLES)
    samples.coalesce(1).write.mode("overwrite").json(path)


def report_table(
    values: dict[str, DataFrame], counts: dict[str, DataFrame] | None = None, settings: dict[str, Any] | None = None
) -> DataFrame:
    """``section, key, value`` as text, gathered from small tables.

    ``values`` are one-row tables, each column a key. ``counts`` have a row per key: the last
    column is the value, the columns before it name it. ``settings`` are plain pairs.
    """
    rows = []
    for section, frame in values.items():
        pairs = [F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in frame.columns]
        rows.append(frame.select(F.lit(section).alias("section"), F.inline(F.array(*pairs))))
    for section, frame in (counts or {}).items():
        *names, last = frame.columns
        key = F.concat_ws(" ", *[F.col(n).cast("string") for n in names])
        rows.append(
            frame.select(F.lit(section).alias("section"), key.alias("key"), F.col(last).cast("string").alias("value"))
        )
    if settings:
        spark = next(iter(values.values())).sparkSession
        pairs = [("settings", name, str(value)) for name, value in settings.items()]
        rows.append(spark.createDataFrame(pairs, "section string, key string, value string"))
    return reduce(DataFrame.unionByName, rows)


def write_report(
    path: str,
    values: dict[str, DataFrame],
    counts: dict[str, DataFrame] | None = None,
    settings: dict[str, Any] | None = None,
) -> None:
    report_table(values, counts, settings).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def append_log(log: DataFrame, path: str) -> None:
    """Append rows of an analysis log; earlier ones stay."""
    log.write.mode("append").parquet(path)
