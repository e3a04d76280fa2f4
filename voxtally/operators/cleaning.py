"""Row cleaning, its summary, and the guards before a training run."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtally.functions.labels import TRAINING_LABELS, label_to_int
from voxtally.functions.text import clean_text, has_clean_text


def _present(df: DataFrame):
    tests = []
    for field in df.schema.fields:
        column = F.col("`" + field.name.replace("`", "``") + "`")
        test = column.isNotNull()
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            test = test & ~F.isnan(column)
        tests.append(test)
    return reduce(and_, tests)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows with a value (neither NULL nor NaN) in every column.

    For stored columns, or a few computed ones; many computed features are better packed first,
    see :func:`voxtally.operators.columns.pack_features`.
    """
    return df.dropna("any")


def dropna_summary(df: DataFrame) -> DataFrame:
    """``original_rows, dropped_rows, final_rows`` of :func:`drop_incomplete`, in one pass."""
    counted = df.agg(F.count(F.lit(1)).alias("original_rows"), F.count_if(_present(df)).alias("final_rows"))
    return counted.select(
        "original_rows",
        (F.col("original_rows") - F.col("final_rows")).alias("dropped_rows"),
        "final_rows",
    )


def require_trainable(df: DataFrame, label: str, min_rows: int = 10, min_classes: int = 2) -> tuple[int, int]:
    """Row and class count of a training table; ``ValueError`` if there is too little of either."""
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    found = per_class.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(label).alias("classes")).first()
    rows, classes = found["rows"], found["classes"]
    if rows == 0:
        raise ValueError("the table is empty after cleaning")
    if classes < min_classes:
        raise ValueError(f"{classes} class(es) found, at least {min_classes} needed")
    if rows < min_rows:
        raise ValueError(f"{rows} rows left after cleaning, at least {min_rows} needed")
    return rows, classes


def nonempty_text(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.length(text) > 0)


def allowed_labels(df: DataFrame, label: str, allowed=tuple(TRAINING_LABELS)) -> DataFrame:
    return df.filter(F.col(label).isin(list(allowed)))


def text_training_rows(df: DataFrame, text: str = "ENGLISH", sentiment: str = "Sentiment") -> DataFrame:
    """Rows fit for training a text classifier: text cleaned, empty texts and unknown labels gone,
    ``label`` 0 or 1 added.

    Which rows stay is decided on the raw text, so a query that only needs the labels cleans none.
    """
    kept = allowed_labels(df, sentiment).filter(has_clean_text(text))
    return kept.withColumn(text, clean_text(text)).withColumn("label", label_to_int(sentiment))
