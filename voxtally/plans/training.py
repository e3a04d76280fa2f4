"""What all training runs share: preparing a feature table, results, evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.functions.numbers import to_number
from voxtally.operators import metrics
from voxtally.operators.cleaning import require_trainable
from voxtally.operators.columns import (
    column_profile,
    complete_features,
    feature_columns,
    pack_features,
    quoted,
    truth_columns,
)
from voxtally.session import written

KEY = "row_id"
TARGET = "target"
#: Training rows of a partition, and partitions of a small table.
PART_ROWS, LEAST_PARTS = 100_000, 8


def with_key(df: DataFrame, key: str = KEY) -> DataFrame:
    """The table with a unique key: its own, or each row's place in the files.

    A place depends on the files' layout. Give a key where splits have to stay the same on other clusters.
    """
    return df if key in df.columns else df.withColumn(key, F.monotonically_increasing_id())


@dataclass(frozen=True)
class TrainingRun:
    """A fitted model, its predictions on the test side, the class numbers and the features' names."""

    model: PipelineModel
    predictions: DataFrame
    labels: DataFrame
    names: list[str]

    def accuracy(self) -> DataFrame:
        return metrics.accuracy(self.predictions)

    def report(self, digits: int | None = None) -> DataFrame:
        return metrics.classification_report(self.predictions, digits=digits)

    def confusion_matrix(self) -> DataFrame:
        return metrics.confusion_matrix(self.predictions)


@dataclass(frozen=True)
class FeatureTable:
    """The key, ``target`` and ``values``: complete rows with their features packed into one array."""

    rows: DataFrame
    names: list[str]


def laid_out(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """The rows dealt to ``parts`` partitions by key, sorted in each.

    Bagging draws by partition and place, so a fit is repeatable only on a layout that depends neither on the
    number of cores nor on how files were written or read back. Without ``parts`` their number follows from the
    number of rows; it is part of what the model depends on, like the seed.
    """
    if parts is None:
        parts = max(LEAST_PARTS, -(-rows.count() // PART_ROWS))
    return rows.repartition(parts, quoted(key)).sortWithinPartitions(quoted(key))


def _complete_rows(df: DataFrame, names: list[str], target: str, key: str, truths: list[str]) -> DataFrame:
    """Packed rows without gaps. They are parsed once and written: splitting, scaling and
    fitting read them many times, and their plans need not carry the parsing of every column.
    """
    packed = pack_features(df, names, truths=truths)
    slim = packed.select(quoted(key).alias(key), quoted(target).alias(TARGET), "values")
    rows = written(slim)
    return _typed_target(complete_features(rows).dropna("any", subset=[TARGET]))


def _typed_target(rows: DataFrame) -> DataFrame:
    """A target of numbers written as text becomes numeric, so that classes sort by value."""
    if dict(rows.dtypes)[TARGET] != "string":
        return rows
    number = to_number(TARGET)
    found = rows.agg(
        F.count(TARGET).alias("values"), F.count(number).alias("numbers"), F.count_if(number == F.floor(number)).alias("whole")
    ).first()
    if not found["values"] or found["numbers"] < found["values"]:
        return rows
    return rows.withColumn(TARGET, number.cast("long") if found["whole"] == found["values"] else number)


def prepare_forest_table(df: DataFrame, target: str, key: str = KEY) -> FeatureTable:
    """Columns without values dropped, every feature coerced, incomplete rows gone.

    The order matters: a column of pure text has values, so it stays, is all NULL once coerced,
    and then takes every row with it.
    """
    keyed = with_key(df, key)
    profile = column_profile(keyed, feature_columns(keyed, target, key))
    names = [name for name, (values, _) in profile.items() if values > 0]
    rows = _complete_rows(keyed, names, target, key, truth_columns(profile))
    require_trainable(rows, TARGET, min_classes=1)
    return FeatureTable(rows, names)


def prepare_svm_table(df: DataFrame, target: str, key: str = KEY) -> FeatureTable:
    """Incomplete rows gone, text features coerced, rows that did not survive it gone as well.

    A feature missing before coercion is missing after it, so one filter does for both.
    """
    keyed = with_key(df, key)
    names = feature_columns(keyed, target, key)
    truths = truth_columns(column_profile(keyed, names))
    rows = _complete_rows(keyed, names, target, key, truths)
    require_trainable(rows, TARGET)
    return FeatureTable(rows, names)
