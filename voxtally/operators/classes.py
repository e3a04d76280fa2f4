"""Class counts and what follows from them: distribution, balanced weights, label indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtally.functions.numbers import percent
from voxtally.operators.ranking import global_row_number
from voxtally.session import bounded_broadcast, bounded_table, local_table


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and percent per class. The total, one row, is added up from the finished counts."""
    counts = class_counts(df, label)
    whole = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(whole)).withColumn("percent", percent("n", F.col("_total"))).drop("_total")


def class_summary(df: DataFrame, label: str) -> DataFrame:
    """Number of classes and size of the smallest one; NULL labels are no class."""
    return class_counts(df.filter(F.col(label).isNotNull()), label).agg(
        F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("min_class_count")
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight ``n / (classes * n_class)`` per class."""
    counts = class_counts(df.filter(F.col(label).isNotNull()), label)
    whole = counts.agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_classes"))
    weight = F.col("_total") / (F.col("_classes") * F.col("n"))
    return counts.crossJoin(F.broadcast(whole)).withColumn("weight", weight).drop("_total", "_classes")


def with_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(label, F.col("weight").alias(name))
    return df.join(bounded_broadcast(weights), label, "left")


def label_index(df: DataFrame, label: str) -> DataFrame:
    """Sorted classes numbered from 0: ``label, label_index``. Numbers sort by value, text by text.

    The distinct classes are looked up once. So many that they are no small table are numbered
    by the distributed sort.
    """
    distinct = df.filter(F.col(label).isNotNull()).select(label).distinct()
    table = bounded_table(distinct)
    if table is None:
        numbered = global_row_number(distinct, [F.col(label).asc()], "_number")
        return numbered.select(label, (F.col("_number") - 1).cast("int").alias("label_index"))
    rank = F.row_number().over(Window.orderBy(label)) - 1
    return local_table(distinct, table).withColumn("label_index", rank)


def encode_labels(df: DataFrame, label: str, index: DataFrame, name: str = "label_index") -> DataFrame:
    """Add the class number; ``index`` is a :func:`label_index` table."""
    renamed = index.select(F.col(label), F.col("label_index").alias(name))
    return df.join(bounded_broadcast(renamed), label, "left")


def decode_labels(df: DataFrame, column: str, index: DataFrame, name: str) -> DataFrame:
    """Class number back to the class, added as ``name``."""
    source = next(c for c in index.columns if c != "label_index")
    renamed = index.select(F.col("label_index").cast(df.schema[column].dataType).alias(column), F.col(source).alias(name))
    return df.join(bounded_broadcast(renamed), column, "left")
