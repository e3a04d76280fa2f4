"""Totals and trends that are kept up to date batch by batch.

An applied batch leaves two small tables in folders of its own: the keys it was the first to bring, and its counts by
month and label. Reports add up the counts of all batches and do not touch the comments. A comment that an earlier
batch brought already counts once; late comments count in the month of their time, whenever they come. Applying a batch
again replaces its two folders, so a batch that broke off half way, or came twice, does no harm. Comments of
one key are taken to be equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.labels import NEGATIVE, POSITIVE
from voxtally.functions.times import month_start
from voxtally.operators.comments import TIME
from voxtally.operators.trends import named_months, with_percents
from voxtally.session import bounded_broadcast, written

COUNTS = "month_start date, label string, n long, batch string"


@dataclass(frozen=True)
class TrendStore:
    """Counts of enriched comments under a folder; ``key`` tells comments apart."""

    spark: SparkSession
    path: str
    key: str = "comment_id"
    ts: str = TIME
    label: str = "label"

    def _batches(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _put(self, rows: DataFrame, table: str, batch: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def apply(self, comments: DataFrame, batch: str) -> None:
        """Take in a batch of enriched comments under its id, a word of letters, digits, ``-`` and ``_``.

        One batch at a time. Only keys are compared with those of other batches: a batch within the broadcast bound
        is looked for in them without a shuffle.
        """
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError(f"no id of a batch: {batch!r}")
        month = F.when(F.col(self.ts).isNotNull(), month_start(self.ts))
        slim = comments.select(F.col(self.key).alias("key"), month.alias("month_start"), F.col(self.label).alias("label"))
        rows = written(slim.groupBy("key").agg(F.min(F.struct("month_start", "label")).alias("row")).select("key", "row.*"))
        kind = rows.schema["key"].dataType.simpleString()
        others = self._batches("keys", f"key {kind}, batch string").filter(F.col("batch") != batch).select("key")
        known = others.join(bounded_broadcast(rows.select("key")), "key", "left_semi").distinct()
        fresh = written(rows.join(known, "key", "left_anti"))
        self._put(fresh.groupBy("month_start", "label").agg(F.count(F.lit(1)).alias("n")), "counts", batch)
        self._put(fresh.select("key"), "keys", batch)

    def counts(self) -> DataFrame:
        """``month_start, label, n`` over all batches; comments without a time have no month."""
        return self._batches("counts", COUNTS).groupBy("month_start", "label").agg(F.sum("n").alias("n"))

    def _by_label(self, label: str):
        return F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0))

    def sentiment_totals(self) -> DataFrame:
        """As :func:`voxtally.operators.trends.sentiment_totals`."""
        return with_percents(
            self.counts().agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
                self._by_label(POSITIVE).alias("positive"),
                self._by_label(NEGATIVE).alias("negative"),
            )
        )

    def monthly_counts(self) -> DataFrame:
        """As :func:`voxtally.operators.trends.monthly_counts`."""
        return self.counts().filter("month_start is not null").groupBy("month_start").agg(F.sum("n").alias("n"))

    def monthly_trend(self, month_only_order: bool = False) -> DataFrame:
        """As :func:`voxtally.operators.trends.monthly_trend`."""
        grouped = (
            self.counts()
            .filter("month_start is not null")
            .groupBy("month_start")
            .agg(self._by_label(POSITIVE).alias(POSITIVE), self._by_label(NEGATIVE).alias(NEGATIVE))
        )
        return named_months(grouped, month_only_order)
