"""Sentiment labels as text, as 0/1 and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally.functions.columns import as_column

POSITIVE = "Positive"
NEGATIVE = "Negative"
SENTIMENTS = (POSITIVE, NEGATIVE)

# The training labels accepted, exactly as spelled.
TRAINING_LABELS = {"Negative": 0, "Positive": 1, "negative": 0, "positive": 1}


def canonical_label(label: Column | str) -> Column:
    """``Positive`` if the label mentions it in any case, else ``Negative`` (also for NULL)."""
    mentions = F.lower(as_column(label)).contains("positive")
    return F.when(mentions, F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE))


def label_to_int(label: Column | str) -> Column:
    """0 or 1 for an accepted training label, NULL for any other text."""
    column = as_column(label)
    names = {0: [], 1: []}
    for name, value in TRAINING_LABELS.items():
        names[value].append(name)
    return F.when(column.isin(names[0]), F.lit(0)).when(column.isin(names[1]), F.lit(1))


def label_name(label: Column | str) -> Column:
    column = as_column(label)
    return F.when(column == 1, F.lit(POSITIVE)).when(column.isNotNull(), F.lit(NEGATIVE))
