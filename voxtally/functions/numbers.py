"""Number columns: percentages, text to number, softmax over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally.functions.columns import as_column

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE = r"^\s*[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?\s*$"


def percent(part: Column | str, whole: Column | str) -> Column:
    """``100 * part / whole``, 0 when there is nothing."""
    whole = as_column(whole)
    return F.when(whole > 0, 100.0 * as_column(part) / whole).otherwise(F.lit(0.0))


def to_number(text: Column | str) -> Column:
    """Text to double, NULL for everything that is not a decimal number.

    The pattern keeps out what Java reads as a double but a table of numbers does not mean,
    such as ``1d`` or ``0x1p3``.
    """
    column = as_column(text).cast("string")
    return F.when(column.rlike(NUMBER) | column.rlike(INFINITE), F.trim(column).try_cast("double"))


def softmax(logits: Column | str) -> Column:
    """Array of logits to array of probabilities; shifted by the maximum against overflow."""
    column = as_column(logits)
    exps = F.transform(column, lambda x: F.exp(x.cast("double") - F.array_max(column).cast("double")))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(exps, lambda x: x / total)


def argmax(values: Column | str) -> Column:
    """Position (from 0) of the largest element; the first one of equals."""
    column = as_column(values)
    return (F.array_position(column, F.array_max(column)) - 1).cast("int")
