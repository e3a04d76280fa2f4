"""Standardisation with population deviation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _literal(numbers: tuple[float, ...]) -> str:
    return "array(" + ", ".join(f"{n!r}D" for n in numbers) + ")"


@dataclass(frozen=True)
class Standardizer:
    """Means and population deviations of an array of features, fitted in one pass."""

    means: tuple[float, ...]
    deviations: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, values: str = "values") -> Standardizer:
        summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(values)))
        found = df.select(summary.alias("s")).select("s.*").first()
        rows = found["count"]
        if not rows:
            raise ValueError("no rows to fit on")
        # Spark's variance is of a sample; that of the population has all rows as divisor.
        population = [max(float(v), 0.0) * (rows - 1) / rows for v in found["variance"]]
        # A constant feature has no scale; it is centred only.
        return cls(
            tuple(float(m) for m in found["mean"]), tuple(v**0.5 if v > 0 else 1.0 for v in population)
        )

    def stage(self, values: str = "values", name: str = "scaled") -> SQLTransformer:
        """The scaling as a stage of a Spark ML model, so that it is saved with it."""
        scaled = (
            f"transform({values}, (x, i) -> (x - element_at({_literal(self.means)}, i + 1))"
            f" / element_at({_literal(self.deviations)}, i + 1))"
        )
        return SQLTransformer(statement=f"SELECT *, {scaled} AS {name} FROM __THIS__")

    def transform(self, df: DataFrame, values: str = "values", name: str = "scaled") -> DataFrame:
        return self.stage(values, name).transform(df)
