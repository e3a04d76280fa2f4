"""A feature map for the radial kernel that fits the data: Nyström's method with adaptive landmarks.

Landmarks are rows of the table. With ``K`` the kernel among them, ``k(x)`` the kernels of a row with them and
``K = U diag(s) U'``, the features ``k(x) U diag(s) ** -0.5`` have the inner products of the kernel's projection on the
span of the landmarks. What a row lacks, ``1 - |features| ** 2``, is its residual. Landmarks come in rounds:
each draws rows with chances in proportion to their residuals, in one pass over the table and a top-k of random
keys, so rows that the landmarks so far describe badly are likely to be taken, and copies of a landmark never.
The mean of the residuals is the exact error of the kernel matrix's trace, per row; it bounds each single
kernel value's error by the geometric mean of the two rows' residuals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.operators.columns import quoted

#: Landmarks (also the features' number, at most), and the rounds in which they are drawn.
LANDMARKS, ROUNDS = 256, 4
SEED = 42
#: Directions of the landmarks' kernel with a smaller share of the largest eigenvalue are left out.
SMALLEST = 1e-10
#: Rows that are mapped at once: their features are many times wider than the rows that Spark hands over.
BLOCK_ROWS = 256


def row_blocks(batches: Iterator[pd.Series]) -> Iterator[np.ndarray]:
    """The arrays of Spark's batches as matrices of at most ``BLOCK_ROWS`` rows; an empty batch is an empty one."""
    for batch in batches:
        arrays = batch.to_numpy()
        if not len(arrays):
            yield np.zeros((0, 0))
        for start in range(0, len(arrays), BLOCK_ROWS):
            yield np.stack(arrays[start : start + BLOCK_ROWS])


def kernel(rows: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """The radial kernel of all rows with all landmarks."""
    squares = (rows * rows).sum(axis=1)[:, None] + (landmarks * landmarks).sum(axis=1)[None, :]
    return np.exp(-gamma * np.maximum(squares - 2.0 * rows @ landmarks.T, 0.0))


def whitening(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """The matrix that turns kernels with the landmarks into features."""
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks, gamma))
    kept = values > SMALLEST * values.max()
    return vectors[:, kept] / np.sqrt(values[kept])


def features_of(rows: np.ndarray, landmarks: np.ndarray, white: np.ndarray, gamma: float) -> np.ndarray:
    return kernel(rows, landmarks, gamma) @ white


def residual(values: str, landmarks: np.ndarray, gamma: float) -> Column:
    """What the landmarks lack of each row, from 0 to 1."""

    @F.pandas_udf("double")
    def lacking(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        white = whitening(landmarks, gamma)
        for block in row_blocks(batches):
            found = features_of(block, landmarks, white, gamma) if len(block) else np.zeros((0, 1))
            yield pd.Series(np.clip(1.0 - (found * found).sum(axis=1), 0.0, 1.0))

    return lacking(quoted(values))


def landmarks(
    rows: DataFrame, key: str, values: str, gamma: float, count: int = LANDMARKS, rounds: int = ROUNDS, seed: int = SEED
) -> np.ndarray:
    """At most ``count`` landmarks among the rows' arrays ``values``; fewer if the rows need no more.

    Draws depend on seed and key only, not on the layout of the table.
    """
    found: np.ndarray | None = None
    for number in range(rounds):
        wanted = count * (number + 1) // rounds - (0 if found is None else len(found))
        chance = F.lit(1.0) if found is None else residual(values, found, gamma)
        # an even random number of the key; the least of these waiting times are draws in proportion to the chances
        even = (F.pmod(F.xxhash64(F.lit(seed), F.lit(number), quoted(key)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        drawn = rows.select(quoted(values).alias("values"), chance.alias("chance"), (-F.log(even)).alias("wait"))
        least = drawn.filter(F.col("chance") > 1e-9).orderBy(F.col("wait") / F.col("chance"), "values").limit(wanted)
        fresh = [row.values for row in least.select("values").collect()]
        if not fresh:
            break
        found = np.array(fresh) if found is None else np.unique(np.concatenate([found, fresh]), axis=0)
        found = np.unique(found, axis=0)
    return np.zeros((0, 0)) if found is None else found


def error_bound(rows: DataFrame, values: str, points: np.ndarray, gamma: float) -> DataFrame:
    """``landmarks, mean_residual, largest_residual``: exact over all rows, from one pass."""
    lacking = rows.select(residual(values, points, gamma).alias("residual"))
    return lacking.agg(F.avg("residual").alias("mean_residual"), F.max("residual").alias("largest_residual")).select(
        F.lit(len(points)).alias("landmarks"), "mean_residual", "largest_residual"
    )


class NystromFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Features of an array of numbers by landmarks, as a vector."""

    gamma = Param(Params._dummy(), "gamma", "width of the radial kernel", TypeConverters.toFloat)
    points = Param(Params._dummy(), "points", "the landmarks, one after the other", TypeConverters.toListFloat)
    width = Param(Params._dummy(), "width", "numbers of a landmark", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol="features", gamma=0.001, points=None, width=None):
        super().__init__()
        self._setDefault(outputCol="features", gamma=0.001)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def by(cls, found: np.ndarray, input_column: str, gamma: float) -> NystromFeatures:
        return cls(inputCol=input_column, gamma=float(gamma), points=found.ravel().tolist(), width=int(found.shape[1]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma = self.getOrDefault(self.gamma)
        found = np.array(self.getOrDefault(self.points)).reshape(-1, self.getOrDefault(self.width))
        shared = dataset.sparkSession.sparkContext.broadcast((found, whitening(found, gamma)))

        @F.pandas_udf("array<double>")
        def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            points, white = shared.value
            for block in row_blocks(batches):
                yield pd.Series(list(features_of(block, points, white, gamma)) if len(block) else [], dtype=object)

        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped(quoted(self.getInputCol()))))
