"""A support vector machine with a radial kernel.

The machines are linear (:mod:`voxtally.plans.machines`). Random Fourier features (Rahimi and Recht, 2007) map a row to
``sqrt(2/D) cos(Wx + b)``, whose inner products approximate the radial kernel, so that a linear
machine on them is a kernel machine on the original features; the error falls with ``D``. ``kernel_map="nystrom"``
takes features that fit the data instead (:mod:`voxtally.plans.nystrom`), with at most ``D`` landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.operators import metrics
from voxtally.operators.classes import decode_labels, encode_labels, label_index
from voxtally.operators.features import Standardizer
from voxtally.operators.splits import stratified_folds, stratified_split
from voxtally.plans import machines, nystrom
from voxtally.plans.training import KEY, TARGET, TrainingRun, prepare_svm_table

# The machine's parameters.
GRID = {"C": [100.0], "gamma": [0.001]}
TEST_FRACTION, SEED = 0.4, 42
FOLDS = 5
DIMENSION = 1024


class FourierFeatures(
    Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable
):
    """Random Fourier features of an array of numbers, as a vector."""

    gamma = Param(Params._dummy(), "gamma", "width of the radial kernel", TypeConverters.toFloat)
    dimension = Param(Params._dummy(), "dimension", "number of random features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol="features", gamma=0.001, dimension=DIMENSION, seed=SEED):
        super().__init__()
        self._setDefault(outputCol="features", gamma=0.001, dimension=DIMENSION, seed=SEED)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, seed = self.getOrDefault(self.dimension), self.getSeed()
        scale, factor = np.sqrt(2.0 * self.getOrDefault(self.gamma)), np.sqrt(2.0 / size)

        @F.pandas_udf("array<double>")
        def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matrix = shift = None
            for rows in nystrom.row_blocks(batches):
                if not len(rows):
                    yield pd.Series([], dtype=object)
                    continue
                if matrix is None:
                    # The same directions and phases in every task.
                    generator = np.random.default_rng(seed)
                    matrix = generator.normal(0.0, scale, (rows.shape[1], size))
                    shift = generator.uniform(0.0, 2.0 * np.pi, size)
                yield pd.Series(list(factor * np.cos(rows @ matrix + shift)))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped(F.col(self.getInputCol()))))


@dataclass(frozen=True)
class SvmData:
    """Split rows with numbered classes and the scaling of the training side, ready to be fitted
    with several parameters."""

    rows: DataFrame
    names: list[str]
    labels: DataFrame
    scaler: Standardizer
    key: str


def prepare(
    df: DataFrame, target: str, key: str = KEY, test_fraction: float = TEST_FRACTION, seed: int = SEED
) -> SvmData:
    """Clean, split 60/40 by class and find the scaling."""
    table = prepare_svm_table(df, target, key)
    labels = label_index(table.rows, TARGET)
    coded = encode_labels(table.rows, TARGET, labels)
    split = stratified_split(coded, key, TARGET, test_fraction, seed, stratify=True)
    scaler = Standardizer.fit(split.filter("split = 'train'"))
    return SvmData(split, table.names, labels, scaler, key)


def feature_map(train: DataFrame, key: str, kernel_map: str, gamma: float, dimension: int, seed: int) -> Transformer:
    """The map of scaled rows to features: random ones, or by landmarks of the given (scaled) rows."""
    if kernel_map == "fourier":
        return FourierFeatures(inputCol="scaled", gamma=gamma, dimension=dimension, seed=seed)
    if kernel_map != "nystrom":
        raise ValueError(f"no such map: {kernel_map}")
    found = nystrom.landmarks(train, key, "scaled", gamma, dimension, seed=seed)
    return nystrom.NystromFeatures.by(found, "scaled", gamma)


def fit(
    data: SvmData,
    C: float = GRID["C"][0],
    gamma: float = GRID["gamma"][0],
    dimension: int = DIMENSION,
    iterations: int = 50,
    seed: int = SEED,
    kernel_map: str = "fourier",
) -> TrainingRun:
    """Fit with class weights and predict the test side."""
    return _fit_all(data, [C], gamma, dimension, iterations, seed, kernel_map)[0]


def _fit_all(
    data: SvmData,
    values: list[float],
    gamma: float,
    dimension: int = DIMENSION,
    iterations: int = 50,
    seed: int = SEED,
    kernel_map: str = "fourier",
) -> list[TrainingRun]:
    """A run for each value of C; the rows are scaled and mapped once for all of them.

    Balanced weights sum up to the rows, which turns C into Spark's regularisation ``1 / (C * rows)``.
    """
    scaling = data.scaler.stage()
    train = scaling.transform(data.rows.filter("split = 'train'"))
    mapping = feature_map(train, data.key, kernel_map, gamma, dimension, seed)
    mapped, classes = machines.Rows(mapping.transform(train)), data.labels.count()
    tasks = [machines.tasks_of(classes, C) for C in values]
    fitted = iter(machines.fit(mapped, list(chain(*tasks)), classes, 0, iterations))
    mapped.close()
    models = [machines.LinearMachines.by(list(islice(fitted, len(each)))) for each in tasks]
    return [_run(data, PipelineModel(stages=[scaling, mapping, model])) for model in models]


def _run(data: SvmData, model: PipelineModel) -> TrainingRun:
    scored = model.transform(data.rows.filter("split = 'test'")).withColumnRenamed("prediction", "prediction_index")
    decoded = decode_labels(scored, "prediction_index", data.labels, "prediction")
    predictions = decoded.select(data.key, F.col(TARGET).alias("label"), "prediction")
    return TrainingRun(model, predictions, data.labels, data.names)


def train_kernel_svm(df: DataFrame, target: str, key: str = KEY, **parameters) -> TrainingRun:
    return fit(prepare(df, target, key), **parameters)


def fold_accuracies(
    data: SvmData,
    values: list[float],
    gamma: float,
    folds: int = FOLDS,
    dimension: int = DIMENSION,
    iterations: int = 50,
    seed: int = SEED,
    kernel_map: str = "fourier",
) -> list[list[float]]:
    """For each value of C the accuracy on each fold of the training side, by a fit on the other folds.

    The training side is scaled and mapped once. A fold is a mask: a fit takes the rows of the others, with class
    weights of their own, and the accuracy those of the fold. All folds, values and classes are fitted together.
    """
    train = stratified_folds(data.rows.filter("split = 'train'").drop("split"), data.key, TARGET, folds, seed + 1)
    train = data.scaler.stage().transform(train)
    mapping = feature_map(train, data.key, kernel_map, gamma, dimension, seed)
    mapped, classes = machines.Rows(mapping.transform(train), "fold"), data.labels.count()
    places = [(C, fold) for C in values for fold in range(folds)]
    tasks = [machines.tasks_of(classes, C, fold) for C, fold in places]
    fitted = iter(machines.fit(mapped, list(chain(*tasks)), classes, folds, iterations))
    sets = [(fold, list(islice(fitted, len(each)))) for (_, fold), each in zip(places, tasks, strict=True)]
    found = machines.accuracies(mapped, sets)
    mapped.close()
    return [found[i * folds : (i + 1) * folds] for i in range(len(values))]


def grid_search(
    data: SvmData, grid: dict[str, list[float]] | None = None, folds: int = FOLDS, **parameters
) -> DataFrame:
    """``C, gamma, accuracy, chosen, test_accuracy, deviation`` for every combination of the grid.

    ``accuracy`` and ``deviation`` are mean and standard deviation over stratified folds of the training side, each
    predicted by a fit on the others. The best combination (the first of equals) is fitted on the whole training
    side and only then meets the test side.
    """
    grid, rows = grid or GRID, []
    for gamma in grid["gamma"]:
        for C, found in zip(grid["C"], fold_accuracies(data, grid["C"], gamma, folds, **parameters), strict=True):
            rows.append((float(C), float(gamma), float(np.mean(found)), float(np.std(found))))
    best = max(range(len(rows)), key=lambda i: (rows[i][2], -i))
    final = fit(data, rows[best][0], rows[best][1], **parameters)
    tested = metrics.accuracy(final.predictions).first()["accuracy"]
    table = [(C, gamma, mean, i == best, tested if i == best else None, deviation) for i, (C, gamma, mean, deviation) in enumerate(rows)]
    schema = "C double, gamma double, accuracy double, chosen boolean, test_accuracy double, deviation double"
    return data.rows.sparkSession.createDataFrame(table, schema)
