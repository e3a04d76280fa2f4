"""Linear support vector machines that are fitted together, one pass over the rows for all of them.

A search over classes, parameters and folds fits many machines to the same rows, each in many small steps. Fitted one by
one, every trial point of every machine is a job of its own and every machine keeps a copy of the rows. Here the machines
go on in step: each says at which point it has to know its loss, and one pass tells all of them, with a product of
matrices a block of rows. The rows lie once, in blocks of numbers. The loss and the method are those of Spark's
``LinearSVC``: weighted hinge loss on scaled and centred features, squared norm of the coefficients, OWL-QN (Andrew and
Gao, 2007) without an L1 part.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from voxtally.operators.columns import quoted
from voxtally.plans.nystrom import row_blocks

#: Rows of a block, machines of a pass, and tasks that add up the sums of more tasks than these.
BLOCK_ROWS, TOGETHER, MERGERS = 1024, 64, 32
#: Steps and gradients remembered, trial points of a line search at most, and when a fit has converged.
MEMORY, TRIALS, TOLERANCE = 10, 19, 1e-6
#: Values of the loss that are compared to tell that it falls no further.
WINDOW = 20
#: A smaller variance, of the squared mean, is none: it is what rounding leaves of a constant.
CONSTANT = 1e-13
BLOCK = "n int, label binary, fold binary, rows binary"
SUMS = "part int, sums binary"

Told = tuple[float, np.ndarray]


class SearchFailed(ArithmeticError):
    """No step along the direction lowers the loss as it should."""


def _direction(slope: np.ndarray, steps: list[np.ndarray], turns: list[np.ndarray]) -> np.ndarray:
    """Down the slope, bent by the last steps and the turns the gradient made on them (latest first)."""
    found, shares = slope.copy(), []
    if any(not step @ turn > 0 for step, turn in zip(steps, turns, strict=True)):
        raise SearchFailed("the loss does not curve along a step")
    for step, turn in zip(steps, turns, strict=True):
        shares.append((step @ found) / (step @ turn))
        found -= shares[-1] * turn
    if steps:
        found *= (steps[0] @ turns[0]) / (turns[0] @ turns[0])
    for step, turn, share in zip(reversed(steps), reversed(turns), reversed(shares), strict=True):
        found += (share - (turn @ found) / (step @ turn)) * step
    return np.where(found * slope > 0, -found, 0.0)


def _line(x: np.ndarray, value: float, slope: np.ndarray, way: np.ndarray, length: float, shrink: float):
    """The point that a search along ``way`` ends at, with its loss and gradient (strong Wolfe conditions).

    Points stay on the side of zero they are on, feature by feature, as far as they go.
    """
    side, fall = np.sign(np.where(x != 0, x, -slope)), slope @ way
    reached = None
    for _ in range(TRIALS):
        point = x + length * way
        point = np.where(np.sign(point) == side, point, 0.0)
        told = yield point
        reached, steep = (point, *told), told[1] @ way
        if told[0] > value + length * fall * 1e-4:
            length *= shrink
        elif steep < 0.9 * fall:
            length *= 2.1
        elif steep > -0.9 * fall:
            length *= shrink
        else:
            break
        if not 1e-10 <= length <= 1e10:
            raise SearchFailed("no step length")
    return reached


def descent(width: int, iterations: int) -> Generator[np.ndarray, Told, tuple[np.ndarray, list[float]]]:
    """Ask for loss and gradient at one point after another; returns the last point and the loss after each step."""
    x = np.zeros(width)
    value, slope = yield x
    history, steps, turns, failed = [value], [], [], False
    while len(history) <= iterations:
        flat = len(history) > WINDOW and abs(value - max(history[-WINDOW:])) <= TOLERANCE * history[0]
        if flat or np.linalg.norm(slope) <= max(TOLERANCE * value, 1e-8):
            break
        first = len(history) == 1
        try:
            way = _direction(slope, steps, turns)
            length, shrink = (0.05 / np.linalg.norm(slope), 0.1) if first else (0.5, 0.5)
            point, value, told = yield from _line(x, value, slope, way, length, shrink)
        except SearchFailed:
            if failed:
                break
            failed, steps, turns = True, [], []
            continue
        failed, steps, turns = False, [point - x, *steps][:MEMORY], [told - slope, *turns][:MEMORY]
        x, slope = point, told
        history.append(value)
    return x, history


@dataclass(frozen=True)
class Task:
    """A machine to be fitted: ``target`` against all other classes, on the rows outside of ``fold`` (-1: all)."""

    target: int
    C: float
    fold: int = -1


@dataclass(frozen=True)
class Machine:
    """Coefficients and intercept by the features as they are, and the loss after each step."""

    coefficients: np.ndarray
    intercept: float
    history: list[float]


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            label, fold = (part.column(i).cast(pa.int32()).to_numpy() for i in (0, 1))
            cells = part.column(2).flatten().to_numpy().astype("float64", copy=False)
            cut = [pa.array([x.tobytes()], pa.binary()) for x in (label, fold, cells)]
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), *cut], ["n", "label", "fold", "rows"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for n, label, fold, cells in zip(*batch.columns, strict=True):
            places = (np.frombuffer(x.as_buffer(), "int32") for x in (label, fold))
            yield *places, np.frombuffer(cells.as_buffer(), "float64").reshape(n.as_py(), -1)


def _sums(part: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["part", "sums"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, least = None, 0
    for batch in batches:
        for part, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = np.frombuffer(sums.as_buffer())
            total, least = (found.copy(), part) if total is None else (total + found, least)
    if total is not None:
        yield _sums(least, total)


class Rows:
    """Rows with ``label_index``, ``fold`` (-1 without folds) and ``features``, kept as blocks of numbers."""

    def __init__(self, df: DataFrame, fold: str | None = None):
        place = F.lit(-1) if fold is None else F.col(fold)
        cells = vector_to_array("features").alias("rows")
        narrow = df.select(F.col("label_index").cast("int").alias("label"), place.cast("int").alias("fold"), cells)
        self.blocks = narrow.mapInArrow(_blocked, BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
        self.context = df.sparkSession.sparkContext
        sized = self.blocks.agg(F.sum("n").alias("n"), F.max(F.octet_length("rows") / (F.col("n") * 8)).alias("width")).first()
        if not sized["n"]:
            raise ValueError("no rows to fit on")
        self.width = int(sized["width"])
        self.parts = self.blocks.rdd.getNumPartitions()

    def close(self) -> None:
        self.blocks.unpersist()

    def total(self, sums, size: int) -> np.ndarray:
        """What ``sums(label, fold, rows)`` gives for the blocks, added up in a fixed order."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros(size)
            for block in _unpacked(batches):
                total += sums(*block)
            yield _sums(TaskContext.get().partitionId(), total)

        parts = self.blocks.mapInArrow(run, SUMS)
        if self.parts > MERGERS:
            parts = parts.repartition(MERGERS, "part").sortWithinPartitions("part").mapInArrow(_merged, SUMS)
        return sum((np.frombuffer(row.sums) for row in sorted(parts.collect(), key=lambda r: r.part)), np.zeros(size))

    def moments(self, classes: int, folds: int) -> np.ndarray:
        """Rows, sum and sum of squares of the features, by fold and class; folds count from -1."""
        width = self.width

        def sums(label, fold, cells):
            group = np.zeros(((folds + 1) * classes, len(label)))
            group[(fold + 1) * classes + label, np.arange(len(label))] = 1.0
            return np.concatenate([group.sum(axis=1)[:, None], group @ cells, group @ (cells * cells)], axis=1).ravel()

        return self.total(sums, (folds + 1) * classes * (1 + 2 * width)).reshape(folds + 1, classes, 1 + 2 * width)

    def losses(self, tasks: list[Task], weights: np.ndarray, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each machine (a column of ``points``) the weighted loss, the sum of its slopes, and their sum by feature."""
        targets, left_out = (np.array(x) for x in zip(*((t.target, t.fold) for t in tasks), strict=True))
        shared = self.context.broadcast((targets, left_out, weights, points, offsets))

        def sums(label, fold, cells):
            targets, left_out, weights, points, offsets = shared.value
            side = np.where(label[:, None] == targets, 1.0, -1.0)
            lack = 1.0 - side * (cells @ points + offsets)
            slope = weights.T[label] * ((lack > 0) & ((fold[:, None] != left_out) | (left_out == -1)))
            loss = (lack * slope).sum(axis=0)
            slope *= -side
            return np.concatenate([loss, slope.sum(axis=0), (slope.T @ cells).ravel()])

        try:
            found = self.total(sums, len(tasks) * (2 + self.width))
        finally:
            shared.destroy()
        return np.concatenate([found[: 2 * len(tasks)].reshape(2, -1).T, found[2 * len(tasks) :].reshape(len(tasks), -1)], axis=1)


@dataclass(frozen=True)
class _Frame:
    """What a machine's rows look like: weights by class, weight in all, mean and scale of the features, penalty."""

    weights: np.ndarray
    whole: float
    mean: np.ndarray
    inverse: np.ndarray
    penalty: float


def _frame(task: Task, moments: np.ndarray, width: int) -> _Frame:
    kept = moments.sum(axis=0) - (moments[task.fold + 1] if task.fold >= 0 else 0.0)
    counts = kept[:, 0]
    size, present = counts.sum(), np.count_nonzero(counts)
    if not size:
        raise ValueError("no rows to fit on")
    weights = np.divide(size, present * counts, out=np.zeros_like(counts), where=counts > 0)
    whole = weights @ counts
    mean = weights @ kept[:, 1 : 1 + width] / whole
    apart = np.maximum(weights @ kept[:, 1 + width :] - whole * mean * mean, 0.0)
    apart[apart <= CONSTANT * whole * mean * mean] = 0.0
    divisor = whole - (weights * weights) @ counts / whole
    deviation = np.sqrt(apart / divisor) if divisor > 0 else np.zeros(width)
    inverse = np.divide(1.0, deviation, out=np.zeros(width), where=deviation > 0)
    return _Frame(weights, whole, mean, inverse, 1.0 / (task.C * size))


def fit(rows: Rows, tasks: list[Task], classes: int, folds: int, iterations: int) -> list[Machine]:
    """A machine for each task, with balanced class weights of its own rows."""
    moments = rows.moments(classes, folds)
    frames = [_frame(task, moments, rows.width) for task in tasks]
    found: dict[int, Machine] = {}
    for start in range(0, len(tasks), TOGETHER):
        runs = {i: descent(rows.width + 1, iterations) for i in range(start, min(start + TOGETHER, len(tasks)))}
        asked = {i: next(run) for i, run in runs.items()}
        while asked:
            live = list(asked)
            plain = np.stack([asked[i][:-1] * frames[i].inverse for i in live], axis=1)
            offsets = np.array([asked[i][-1] - frames[i].mean @ plain[:, j] for j, i in enumerate(live)])
            sums = rows.losses([tasks[i] for i in live], np.stack([frames[i].weights for i in live]), plain, offsets)
            for j, i in enumerate(live):
                frame, (loss, slope, *_), by_feature = frames[i], sums[j], sums[j, 2:]
                value = loss / frame.whole + 0.5 * frame.penalty * (plain[:, j] @ plain[:, j])
                slopes = (by_feature - slope * frame.mean) * frame.inverse / frame.whole
                slopes += frame.penalty * plain[:, j] * frame.inverse
                try:
                    asked[i] = runs[i].send((float(value), np.append(slopes, slope / frame.whole)))
                except StopIteration as ended:
                    point, history = ended.value
                    coefficients = point[:-1] * frame.inverse
                    found[i] = Machine(coefficients, float(point[-1] - frame.mean @ coefficients), history)
                    del asked[i]
    return [found[i] for i in range(len(tasks))]


def tasks_of(classes: int, C: float, fold: int = -1) -> list[Task]:
    """One against the rest for each class; one machine, for the second class, if there are two."""
    return [Task(target, C, fold) for target in ([1] if classes == 2 else range(classes))]


def classified(margins: np.ndarray) -> np.ndarray:
    """The class of the largest margin, the first of equals; of a single machine, whether it is above zero."""
    return (margins[:, 0] > 0).astype("int64") if margins.shape[1] == 1 else margins.argmax(axis=1)


def _matrix(machines: list[Machine]) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([m.coefficients for m in machines], axis=1), np.array([m.intercept for m in machines])


def accuracies(rows: Rows, sets: list[tuple[int, list[Machine]]]) -> list[float]:
    """For each fold and the machines of its classes the share of the fold's rows they classify right, from one pass."""
    shared = rows.context.broadcast([(fold, *_matrix(machines)) for fold, machines in sets])

    def sums(label, fold, cells):
        told = []
        for held, points, offsets in shared.value:
            mine = fold == held
            said = classified(cells[mine] @ points + offsets)
            told += [float((said == label[mine]).sum()), float(mine.sum())]
        return np.array(told)

    try:
        found = rows.total(sums, 2 * len(sets)).reshape(-1, 2)
    finally:
        shared.destroy()
    return [float(hits / size) if size else 0.0 for hits, size in found]


class LinearMachines(Transformer, HasInputCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """The class that fitted machines give a vector of features."""

    numbers = Param(Params._dummy(), "numbers", "coefficients and intercept, machine after machine", TypeConverters.toListFloat)
    count = Param(Params._dummy(), "count", "number of machines", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", predictionCol="prediction", numbers=None, count=None):
        super().__init__()
        self._setDefault(inputCol="features", predictionCol="prediction")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def by(cls, machines: list[Machine]) -> LinearMachines:
        numbers = np.stack([np.append(m.coefficients, m.intercept) for m in machines])
        return cls(numbers=numbers.ravel().tolist(), count=len(machines))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        numbers = np.array(self.getOrDefault(self.numbers)).reshape(self.getOrDefault(self.count), -1)
        shared = dataset.sparkSession.sparkContext.broadcast(numbers)

        @F.pandas_udf("double")
        def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            points, offsets = shared.value[:, :-1].T, shared.value[:, -1]
            for block in row_blocks(batches):
                yield pd.Series(classified(block @ points + offsets) if len(block) else [], dtype="float64")

        return dataset.withColumn(self.getPredictionCol(), best(vector_to_array(quoted(self.getInputCol()))))
