"""Training a text classifier epoch by epoch, with a validation side, early stopping and resumable state.

Texts become hashed word counts, weighted by rarity on the training side and scaled to length one. They are written
once, in a folder for each side and step. An epoch takes the training side's steps in turn: a step reads its
share of the rows, each task sums the weighted gradient of its rows into one vector, a second level of tasks
sums those, and the driver, which sees a bounded number of vectors, moves the weights (Adam with decoupled decay).
After the last step the validation side is read once for its loss and class counts. The state after an
epoch (weights, moments, history, best weights so far) can be written and training be taken up from it.

The seven figures of an epoch: ``train_loss`` (class-weighted) and ``train_acc`` as met on the way, ``val_loss``
(unweighted), ``val_acc``, and ``val_precision``, ``val_recall``, ``val_f1`` weighted by support.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxtally.functions.labels import label_name
from voxtally.functions.text import clean_text, tokens
from voxtally.operators import runs
from voxtally.operators.classes import class_weights
from voxtally.operators.cleaning import require_trainable, text_training_rows
from voxtally.operators.columns import quoted
from voxtally.operators.splits import three_way_split
from voxtally.session import bounded_broadcast, new_table_path, written

SEED = 42
FEATURES = 1 << 16
#: Tasks of the second level, which is what the driver gets to see of a step.
MERGERS = 16
#: Rows that a worker turns into numbers at once; Spark hands over up to 10,000, whose words take many times their room.
SLICE_ROWS = 512
#: Rows of a file of prepared texts.
FILE_ROWS = 20_000
METRICS = ("train_loss", "train_acc", "val_loss", "val_acc", "val_precision", "val_recall", "val_f1")
HISTORY = "run_id string, epoch int, " + ", ".join(f"{name} double" for name in METRICS)


@dataclass(frozen=True)
class Settings:
    """What a training run depends on besides its rows."""

    features: int = FEATURES
    epochs: int = 20
    patience: int = 3
    steps: int = 4
    rate: float = 0.1
    decay: float = 0.001
    seed: int = SEED
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8


@dataclass
class State:
    """Weights (the last one is the intercept), moments, and what happened so far."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    best: np.ndarray
    updates: int = 0
    history: list[dict] = field(default_factory=list)
    best_acc: float = runs.START_ACCURACY
    waited: int = 0

    @classmethod
    def start(cls, features: int) -> State:
        return cls(*(np.zeros(features + 1) for _ in range(4)))

    def move(self, gradient: np.ndarray, settings: Settings) -> None:
        """One step of Adam with decoupled decay; the intercept does not decay."""
        self.updates += 1
        self.first += (1 - settings.beta1) * (gradient - self.first)
        self.second += (1 - settings.beta2) * (gradient * gradient - self.second)
        level = self.first / (1 - settings.beta1**self.updates)
        spread = np.sqrt(self.second / (1 - settings.beta2**self.updates)) + settings.epsilon
        self.weights[:-1] *= 1 - settings.rate * settings.decay
        self.weights -= settings.rate * level / spread

    def finish_epoch(self, figures: dict) -> None:
        """Log an epoch; keep its weights if its validation accuracy beats all before it."""
        self.history.append(figures)
        if figures["val_acc"] > self.best_acc:
            self.best, self.best_acc, self.waited = self.weights.copy(), figures["val_acc"], 0
        else:
            self.waited += 1

    def write(self, spark: SparkSession, path: str) -> None:
        """Add the state after its last epoch to the table at ``path``."""
        arrays = [bytearray(x.tobytes()) for x in (self.weights, self.first, self.second, self.best)]
        told = json.dumps({"history": self.history, "best_acc": self.best_acc, "waited": self.waited})
        row = (len(self.history), *arrays, self.updates, told)
        schema = "epoch int, weights binary, first binary, second binary, best binary, updates long, told string"
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").partitionBy("epoch").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> State | None:
        """The state after the last epoch in the table at ``path``, None without a table."""
        try:
            row = spark.read.parquet(path).orderBy(F.desc("epoch")).first()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        told = json.loads(row.told)
        arrays = (np.frombuffer(row[name]).copy() for name in ("weights", "first", "second", "best"))
        return cls(*arrays, row.updates, told["history"], told["best_acc"], told["waited"])


def hashed_words(text: Column | str, features: int) -> Column:
    """The places of a text's words, repeats included."""
    return F.transform(tokens(text), lambda word: F.pmod(F.xxhash64(word), F.lit(features)).cast("int"))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, at most ``SLICE_ROWS`` at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, places of words, as distinct places and their counts."""
    for batch in slices(batches):
        places, counts = [], []
        for words in batch.column(batch.num_columns - 1):
            met, times = np.unique(words.values.to_numpy(zero_copy_only=False) if words.is_valid else (), return_counts=True)
            places.append(met.astype(np.int32)), counts.append(times.astype(np.float32))
        columns = [pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "places", "counts"])


def with_counts(df: DataFrame, words: str) -> DataFrame:
    """``places`` and ``counts`` instead of the column ``words``, an array of word places."""
    rest = df.drop(words)
    ordered = df.select(*map(quoted, rest.columns), quoted(words))
    schema = StructType([*rest.schema.fields, *StructType.fromDDL("places array<int>, counts array<float>").fields])
    return ordered.mapInArrow(_counted, schema)


class Rows:
    """A batch of prepared texts as one flat run of (row, place, value)."""

    def __init__(self, batch: pa.RecordBatch, rarity: np.ndarray):
        places, counts = batch.columns[-2:]
        self.size = batch.num_rows
        lengths = np.diff(places.offsets.to_numpy())
        self.row = np.repeat(np.arange(self.size), lengths)
        self.place = places.flatten().to_numpy(zero_copy_only=False)
        value = counts.flatten().to_numpy(zero_copy_only=False) * rarity[self.place]
        norm = np.sqrt(np.bincount(self.row, value * value, self.size))
        self.value = value / np.where(norm > 0, norm, 1.0)[self.row]

    def margins(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.place], self.size) + weights[-1]

    def gradient(self, slopes: np.ndarray, features: int) -> np.ndarray:
        """The sum of the rows' gradients, given the loss's slope by each row's margin."""
        by_place = np.bincount(self.place, self.value * slopes[self.row], features)
        return np.append(by_place, slopes.sum())


def loss_of(margins: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The cross entropy of each row."""
    return np.logaddexp(0.0, np.where(labels == 1, -margins, margins))


def scores(tn: float, fp: float, fn: float, tp: float) -> dict[str, float]:
    """Accuracy and the support-weighted precision, recall and F1 of two classes; undefined ones are 0."""
    total = tn + fp + fn + tp
    out = {"val_acc": (tn + tp) / total if total else 0.0, "val_precision": 0.0, "val_recall": 0.0, "val_f1": 0.0}
    for hits, support, predicted in ((tn, tn + fp, tn + fn), (tp, fn + tp, fp + tp)):
        precision = hits / predicted if predicted else 0.0
        recall = hits / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        share = support / total if total else 0.0
        for name, x in (("val_precision", precision), ("val_recall", recall), ("val_f1", f1)):
            out[name] += share * x
    return out


@dataclass(frozen=True)
class Prepared:
    """Texts ready for training: the table's folder, its columns and the rarity of each place."""

    spark: SparkSession
    path: str
    key: str
    rarity: np.ndarray

    def side(self, split: str, step: int | None = None) -> DataFrame:
        """The rows of one side of the split; of one step, only its folder is read."""
        rows = self.spark.read.parquet(self.path).filter(F.col("split") == split)
        return rows if step is None else rows.filter(F.col("step") == step)


def prepare(df: DataFrame, key: str, text: str, sentiment: str, settings: Settings) -> Prepared:
    """Clean, split 80/10/10 by class, weigh classes by the training side, count words, write."""
    spark = df.sparkSession
    clean = written(text_training_rows(df, text, sentiment).select(key, text, "label"))
    require_trainable(clean, "label")
    rows = three_way_split(clean, key, "label", seed=settings.seed)
    weights = class_weights(rows.filter("split = 'train'"), "label").select("label", "weight")
    weighed = rows.join(bounded_broadcast(weights), "label", "left")
    step = F.when(F.col("split") == "train", F.pmod(F.xxhash64(F.lit(settings.seed), F.col(key)), F.lit(settings.steps)))
    words = hashed_words(text, settings.features).alias("words")
    slim = weighed.select(F.col(key).alias("_key"), "label", "weight", "split", F.coalesce(step, F.lit(0)).cast("int").alias("step"), words)
    counted = with_counts(slim, "words")
    path = new_table_path(spark)
    files = max(1, math.ceil(clean.count() / FILE_ROWS))
    dealt = counted.repartition(files, F.xxhash64("_key") % files).sortWithinPartitions("split", "step", "_key")
    dealt.write.partitionBy("split", "step").parquet(path)
    train = spark.read.parquet(path).filter("split = 'train'")
    seen = train.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("n")).collect()
    rarity = np.full(settings.features, math.log(train.count() + 1.0))
    for row in seen:  # a row a place at most
        rarity[row.place] -= math.log(row.n + 1.0)
    return Prepared(spark, path, key, rarity)


def _step_sums(rows: DataFrame, weights, rarity, features: int) -> DataFrame:
    """One row a task: its number, the summed gradient, weighted loss, weight, hits and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gradient, told = np.zeros(features + 1), np.zeros(4)
        for batch in slices(batches):
            found = Rows(batch, rarity.value)
            label, weight = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("label", "weight"))
            margins = found.margins(weights.value)
            gradient += found.gradient(weight * (1 / (1 + np.exp(-margins)) - label), features)
            hits = ((margins > 0) == (label == 1)).sum()
            told += [(weight * loss_of(margins, label)).sum(), weight.sum(), hits, found.size]
        yield _sums(TaskContext.get().partitionId(), gradient, told)

    return rows.select("label", "weight", "places", "counts").mapInArrow(run, "part int, sums binary")


def _sums(part: int, gradient: np.ndarray, told: np.ndarray) -> pa.RecordBatch:
    both = np.concatenate([told, gradient]).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([both], pa.binary())], ["part", "sums"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, least = None, None
    for batch in batches:
        for part, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            values = np.frombuffer(sums)
            total, least = (values.copy(), part) if total is None else (total + values, least)
    if total is not None:
        yield _sums(least, total[4:], total[:4])


def step_sums(rows: DataFrame, weights, rarity, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(loss, weight, hits, rows) and the gradient, summed over the rows in a fixed order of tasks."""
    parts = _step_sums(rows, weights, rarity, features)
    dealt = parts.repartition(MERGERS, "part").sortWithinPartitions("part")
    total = np.zeros(features + 5)
    for row in sorted(dealt.mapInArrow(_merged, "part int, sums binary").collect(), key=lambda r: r.part):
        total += np.frombuffer(row.sums)
    return total[:4], total[4:]


def _scored(rows: DataFrame, weights, rarity, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of prepared rows with ``margin``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            margins = pa.array(Rows(batch, rarity.value).margins(weights.value))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], margins], [*keep, "margin"])

    kept = rows.select(*map(quoted, keep))
    schema = StructType([*kept.schema.fields, *StructType.fromDDL("margin double").fields])
    return rows.select(*map(quoted, keep), "places", "counts").mapInArrow(run, schema)


def validation(rows: DataFrame, weights, rarity) -> dict[str, float]:
    """Loss and scores of a side, from one pass."""
    margin, label = F.col("margin"), F.col("label")
    away = F.when(label == 1, -margin).otherwise(margin)
    loss = F.greatest(away, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
    cell = lambda true, said: F.count_if((label == true) & ((margin > 0) == said))
    found = _scored(rows, weights, rarity, ["label"]).agg(
        F.avg(loss).alias("loss"), cell(0, False), cell(0, True), cell(1, False), cell(1, True)
    ).first()
    return {"val_loss": found.loss or 0.0, **scores(*found[1:])}


@dataclass(frozen=True)
class EpochRun:
    """A finished training: prepared rows, settings, and the state with history and best weights."""

    data: Prepared
    settings: Settings
    state: State
    run_id: str = "text"

    def epochs(self) -> DataFrame:
        """All epochs that ran, the one that stopped the training included: run_id, epoch and the seven figures."""
        rows = [(self.run_id, i, *(float(x[m]) for m in METRICS)) for i, x in enumerate(self.state.history, 1)]
        return self.data.spark.createDataFrame(rows, HISTORY)

    def history(self) -> DataFrame:
        """The logged epochs: the one that exhausts the patience is not among them."""
        traced = runs.early_stop(self.epochs(), self.settings.patience)
        return traced.filter("logged").select("run_id", "epoch", *METRICS)

    def best_epoch(self) -> DataFrame:
        return runs.best_epoch(self.epochs(), self.settings.patience)

    def predict(self, split: str = "test") -> DataFrame:
        """``key, label, prediction, probability`` of a side by the weights of the best epoch."""
        scored = _scored(self.data.side(split), *self._shipped(), ["_key", "label"])
        return scored.select(F.col("_key").alias(self.data.key), "label", *_answer())

    def classify(self, df: DataFrame, text: str, name: str = "model_sentiment") -> DataFrame:
        """Add the sentiment of any texts by the weights of the best epoch."""
        numbered = [f"column_{i}" for i in range(len(df.columns))]  # so that no name of theirs is in the way
        words = hashed_words(clean_text(quoted(text)), self.settings.features)
        rows = df.select(*(quoted(c).alias(n) for c, n in zip(df.columns, numbered, strict=True)), words.alias("words"))
        scored = _scored(with_counts(rows, "words"), *self._shipped(), numbered)
        return scored.select(*numbered, label_name(_answer()[0])).toDF(*df.columns, name)

    def _shipped(self):
        context = self.data.spark.sparkContext
        return context.broadcast(self.state.best), context.broadcast(self.data.rarity)


def _answer() -> tuple[Column, Column]:
    probability = 1 / (1 + F.exp(-F.col("margin")))
    return (F.col("margin") > 0).cast("int").alias("prediction"), probability.alias("probability")


def train_epoch(data: Prepared, state: State, settings: Settings) -> None:
    """One pass over the training side and one over the validation side."""
    context = data.spark.sparkContext
    rarity, told = context.broadcast(data.rarity), np.zeros(4)
    for step in range(settings.steps):
        weights = context.broadcast(state.weights)
        sums, gradient = step_sums(data.side("train", step), weights, rarity, settings.features)
        weights.destroy()
        told += sums
        if sums[1] > 0:
            state.move(gradient / sums[1], settings)
    weights = context.broadcast(state.weights)
    figures = validation(data.side("val"), weights, rarity)
    weights.destroy(), rarity.destroy()
    state.finish_epoch({"train_loss": told[0] / told[1], "train_acc": told[2] / told[3], **figures})


def train(
    df: DataFrame,
    key: str = "id",
    text: str = "ENGLISH",
    sentiment: str = "Sentiment",
    settings: Settings | None = None,
    state_path: str | None = None,
    **changes,
) -> EpochRun:
    """Train until the validation accuracy has not risen for ``patience`` epochs, at most ``epochs`` long.

    With ``state_path`` the state is written there after every epoch, and a training that was broken off goes on
    from the last one. Predictions use the weights of the best epoch.
    """
    settings = replace(settings or Settings(), **changes)
    data = prepare(df, key, text, sentiment, settings)
    state = State.read(data.spark, state_path) if state_path else None
    state = state or State.start(settings.features)
    while len(state.history) < settings.epochs and state.waited < settings.patience:
        train_epoch(data, state, settings)
        if state_path:
            state.write(data.spark, state_path)
    return EpochRun(data, settings, state)
