"""Text classification: words to hashed counts, weighted by rarity, class-weighted logistic regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.columns import as_column
from voxtally.functions.labels import label_name
from voxtally.functions.text import WORD, clean_text
from voxtally.operators.classes import with_class_weights
from voxtally.operators.cleaning import require_trainable, text_training_rows
from voxtally.operators.splits import three_way_split
from voxtally.session import written

SEED = 42
FEATURES = 1 << 16


@dataclass(frozen=True)
class TextRun:
    model: PipelineModel
    rows: DataFrame
    key: str
    text: str

    def predict(self, split: str = "test") -> DataFrame:
        """``key, text, label, prediction, probability`` of one side of the split."""
        scored = self.model.transform(self.rows.filter(F.col("split") == split))
        return scored.select(
            self.key,
            F.col(self.text).alias("text"),
            "label",
            F.col("prediction").cast("int").alias("prediction"),
            "probability",
        )

    def history(self, run_id: str = "text") -> DataFrame:
        """``run_id, epoch, train_loss``: the objective after each iteration of the optimizer."""
        losses = self.model.stages[-1].summary.objectiveHistory
        rows = [(run_id, i, float(loss)) for i, loss in enumerate(losses)]
        return self.rows.sparkSession.createDataFrame(rows, "run_id string, epoch int, train_loss double")


def train_text_classifier(
    df: DataFrame,
    key: str = "id",
    text: str = "ENGLISH",
    sentiment: str = "Sentiment",
    features: int = FEATURES,
    iterations: int = 50,
    regularization: float = 0.01,
    seed: int = SEED,
) -> TextRun:
    """Clean, split 80/10/10 by class, weigh classes, fit on the training side.

    The cleaned rows are written once; finding the split then reads keys and labels only. So are the counts of the
    training side's words, which rarity, the features' scale and the optimizer each read in a pass of their own.
    """
    clean = written(text_training_rows(df, text, sentiment))
    require_trainable(clean, "label")
    rows = three_way_split(clean, key, "label", seed=seed)
    train = with_class_weights(rows.filter("split = 'train'"), "label")
    words = RegexTokenizer(inputCol=text, outputCol="words", pattern=f"[{WORD}]+", gaps=False)
    counts = HashingTF(inputCol="words", outputCol="counts", numFeatures=features)
    counted = counts.transform(words.transform(train.select(text, "label", "weight"))).select("counts", "label", "weight")
    prepared = written(counted)
    rarity = IDF(inputCol="counts", outputCol="features").fit(prepared)
    machine = LogisticRegression(weightCol="weight", maxIter=iterations, regParam=regularization).fit(rarity.transform(prepared))
    model = PipelineModel(stages=[words, counts, rarity, machine])
    return TextRun(model, rows, key, text)


def classify(df: DataFrame, model: PipelineModel, name: str = "model_sentiment") -> DataFrame:
    """Add the sentiment a fitted classifier gives; what it adds on the way is dropped.

    The classifier learned from cleaned texts, so it is asked about cleaned ones; the text itself stays.
    """
    text = model.stages[0].getInputCol()
    scored = model.transform(df.withColumn("_raw", F.col(text)).withColumn(text, clean_text(text)))
    kept = [F.col("_raw").alias(text) if column == text else F.col(column) for column in df.columns]
    return scored.select(*kept, label_name(F.col("prediction").cast("int")).alias(name))


def model_sentiment(text: Column | str, load: Callable[[], Callable[[list[str]], np.ndarray]], strict: bool = False) -> Column:
    """The sentiment an outside model gives, batch by batch.

    ``load`` runs once per task and returns a function from texts to logits of shape
    (rows, 2), negative first. A batch it fails on is NULL, so that the rules answer instead;
    ``strict`` lets the failure through.
    """

    @F.pandas_udf("int")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for texts in batches:
            try:
                logits = np.asarray(predict(texts.fillna("").tolist()))
                yield pd.Series(logits.argmax(axis=1) if len(texts) else [], dtype="Int32")
            except Exception:
                if strict:
                    raise
                yield pd.Series([None] * len(texts), dtype="Int32")

    return label_name(best(as_column(text)))
