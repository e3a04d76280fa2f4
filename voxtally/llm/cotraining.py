"""Quality classifier by co-training: a view of the text and a view of the page's metadata.

Both views are logistic regressions. In each round a view scores all unlabelled documents, labels those that it is
sure of, and the other view learns from them. Each view is then calibrated on labelled documents kept
aside, and the calibrated views are combined as independent evidence: their log odds add up, less the
prior's. The text view has figures of the text and shares of character-class trigrams; the metadata view hashes
source, language and size class.

Only the labelled documents are sampled, by a hash of the id: about ``LABELLED`` of them. Each class of labels has half
of ``LABELLED``, and what the other class leaves of its half; a class below its bound takes part whole. The log
odds of a view are corrected by what the classes' shares in the sample differ from those of all labels. A
quarter of each class is kept aside; if that is fewer than ``LEAST`` rows of a class, the views' odds are used
without calibration. The pool is every document without a label. All of it above ``SURE`` is handed over; where that
is more than the sample has of a class, each row weighs less, so that together they weigh as much as the labelled
rows of the class. The figures of all documents are written once; rounds and fits read them in a task for each
``FIT_ROWS`` rows. All documents are scored, on their whole texts.

Rows: a null text counts as an empty one, and very long ones are read whole, in time that grows with their length;
missing metadata is left out of the view. Repeated rows take part, and are scored, as often as they occur. Ids with
labels that disagree take the more frequent one, a tie counts as good. If one of the two classes has fewer than
``LEAST`` labelled documents in all, nothing can be learned: every score is the share of good labels (1 without
labels) and all rows are kept. Scores of exactly ``THRESHOLD`` are kept. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import ship, small_batches, written
from voxtally.session import bounded_broadcast

LABELLED = 12_000
ROUNDS = 3
SURE = 0.95
LEAST = 10
THRESHOLD = 0.5
TRIGRAMS = 40
META_FEATURES = 512
FIT_STEPS = 25
#: Rows of a task of a fit: a step over few rows is one short task.
FIT_ROWS = 25_000
REGULARIZATION = 0.001
#: Log odds of a view are held within this bound.
MOST_ODDS = 8.0

_upper, _lower, _same = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]"), re.compile(r"([Aa0])\1+")
#: Classes of the characters up to U+024F, taken from the patterns; later letters are left to the pattern.
_classes = {c: _lower.sub("a", _upper.sub("A", chr(c))) for c in range(0x250)}
_classes |= {c: "0" for c in range(48, 58)} | {10: "a", 9: " "}


def content_features(text: str | None) -> list[float]:
    """Figures of a text, then the shares of its hashed character-class trigrams."""
    text = text or ""
    words = text.split()
    n, counts = max(1, len(words)), Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    letters = sum(map(str.isalpha, text)) or 1
    figures = [
        math.log1p(len(words)),
        math.log1p(len(lines)),
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isupper, text)) / letters,
        sum(map(text.count, "#*$%&|<>")) / n,
        sum(map(text.count, ".!?")) / n,
        text.count("!") / n,
        text.count(",") / n,
        sum(map(text.count, "0123456789")) / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        sum(len(w) > 20 for w in words) / n,
        sum(line.rstrip()[-1] in ".!?" for line in lines) / max(1, len(lines)),
    ]
    shape = text.translate(_classes)
    shape = _same.sub(r"\1", shape if shape.isascii() else _lower.sub("a", shape))
    buckets, total = [0.0] * TRIGRAMS, max(1, len(shape) - 2)
    for gram, count in Counter(zip(shape, shape[1:], shape[2:], strict=False)).items():
        code = 0
        for char in gram:
            code = (code * 8191 + ord(char)) % 1_000_003
        buckets[code % TRIGRAMS] += count / total
    return figures + buckets


def content_column(text: Column, df: DataFrame) -> Column:
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(content_features)

    return features(text)


def meta_columns(df: DataFrame) -> list[Column]:
    """Source, language, size class and their pairs, as text; absent columns are null."""
    of = lambda name: F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
    size = F.floor(F.log2(F.coalesce(F.col("n_chars").cast("double") if "n_chars" in df.columns else F.lit(None), F.lit(0.0)) + 1))
    return [
        of("source").alias("m_source"),
        of("lang").alias("m_lang"),
        size.cast("string").alias("m_size"),
        F.concat_ws("/", of("source"), of("lang")).alias("m_both"),
    ]


COLUMNS = ("doc_id", "text", "source", "lang", "n_chars")
META = ["m_source", "m_lang", "m_size", "m_both"]


@dataclass
class Model:
    """The two views with their calibrations (slope, offset), and the log odds of the prior.

    ``shift`` is the prior's log odds less the sample's.
    """

    prior: float
    content: LogisticRegressionModel | None = None
    meta: LogisticRegressionModel | None = None
    content_fit: tuple[float, float] = (1.0, 0.0)
    meta_fit: tuple[float, float] = (1.0, 0.0)
    shift: float = 0.0


def _views(df: DataFrame) -> DataFrame:
    """Add the vectors of both views to rows with content and META columns."""
    hasher = FeatureHasher(inputCols=META, outputCol="meta", numFeatures=META_FEATURES)
    return hasher.transform(df.withColumn("view", array_to_vector("content")))


def _odds(df: DataFrame, model: LogisticRegressionModel, view: str, name: str, shift: float) -> DataFrame:
    """Add a view's log odds, as the sample has them; the bound leaves room for the shift."""
    most = MOST_ODDS + abs(shift)
    model = model.copy({model.featuresCol: view, model.predictionCol: "", model.probabilityCol: "", model.rawPredictionCol: "_raw"})
    bounded = F.greatest(F.lit(-most), F.least(F.lit(most), vector_to_array("_raw")[1]))
    return model.transform(df).withColumn(name, bounded).drop("_raw")


def _fit(rows: DataFrame, view: str) -> LogisticRegressionModel:
    regression = LogisticRegression(
        featuresCol=view, labelCol="label", weightCol="weight", regParam=REGULARIZATION, maxIter=FIT_STEPS
    )
    return regression.fit(rows.select(view, "label", "weight"))


def _sample(column: str, share: float) -> Column:
    return F.expr(f"pmod(xxhash64({column}, 71), 1000003)") < int(1000003 * min(1.0, share))


def _order(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def sampled(n_good: float, n_bad: float) -> Column:
    """Whether a labelled id is in the sample, which has all rows of a class that is below its bound."""
    half = LABELLED / 2
    shares = [max(half, LABELLED - other) / n for n, other in ((n_good, n_bad), (n_bad, n_good))]
    return F.when(F.col("label") == 1, _sample("doc_id", shares[0])).otherwise(_sample("doc_id", shares[1]))


def labelled_ids(labels: DataFrame) -> DataFrame:
    return (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    )


def figures(docs: DataFrame) -> DataFrame:
    """What both views see of each row of ``docs``: doc_id, content and the META columns, written once."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    rows = docs.select(*columns, *meta_columns(docs))
    return written(rows.select("doc_id", *META, content_column(F.col("text"), rows).alias("content")))


def fit(docs: DataFrame, labels: DataFrame, seen: DataFrame | None = None) -> Model:
    """Co-train on ``docs`` (doc_id, text, source, lang, n_chars) and ``labels`` (doc_id, quality).

    ``seen`` are the documents' figures, if they are at hand.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    known = written(labelled_ids(labels).join(ids, "doc_id", "left_semi"))
    n_known, n_good = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    share = n_good / n_known if n_known else 1.0
    prior = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    n_bad = n_known - n_good
    if min(n_good, n_bad) < LEAST:
        return Model(prior)
    chosen = bounded_broadcast(known.filter(sampled(n_good, n_bad)))
    seen = (figures(docs) if seen is None else seen).filter("doc_id is not null")
    labelled = seen.join(chosen, "doc_id")
    pooled = seen.join(known.select("doc_id"), "doc_id", "left_anti")
    rows = written(labelled.unionByName(pooled.withColumn("label", F.lit(None).cast("double"))))
    parts = -(-rows.count() // FIT_ROWS)
    rows = _views(rows.coalesce(max(1, parts))).select("doc_id", "label", "view", "meta", F.lit(1.0).alias("weight"))
    own = rows.filter("label is not null").select("doc_id", "label").distinct().collect()
    of_class = [sorted((r.doc_id for r in own if r.label == label), key=_order) for label in (0.0, 1.0)]
    held = [doc_id for listed in of_class for doc_id in listed[::4]]
    shift = math.log(n_good / n_bad) - math.log(len(of_class[1]) / len(of_class[0]))
    aside = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in held], "doc_id long"))
    known_rows = rows.filter("label is not null")
    train, kept_aside = known_rows.join(aside, "doc_id", "left_anti"), known_rows.join(aside, "doc_id", "left_semi")
    pool = rows.filter("label is null").drop("label", "weight")
    of_train = [len(listed) - len(listed[::4]) for listed in of_class]
    for_content = for_meta = None
    for left in range(ROUNDS, -1, -1):
        content = _fit(train if for_content is None else train.unionByName(for_content), "view")
        meta = _fit(train if for_meta is None else train.unionByName(for_meta), "meta")
        if left:
            for_meta = _sure(_odds(pool, content, "view", "odds", shift), of_train, shift)
            for_content = _sure(_odds(pool, meta, "meta", "odds", shift), of_train, shift)
    fits = []
    for model, view in ((content, "view"), (meta, "meta")):
        if min(len(listed[::4]) for listed in of_class) < LEAST:
            fits.append((1.0, 0.0))
            continue
        one = _odds(kept_aside, model, view, "odds", shift).select("label", array_to_vector(F.array("odds")).alias("one"))
        platt = LogisticRegression(featuresCol="one", labelCol="label", maxIter=FIT_STEPS).fit(one)
        fits.append((float(platt.coefficients[0]), float(platt.intercept)))
    return Model(prior, content, meta, *fits, shift)


def _sure(scored: DataFrame, of_train: list[int], shift: float) -> DataFrame:
    """All of the pool's rows that a view is sure of; those of a class weigh no more than its labelled rows (bad, good)."""
    bound = math.log(SURE / (1 - SURE))
    odds = F.col("odds") + shift
    sure = scored.withColumn("label", F.when(odds >= bound, 1.0).when(odds <= -bound, 0.0)).filter("label is not null")
    n_bad, n_good = sure.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    shares = [min(1.0, own / max(1, n)) for own, n in zip(of_train, (n_bad, n_good), strict=True)]
    weight = F.when(F.col("label") == 0, shares[0]).otherwise(shares[1])
    return sure.select("doc_id", "label", "view", "meta", weight.alias("weight"))


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """All rows of ``docs`` in ``_row``, with content_score, meta_score and score (the probability of good quality)."""
    share = 1 / (1 + math.exp(-model.prior))
    if model.content is None:
        row = F.struct(*docs.columns).alias("_row")
        return docs.select(row, *(F.lit(share).alias(name) for name in ("content_score", "meta_score", "score")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*docs.columns).alias("_row")
    return _combined(docs.select(row, *meta_columns(docs), content_column(text, docs).alias("content")), model)


def _combined(rows: DataFrame, model: Model) -> DataFrame:
    """The scores of rows with content and META columns, with their ``_row``."""
    rows = _odds(_views(rows), model.content, "view", "content_odds", model.shift)
    rows = _odds(rows, model.meta, "meta", "meta_odds", model.shift)
    odds = {
        name: F.col(f"{name}_odds") * slope + offset + model.shift
        for name, (slope, offset) in (("content", model.content_fit), ("meta", model.meta_fit))
    }
    chance = lambda x: 1 / (1 + F.exp(-x))
    return rows.select(
        "_row",
        chance(odds["content"]).alias("content_score"),
        chance(odds["meta"]).alias("meta_score"),
        chance(odds["content"] + odds["meta"] - model.prior).alias("score"),
    )


def classify(docs: DataFrame, model: Model, seen: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, content_score, meta_score, score, kept. ``seen`` as in :func:`fit`."""
    columns = [name for name in COLUMNS if name in docs.columns]
    kept = F.lit(True) if model.content is None else F.col("score") >= THRESHOLD
    if seen is None or model.content is None:
        scored = with_scores(docs.select(*columns), model)
    else:
        scored = _combined(seen.select(F.struct("doc_id").alias("_row"), *META, "content"), model)
    return scored.select(
        F.col("_row.doc_id").cast("long").alias("doc_id"), "content_score", "meta_score", "score", kept.alias("kept")
    )


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model keeps, all columns unchanged."""
    if model.content is None:
        return docs
    return with_scores(docs, model).filter(F.col("score") >= THRESHOLD).select("_row.*")
