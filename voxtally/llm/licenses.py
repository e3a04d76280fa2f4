"""Licence scans: a trained paragraph classifier, confirmed against templates.

Lines are looked at one by one, for short notices, and paragraphs as a whole, for notices wrapped over several
lines. A paragraph is a run of lines with words between lines without any (a bare comment sign is none), joined.
What has more than 120 words is read in windows of 120 words, a half apart. A sparse logistic regression over its words and word pairs gives the probability of each licence family and of the
class ``unknown``. It is trained on variants of the families' templates (parts of them, among other words)
against a bounded sample of lines and paragraphs of the corpus and templates with their words shuffled. The probability
a family must reach is calibrated on negatives kept aside, so that one in a thousand of those passes. A
prediction is confirmed when the window holds most word pairs of one of the family's templates. The words of a
confirmed family are then taken out of a paragraph's window and the rest is looked at again, so notices that
follow each other without an empty line are all found. A family that one of a paragraph's lines confirms is not
counted again for the paragraph, and a line whose family the paragraph confirms is not an unconfirmed one.
Windows of paragraphs that hold too few word pairs of each template to be confirmed are not predicted.

Rows: a null or empty text has no paragraph. Repeated rows get equal results. Texts are read whole, very long ones window
by window. Of families with equal probability the first by name is the surest one. An empty table teaches the templates
alone and gives no rows.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.common import map_batches
from voxtally.llm.license_templates import TEMPLATES

UNKNOWN = "unknown"
#: Documents, about, and lines and paragraphs at most that negatives are drawn from.
SAMPLE_DOCS = 1500
#: Longer lines and paragraphs are no negative examples, so that what the driver sees is bounded.
UNIT_CHARS = 4_000
NEGATIVES = 4000
COMMON_WORDS = 2000
VARIANTS = 60
PARAGRAPH_WORDS = 120
CONFIRMED = 0.6
FALSE_ALARMS = 0.001
LEAST_CHANCE = 0.5
SEED = 11

_word = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def windows(words: list[str]) -> Iterator[list[str]]:
    if len(words) <= PARAGRAPH_WORDS:
        if words:
            yield words
        return
    for start in range(0, len(words) - PARAGRAPH_WORDS // 2, PARAGRAPH_WORDS // 2):
        yield words[start : start + PARAGRAPH_WORDS]


def paragraphs(text: str | None) -> Iterator[list[list[str]]]:
    """The words of each line, by paragraph."""
    run = []
    for line in (text or "").split("\n"):
        if words := words_of(line):
            run.append(words)
        elif run:
            yield run
            run = []
    if run:
        yield run


def pairs_of(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


_template_pairs = {
    family: [pairs_of(words_of(text)) for text in texts] for family, texts in TEMPLATES.items()
}
_holders: dict[tuple[str, str], list[int]] = {}
_enough: list[float] = []
for _pairs in (pairs for listed in _template_pairs.values() for pairs in listed):
    for _pair in _pairs:
        _holders.setdefault(_pair, []).append(len(_enough))
    _enough.append(CONFIRMED * len(_pairs))


def may_agree(words: list[str]) -> bool:
    """Whether the words hold most word pairs of any template."""
    held = Counter(k for pair in _holders.keys() & pairs_of(words) for k in _holders[pair])
    return any(n >= _enough[k] for k, n in held.items())


def without_family(words: list[str], family: str) -> list[str]:
    """The words with gaps where they are pairs of the family's templates."""
    known, out = set().union(*_template_pairs[family]), list(words)
    for i, pair in enumerate(zip(words, words[1:], strict=False)):
        if pair in known:
            out[i] = out[i + 1] = ""
    return out


def agreement(words: list[str], family: str) -> float:
    """The largest share of a template's word pairs that a paragraph holds."""
    held = pairs_of(words)
    return max(len(pairs & held) / len(pairs) for pairs in _template_pairs[family])


@dataclass
class Model:
    families: list[str]
    place: dict
    weights: np.ndarray
    offsets: np.ndarray
    threshold: float

    def chances(self, words: list[str]) -> np.ndarray:
        found = [self.place[x] for x in self.place.keys() & (set(words) | pairs_of(words))]
        odds = self.offsets + self.weights[found].sum(axis=0)
        chance = np.exp(odds - odds.max())
        return chance / chance.sum()

    def predict(self, words: list[str]) -> tuple[str, float]:
        """The family, or ``unknown`` below the calibrated threshold, and its probability."""
        chances = self.chances(words)
        best = int(chances.argmax())
        if self.families[best] == UNKNOWN or chances[best] < self.threshold:
            return UNKNOWN, float(chances[self.families.index(UNKNOWN)])
        return self.families[best], float(chances[best])


def _variant(rng: random.Random, words: list[str], filler: list[str]) -> list[str]:
    """A template or most of it, alone or among other words."""
    size = max(min(4, len(words)), round(len(words) * rng.uniform(0.7, 1)))
    start = rng.randint(0, len(words) - size)
    around = [rng.choice(filler) for _ in range(rng.choice((0, 0, 5, 20)))] if filler else []
    cut = rng.randint(0, len(around))
    return around[:cut] + words[start : start + size] + around[cut:]


def _negative_rows(docs: DataFrame) -> list[list[str]]:
    """A bounded sample of the corpus's lines and paragraphs that are like no template."""
    n = docs.count()
    share = F.expr("pmod(xxhash64(doc_id, 23), 1000003)") < int(1000003 * min(1.0, SAMPLE_DOCS / max(n, 1)))
    text = F.col("text").cast("string")
    units = F.array_union(F.split(text, "\n"), F.split(text, r"\n\s*\n"))
    lines = docs.filter(share).select(F.explode(units).alias("line")).filter(F.length("line") <= UNIT_CHARS)
    chosen = lines.filter("trim(line) <> ''").orderBy(F.xxhash64("line"), "line").limit(NEGATIVES).collect()
    rows = [words for row in chosen for words in windows(words_of(row.line))]
    return [w for w in rows if all(agreement(w, family) < CONFIRMED / 2 for family in TEMPLATES)]


def fit(spark: SparkSession, docs: DataFrame) -> Model:
    """Train on the templates and a sample of ``docs`` (doc_id, text)."""
    rng, negatives = random.Random(SEED), _negative_rows(docs)
    common = Counter(w for words in negatives for w in words)
    filler = [w for words in negatives for w in words][:50_000]
    families = [*sorted(TEMPLATES), UNKNOWN]
    rows: list[tuple[list[str], int]] = []
    for family, texts in TEMPLATES.items():
        for words in map(words_of, texts):
            rows += [(_variant(rng, words, filler), families.index(family)) for _ in range(VARIANTS)]
            shuffled = [rng.sample(words, len(words)) for _ in range(VARIANTS // 4)]
            negatives += [w for w in shuffled if agreement(w, family) < CONFIRMED / 2]
    rng.shuffle(negatives)
    aside, used = negatives[: len(negatives) // 4], negatives[len(negatives) // 4 :]
    rows += [(words, len(families) - 1) for words in used]
    listed = sorted({x for texts in TEMPLATES.values() for t in map(words_of, texts) for x in set(t) | pairs_of(t)}, key=str)
    frequent = sorted(common, key=lambda w: (-common[w], w))[:COMMON_WORDS]
    place = {x: i for i, x in enumerate(dict.fromkeys([*listed, *frequent]))}
    vectors = []
    for words, label in rows:
        found = sorted(place[x] for x in place.keys() & (set(words) | pairs_of(words)))
        vectors.append((float(label), Vectors.sparse(len(place), found, [1.0] * len(found))))
    training = spark.createDataFrame(vectors, ["label", "features"]).coalesce(4)
    fitted = LogisticRegression(
        family="multinomial", regParam=0.0005, elasticNetParam=0.5, maxIter=40, standardization=False
    ).fit(training)
    model = Model(families, place, fitted.coefficientMatrix.toArray().T, fitted.interceptVector.toArray(), 0.0)
    alarms = sorted(1 - model.chances(words)[-1] for words in aside)
    allowed = alarms[min(len(alarms) - 1, int(len(alarms) * (1 - FALSE_ALARMS)))] if alarms else 0.0
    model.threshold = max(LEAST_CHANCE, min(0.99, allowed))
    used_features = np.flatnonzero(np.abs(model.weights).sum(axis=1))
    names = list(place)
    model.place = {names[i]: k for k, i in enumerate(used_features)}
    model.weights = model.weights[used_features]
    return model


COLUMNS = (
    "licenses array<string>, license string, probability double, n_confirmed long, n_unconfirmed long, n_paragraphs long"
)


def scan_text(model: Model, text: str | None) -> tuple:
    """The confirmed families, the surest one and its probability, and counts of lines and paragraphs."""
    confirmed: Counter = Counter()
    best, unconfirmed, total = {}, 0, 0
    for lines in paragraphs(text):
        here, open_ = set(), []
        for words in (w for line in lines for w in windows(line)):
            total += 1
            family, chance = model.predict(words)
            if family == UNKNOWN:
                continue
            if agreement(words, family) >= CONFIRMED:
                here.add(family)
                confirmed[family] += 1
                best[family] = max(chance, best.get(family, 0.0))
            else:
                open_.append(family)
        whole = set()
        for words in windows([w for line in lines for w in line]) if len(lines) > 1 else ():
            total += 1
            while may_agree(words):
                family, chance = model.predict(words)
                if family == UNKNOWN or agreement(words, family) < CONFIRMED:
                    break
                if family not in here | whole:
                    confirmed[family] += 1
                    best[family] = max(chance, best.get(family, 0.0))
                whole.add(family)
                words = without_family(words, family)
        unconfirmed += sum(family not in whole for family in open_)
    surest = min(best, key=lambda f: (-best[f], f)) if best else None
    return sorted(confirmed), surest, best.get(surest), sum(confirmed.values()), unconfirmed, total


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, licenses, license, probability, counts of lines and paragraphs.

    ``license`` is the family found with the highest probability, null if none was confirmed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    kinds = [pa.list_(pa.string()), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(shared.value, text) for text in batch.column(1).to_pylist()]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, run, f"doc_id long, {COLUMNS}")
