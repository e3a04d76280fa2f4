"""Language identification: known words first, then ever shorter character n-grams.

A known word scores with its log frequency in each language. Another word scores with the mean log
frequency of its longest n-grams that are known, from 4 characters down to 1; each step down lessens the
weight. A text gets the language with the largest sum; the score is that language's share of the
posterior over the languages, with equal priors.

A word is a run of letters (Unicode category L) with the marks (category M) that belong to them. The model is fitted
on a bounded sample: about ``SAMPLE_DOCS`` labelled documents a language, chosen by a hash of the id, with all their
words and n-grams that occur twice or more. All texts are scored whole.

Rows: a null text or one without a letter is ``und`` with score 0, and so is any text if no language was
learned. Rows without language are scored like others. A row without id is neither trained on nor held out.
Ties go to the language that sorts first. Repeated rows count as often as they occur. Very long texts are scored in
pieces. An empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import map_batches, written
from voxtally.session import bounded_broadcast

SAMPLE_DOCS = 4000
LONGEST = 4
LESS = 0.4
SMOOTHING = 0.5
#: Numbers that a worker keeps for words it has met.
MEMORY_CELLS = 4_000_000

def _ranges(category: str) -> str:
    """The characters of a Unicode category, as ranges of a pattern."""
    held = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == category]
    cuts = [0, *(i for i in range(1, len(held)) if held[i] != held[i - 1] + 1), len(held)]
    return "".join(f"\\U{held[a]:08x}-\\U{held[b - 1]:08x}" for a, b in zip(cuts, cuts[1:], strict=False))


_ascii = re.compile("[a-z]+")
_letters: list[re.Pattern] = []


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    lower = text.lower()
    if lower.isascii():
        return _ascii.findall(lower)
    if not _letters:
        letters, marks = _ranges("L"), _ranges("M")
        _letters.append(re.compile(f"[{letters}][{letters}{marks}]*"))
    return _letters[0].findall(lower)


def grams_of(word: str, size: int) -> list[str]:
    """The n-grams of a word with its borders; for size 1 its letters."""
    shown = f"^{word}$" if size > 1 else word
    return [shown[i : i + size] for i in range(len(shown) - size + 1)]


def held_out() -> Column:
    """Documents that the contract keeps from training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """Log frequencies: a row of ``table`` a word, then a row an n-gram; a column a language."""

    languages: list[str]
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def vector(self, word: str) -> np.ndarray:
        at = self.words.get(word)
        if at is not None:
            return self.table[at]
        weight = 1.0
        for size in range(LONGEST, 0, -1):
            known = [self.grams[g] for g in grams_of(word, size) if g in self.grams]
            if known:
                return weight * self.table[known].mean(axis=0)
            weight *= LESS
        return np.zeros(len(self.languages))


class Scorer:
    """Scores texts by a model and remembers the words it has met."""

    def __init__(self, model: Model):
        self.model, self.memory = model, {}
        self.room = max(1000, MEMORY_CELLS // max(1, len(model.languages)))
        self.met = np.zeros((self.room, len(model.languages)))

    def score(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.languages:
            return "und", 0.0
        total = np.zeros(len(self.model.languages))
        for start in range(0, len(words), self.room // 2):
            part = words[start : start + self.room // 2]
            total += self.met[self.places(part)].sum(axis=0)
        share = np.exp(total - total.max())
        best = int(share.argmax())
        return self.model.languages[best], float(share[best] / share.sum())

    def places(self, words: list[str]) -> list[int]:
        if len(self.memory) + len(words) > self.room:
            self.memory.clear()
        memory, out = self.memory, []
        for word in words:
            at = memory.get(word)
            if at is None:
                at = memory[word] = len(memory)
                self.met[at] = self.model.vector(word)
            out.append(at)
        return out


_scorers: dict[str, Scorer] = {}


def scorer(name: str, load: Callable[[], Model]) -> Scorer:
    """The scorer of the model of that name. One of another model goes before the model is loaded, so that a worker
    never holds two."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(load())
    return _scorers[name]


def _count(batches: Iterator[pa.RecordBatch], items) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, item) a batch; ``items`` lists a row's items and how often they count."""
    _scorers.clear()  # a new model is on its way
    for batch in batches:
        counts: Counter = Counter()
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            for item, n in items(*row[1:]):
                counts[row[0], item] += n
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in counts], pa.string()),
                pa.array([x[1] for x in counts], pa.string()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["lang", "item", "n"],
        )


def _words(batches):
    return _count(batches, lambda text: Counter(words_of(text)).items())


def _grams(batches):
    return _count(batches, lambda word, n: ((g, n) for size in range(1, LONGEST + 1) for g in grams_of(word, size)))


def _frequent(counts: DataFrame) -> list:
    """(item, {lang: n}) of the items of the sample that occur twice or more, the most frequent first."""
    listed = counts.groupBy("item").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang")
    )
    found = listed.filter("total > 1").select("item", "by_lang", "total").collect()
    return sorted(found, key=lambda r: (-r.total, r.item))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on the labelled rows of ``docs`` (doc_id, text, lang) that are not held out."""
    labelled = docs.filter(
        F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    sizes = bounded_broadcast(labelled.groupBy("lang").agg(F.count("*").alias("docs")))
    chosen = labelled.join(sizes, "lang").filter(
        F.expr(f"pmod(xxhash64(doc_id), 1000003) * docs < {sample_docs * 1000003}L")
    )
    words = written(
        map_batches(chosen.select("lang", "text"), _words, "lang string, item string, n long")
        .groupBy("lang", "item")
        .agg(F.sum("n").alias("n"))
    )
    grams = map_batches(words.select("lang", "item", "n"), _grams, "lang string, item string, n long")
    grams = grams.groupBy("lang", "item").agg(F.sum("n").alias("n"))
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    model = Model(sorted(totals))
    if not totals:
        return model
    place = {lang: i for i, lang in enumerate(model.languages)}
    size = np.array([totals[lang] for lang in model.languages], float)

    def rows(found: list, per_word: float) -> np.ndarray:
        counts = np.zeros((len(found), len(place)))
        for i, row in enumerate(found):
            for lang, n in row.by_lang.items():
                counts[i, place[lang]] = n
        return np.log((counts + SMOOTHING) / (per_word * size + SMOOTHING * (len(found) + 1)))

    kept_words, kept_grams = _frequent(words), _frequent(grams)
    model.words = {row.item: i for i, row in enumerate(kept_words)}
    model.grams = {row.item: len(kept_words) + i for i, row in enumerate(kept_grams)}
    model.table = np.concatenate([rows(kept_words, 1.0), rows(kept_grams, 4.0)])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), model.name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = scorer(name, lambda: shared.value)
        for batch in batches:
            found = [tool.score(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents' own labels and predict all of them."""
    return predict(docs, fit(docs))
