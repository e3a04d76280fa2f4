"""Quality rules, line first: bad lines go, then documents that lost too much text.

Words are runs without ASCII white space. A line with a word fails when

* punctuation: none of its words ends in a sentence mark of any script (closing quotes and brackets aside), unless
  most of its letters are of a script without such marks, or it has more symbol characters than words;
  marks that belong to letters (Unicode category M) and joiners are no symbols, nor are sentence marks and commas
  of other scripts;
* navigation: it has three or more menu separators, or only words of menus;
* boilerplate: it holds a stock phrase of page frames, or equals an earlier line of its document.

A document is rejected when it fails the base rules (fewer than 20 words, or more than 30 % of its words in
eight-word windows that occur twice or more), or when its failed lines hold over half of its word
characters. The kept lines are the cleaned text.

Rows: a null text has no words and is rejected, as an empty one is. Repeated rows get equal verdicts.
A long text is read once, its windows are numbered exactly, by doubling, without hashes. An empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import map_batches

MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED = 30
MAX_LOST = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
SEPARATORS = "|»›•·>"
MENU_WORDS = frozenset(
    "home about contact login logout register search menu sitemap next previous back top share print "
    "help faq news blog archive products services careers".split()
)
STOCK_PHRASES = (
    "all rights reserved", "click here", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "javascript is disabled", "sign up for our newsletter", "subscribe to our", "read more",
    "share this", "skip to content", "back to top", "powered by", "lorem ipsum",
)
_stock = re.compile("|".join(map(re.escape, STOCK_PHRASES)))
#: Full stops, question and exclamation marks of scripts that have their own.
SENTENCE_MARKS = ";՜՞։؟۔܀܁܂߹।॥།༎༏༐༑၊။።፧፨᙮᠃᠉។៕᥄᥅᪨᪩᭞᭟᰻᰼᱾᱿‼⁇⁈⁉⳹⳺⳻⳾⸮꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꯫．｡︒︕︖﹒﹖﹗𑁇𑁈𑃀𑃁𑅁𑅂𑅃𑇅𑇆𑈸𑈹𑑋𑑌𑗂𑗃𑙁𑙂"
#: Commas, syllable and word separators, quotes and brackets of other scripts; they end no sentence.
OTHER_COMMAS = "՝،؛٬፡፣፤፥፦་༌、，；：「」『』《》〈〉【】（）"
#: Letters of Thai, Lao and Tai scripts, which part sentences by spaces.
UNMARKED = "\u0e01-\u0e30\u0e32\u0e33\u0e40-\u0e46\u0e81-\u0eb0\u0eb2\u0eb3\u0ebd-\u0edf\u1950-\u1974\u1980-\u19c9\uaa80-\uaadd"
_sentence_end = re.compile(rf"""[.!?…:;。！？{SENTENCE_MARKS}]["'”’»)\]}}]*([ \t-\r]|$)""")
_symbol = re.compile(r"[^\w\s.,;:'’\-()\"]")
_unmarked = re.compile(f"[{UNMARKED}]")
_edges = re.compile(r"^\W+|\W+$")
_no_symbols = frozenset(SENTENCE_MARKS + OTHER_COMMAS + "\u200c\u200d")


def has_no_sentence_mark(line: str) -> bool:
    if _sentence_end.search(line):
        return False
    return line.isascii() or 2 * len(_unmarked.findall(line)) <= sum(map(str.isalpha, line))


def n_symbols_of(line: str) -> int:
    found = _symbol.findall(line)
    if line.isascii():
        return len(found)
    return sum(c.isascii() or c not in _no_symbols and unicodedata.category(c)[0] != "M" for c in found)


def failed_rule(line: str, words: int) -> str | None:
    """The rule that a line with words fails, ``None`` if it passes."""
    if has_no_sentence_mark(line) or n_symbols_of(line) > words:
        return "punctuation"
    if sum(map(line.count, SEPARATORS)) >= 3:
        return "navigation"
    lower = line.lower()
    if words <= 12 and all((bare := _edges.sub("", w)) in MENU_WORDS or not bare for w in lower.split()):
        return "navigation"
    return "boilerplate" if _stock.search(lower) else None


def repeated_words(words: list[list[bytes]]) -> list[int]:
    """For each document, the words in windows of its text that it has twice or more."""
    sizes = np.array([len(x) for x in words])
    total = int(sizes.sum())
    if total < WINDOW:
        return [0] * len(words)
    owner = np.repeat(np.arange(len(words)), sizes)
    number = pd.factorize(np.array([w for x in words for w in x], object))[0].astype(np.int64)
    width = 1
    while width < WINDOW:
        count = len(number) - width
        number = pd.factorize(number[:count] * (int(number.max()) + 1) + number[width:])[0].astype(np.int64)
        width *= 2
    inside = owner[: len(number)] == owner[WINDOW - 1 :]
    here = np.flatnonzero(inside)
    seen, counts = pd.factorize(owner[here] * (int(number.max(initial=0)) + 1) + number[here])[0], None
    counts = np.bincount(seen) if len(seen) else np.zeros(0, np.int64)
    starts = here[counts[seen] > 1] if len(seen) else here
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(words)).tolist()


def judge(texts: list[str | None], keep_text: bool = False) -> list[dict]:
    """The figures and verdict of each text."""
    texts = [x or "" for x in texts]
    words = [x.encode().split() for x in texts]
    out = []
    for text, found, repeated in zip(texts, words, repeated_words(words), strict=True):
        n = len(found)
        word_chars = len(text) - sum(map(text.count, SPACES))
        seen, duplicates, lost, failed, clean = set(), 0, 0, 0, []
        for line in text.split("\n"):
            size = len(line.encode().split())
            if not size:
                clean.append(line)
                continue
            again = line in seen
            duplicates += again
            seen.add(line)
            if again or failed_rule(line, size):
                failed += 1
                lost += len(line) - sum(map(line.count, SPACES))
            else:
                clean.append(line)
        base_failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
        out.append(
            {
                "n_words": n,
                "word_chars": word_chars,
                "n_symbols": sum(map(text.count, SYMBOLS)),
                "n_dup_lines": duplicates,
                "n_repeat_words": repeated,
                "base_failed": base_failed,
                "kept": not base_failed and 100 * lost <= MAX_LOST * word_chars,
                "n_failed_lines": failed,
                "lost_chars": lost,
            }
        )
        if keep_text:
            out[-1]["clean_text"] = "\n".join(clean)
    return out


FIGURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_failed_lines long, lost_chars long"
)


def apply_rules(docs: DataFrame, clean_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, the figures, base_failed, kept; the cleaned text if asked for."""
    names = [x.split()[0] for x in FIGURES.split(", ")] + ["clean_text"] * clean_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge(batch.column(1).to_pylist(), clean_text)
            columns = [pa.array([x[name] for x in found]) for name in names]
            if not found:
                continue
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, run, f"doc_id long, {FIGURES}" + ", clean_text string" * clean_text)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their cleaned texts.

    ``n_chars``, if there, counts the characters of the cleaned text. All else is unchanged.
    """
    place = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge(batch.column(place).cast(pa.string()).to_pylist(), keep_text=True)
            columns, clean = list(batch.columns), [x["clean_text"] for x in found]
            columns[place] = pa.array(clean, pa.string()).cast(columns[place].type)
            if counted is not None:
                old = columns[counted]
                sizes = [len(x) if row["n_failed_lines"] else n for x, row, n in zip(clean, found, old.to_pylist(), strict=True)]
                columns[counted] = pa.array(sizes).cast(old.type)
            cleaned = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield cleaned.filter(pa.array([x["kept"] for x in found], pa.bool_()))

    return map_batches(docs, run, docs.schema)
