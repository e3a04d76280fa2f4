"""The bilingual sentiment lexicon."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# ---- Fixed values: word lists and phrase patterns of the rule scorer -------------------------

MALAY_POSITIVE = (
    "baik", "bagus", "senang", "puas", "mantap", "hebat", "luar biasa",
    "terbaik", "bagus sekali", "sangat baik", "memuaskan", "keren",
    "wow", "oke", "ok", "yes", "ya", "sukses", "berhasil", "happy",
    "gembira", "bahagia", "positif", "membantu", "bermanfaat",
    "terima kasih", "thanks", "thank you", "suka", "menyenangkan",
)
MALAY_NEGATIVE = (
    "buruk", "jelek", "tidak baik", "tidak bagus", "kecewa", "sedih",
    "mengecewakan", "parah", "jelek sekali", "sangat buruk", "gagal",
    "tidak suka", "tidak senang", "marah", "kesal", "frustasi",
    "negatif", "susah", "sulit", "problematik", "masalah", "rusak",
    "error", "gagal", "payah", "lemah", "tidak puas",
)
ENGLISH_POSITIVE = (
    "good", "great", "excellent", "amazing", "wonderful", "fantastic",
    "awesome", "perfect", "happy", "satisfied", "pleased", "love",
    "like", "best", "positive", "helpful", "useful", "successful",
    "brilliant", "outstanding", "superb", "terrific", "nice", "fine",
)
ENGLISH_NEGATIVE = (
    "bad", "poor", "terrible", "awful", "horrible", "disappointed",
    "sad", "angry", "upset", "frustrated", "hate", "dislike",
    "worst", "negative", "problem", "issue", "difficult", "hard",
    "complicated", "wrong", "failed", "failure", "unhappy",
)
POSITIVE_PATTERNS = (
    r"sangat\s+(baik|bagus|puas|senang|mantap)",
    r"(baik|bagus|keren|hebat)\s+sekali",
    r"aku\s+(suka|senang|bahagia|gembira)",
    r"saya\s+(suka|senang|bahagia|gembira)",
    r"terima\s+kasih",
    r"thank\s+you",
    r"makasih",
)
NEGATIVE_PATTERNS = (
    r"tidak\s+(baik|bagus|senang|suka|puas|mau|ingin)",
    r"sangat\s+(buruk|jelek|kecewa|sedih|parah)",
    r"(buruk|jelek|parah)\s+sekali",
    r"aku\s+(tidak|kecewa|sedih|marah|kesal)",
    r"saya\s+(tidak|kecewa|sedih|marah|kesal)",
    r"masalah\s+(besar|serius)",
    r"gagal\s+total",
)
PATTERN_WEIGHT = 2

# ---- end of fixed values ---------------------------------------------------------------------

_SIMPLE_PATTERN = re.compile(r"(\w+|\([\w|]+\))(\\s\+(\w+|\([\w|]+\)))*", re.ASCII)


@dataclass(frozen=True)
class Lexicon:
    """Weighted terms and phrase patterns of both polarities.

    Terms and patterns become literals of the scoring expression, which suits lists up to
    about a thousand terms. A term listed twice weighs double.
    """

    positive: tuple[str, ...]
    negative: tuple[str, ...]
    positive_patterns: tuple[str, ...] = ()
    negative_patterns: tuple[str, ...] = ()
    pattern_weight: int = PATTERN_WEIGHT

    def weights(self, polarity: str) -> dict[str, int]:
        return dict(Counter(self.positive if polarity == "positive" else self.negative))

    def patterns(self, polarity: str) -> tuple[str, ...]:
        return self.positive_patterns if polarity == "positive" else self.negative_patterns

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """``term, polarity, weight, kind``: one row per distinct term and per pattern."""
        rows = []
        for polarity in ("positive", "negative"):
            rows += [(term, polarity, n, "term") for term, n in self.weights(polarity).items()]
            rows += [(p, polarity, self.pattern_weight, "pattern") for p in self.patterns(polarity)]
        return spark.createDataFrame(rows, "term string, polarity string, weight int, kind string")


DEFAULT_LEXICON = Lexicon(
    positive=MALAY_POSITIVE + ENGLISH_POSITIVE,
    negative=MALAY_NEGATIVE + ENGLISH_NEGATIVE,
    positive_patterns=POSITIVE_PATTERNS,
    negative_patterns=NEGATIVE_PATTERNS,
)


def required_words(pattern: str) -> list[str]:
    r"""Words every match of the pattern holds, for a cheap substring test before the regex.

    Known only for words and ``(a|b)`` groups joined by ``\s+``; any other pattern gives none.
    """
    if not _SIMPLE_PATTERN.fullmatch(pattern):
        return []
    return [part for part in pattern.split(r"\s+") if not part.startswith("(")]
