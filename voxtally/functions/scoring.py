"""Rule scoring of texts in native columns: no Python in the row path, usable on streams too."""

from __future__ import annotations

import re
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.columns import as_column
from voxtally.functions.labels import NEGATIVE, POSITIVE
from voxtally.functions.lexicon import DEFAULT_LEXICON, Lexicon, required_words
from voxtally.functions.text import BLANK, WORD, tokens

POLARITIES = ("positive", "negative")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _single(terms) -> list[str]:
    return sorted(t for t in terms if re.fullmatch(r"\w+", t))


def _has_phrase(text: Column, phrase: str) -> Column:
    """The phrase on word boundaries; the substring test keeps the regex off most rows."""
    bounded = f"(^|[^{WORD}]){re.escape(phrase)}($|[^{WORD}])"
    return text.contains(phrase) & text.rlike(bounded)


def _has_pattern(text: Column, pattern: str) -> Column:
    words = required_words(pattern)
    tests = [text.contains(w) for w in words]
    if [pattern] != words:
        tests.append(text.rlike(pattern.replace(r"\s", f"[{BLANK}]")))
    return reduce(and_, tests)


def _sum(columns: list[Column]) -> Column:
    return reduce(add, columns, F.lit(0)).cast("int")


def _found_terms(lowered: Column, lexicon: Lexicon) -> Column:
    """Distinct one-word terms of the lexicon that occur in the text."""
    listed = _single(set(lexicon.positive) | set(lexicon.negative))
    return F.array_intersect(tokens(lowered, lowercase=False), _strings(listed))


def _term_score(lowered: Column, found: Column, weights: dict[str, int]) -> Column:
    single = _single(weights)
    parts = [F.size(F.array_intersect(found, _strings(single)))]
    parts += [F.array_contains(found, t).cast("int") * (weights[t] - 1) for t in single if weights[t] > 1]
    phrases = [t for t in weights if t not in single]
    parts += [_has_phrase(lowered, t).cast("int") * weights[t] for t in phrases]
    return _sum(parts)


def score_texts(df: DataFrame, text: str = "text", lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Add the scores of every text and the sentiment they give.

    ``positive_terms``/``negative_terms`` count listed terms present on word boundaries (once
    each, times weight), ``positive_patterns``/``negative_patterns`` the phrase patterns present
    times their weight, ``positive``/``negative`` their sums. ``rule_sentiment`` is Positive only
    if positive outweighs negative. The text is lower-cased and cut into words once.
    """
    lowered, found = F.col("_lowered"), F.col("_found")
    scored = df.withColumn("_lowered", F.lower(F.coalesce(F.col(text), F.lit("")))).withColumn(
        "_found", _found_terms(lowered, lexicon)
    )
    scores = {}
    for polarity in POLARITIES:
        scores[f"{polarity}_terms"] = _term_score(lowered, found, lexicon.weights(polarity))
        scores[f"{polarity}_patterns"] = _sum(
            [
                _has_pattern(lowered, p).cast("int") * lexicon.pattern_weight
                for p in lexicon.patterns(polarity)
            ]
        )
    scored = scored.withColumns(scores).withColumns(
        {p: F.col(f"{p}_terms") + F.col(f"{p}_patterns") for p in POLARITIES}
    )
    return scored.withColumn("rule_sentiment", sentiment_of("positive", "negative")).drop("_lowered", "_found")


def sentiment_of(positive: Column | str, negative: Column | str, margin: int = 0) -> Column:
    """Positive if the positive score exceeds the negative by more than ``margin``."""
    ahead = as_column(positive) - as_column(negative) > margin
    return F.when(ahead, F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE))


def model_or_rule(model_sentiment: Column | str, rule_sentiment: Column | str = "rule_sentiment") -> Column:
    """The model's answer where it gave one, else the rules'."""
    return F.coalesce(as_column(model_sentiment), as_column(rule_sentiment))


def scorer_used(model_sentiment: Column | str, model_name: str = "Model", rule_name: str = "Rule-Based") -> Column:
    return F.when(as_column(model_sentiment).isNotNull(), F.lit(model_name)).otherwise(F.lit(rule_name))


def matched_terms(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Array of the distinct lexicon terms, one word or several, present in the text."""
    lowered = F.lower(F.coalesce(as_column(text), F.lit("")))
    terms = set(lexicon.positive) | set(lexicon.negative)
    phrases = sorted(terms - set(_single(terms)))
    present = F.array_compact(F.array(*[F.when(_has_phrase(lowered, p), F.lit(p)) for p in phrases]))
    return F.concat(_found_terms(lowered, lexicon), present)
