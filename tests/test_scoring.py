import random
import re

import pytest
from pyspark.sql import functions as F

from voxtally.functions.lexicon import DEFAULT_LEXICON, Lexicon, required_words
from voxtally.functions.scoring import matched_terms, model_or_rule, score_texts, scorer_used
from voxtally.operators.words import lexicon_usage


def by_hand(value):
    """The rules restated: a listed term counts once if it stands alone, a pattern twice."""
    low = (value or "").lower()
    out = []
    for terms, patterns in (
        (DEFAULT_LEXICON.positive, DEFAULT_LEXICON.positive_patterns),
        (DEFAULT_LEXICON.negative, DEFAULT_LEXICON.negative_patterns),
    ):
        found = sum(1 for t in terms if re.search(rf"\b{re.escape(t)}\b", low))
        out.append(found + 2 * sum(1 for p in patterns if re.search(p, low)))
    return (*out, "Positive" if out[0] > out[1] else "Negative")


def scores(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = score_texts(frame).orderBy("i").select("positive", "negative", "rule_sentiment").collect()
    return [tuple(r) for r in rows]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("", (0, 0, "Negative")),
        (None, (0, 0, "Negative")),
        ("happy", (2, 0, "Positive")),
        ("gagal", (0, 2, "Negative")),
        ("terima kasih", (3, 0, "Positive")),
        ("luar  biasa", (0, 0, "Negative")),
        ("tidak baik", (1, 3, "Negative")),
        ("good but hard", (1, 1, "Negative")),
        ("goodness", (0, 0, "Negative")),
        ("HAPPY_", (0, 0, "Negative")),
        ("makasih!", (2, 0, "Positive")),
        ("sangat\n\tmantap", (3, 0, "Positive")),
    ],
)
def test_golden_cases(spark, value, expected):
    assert scores(spark, [value]) == [expected]
    assert by_hand(value) == expected


def test_random_texts_equal_the_restated_rules(spark):
    rng = random.Random(11)
    pieces = list(DEFAULT_LEXICON.positive + DEFAULT_LEXICON.negative) + [
        "sangat", "sekali", "aku", "saya", "tidak", "masalah", "total", "besar", "makasih", "mau", "é", "中", "x2", "_",
    ]
    joints = [" ", "  ", ", ", "\n", "", "-", " ", "."]
    texts = ["".join(rng.choice(pieces) + rng.choice(joints) for _ in range(rng.randint(1, 12))) for _ in range(500)]
    assert scores(spark, texts) == [by_hand(t) for t in texts]


def test_terms_are_found_at_the_end_of_a_long_text(spark):
    long = "kata " * 20_000
    assert scores(spark, [long + "luar biasa", long + "gagal  total"]) == [(1, 0, "Positive"), (0, 4, "Negative")]


def test_required_words():
    assert required_words(r"sangat\s+(baik|bagus)") == ["sangat"]
    assert required_words(r"terima\s+kasih") == ["terima", "kasih"]
    assert required_words("makasih") == ["makasih"]
    assert required_words(r"a.*b") == []


def test_own_lexicon(spark):
    lexicon = Lexicon(("syok", "syok"), ("teruk",), (r"best\d+",), (), 5)
    frame = spark.createDataFrame([("syok gila best12, teruk",)], "text string")
    row = score_texts(frame, lexicon=lexicon).first()
    assert (row.positive_terms, row.positive_patterns, row.negative, row.rule_sentiment) == (2, 5, 1, "Positive")


def test_model_answers_before_rules(spark):
    frame = spark.createDataFrame([("Negative", "Positive"), (None, "Positive")], "m string, r string")
    rows = frame.select(model_or_rule("m", "r"), scorer_used("m")).collect()
    assert [tuple(r) for r in rows] == [("Negative", "Model"), ("Positive", "Rule-Based")]


def test_matched_terms_and_usage(spark):
    frame = spark.createDataFrame([("baik baik, tidak  suka. terima kasih",), ("ok",), (None,)], "text string")
    found = [sorted(r[0]) for r in frame.select(matched_terms("text")).collect()]
    assert found == [["baik", "suka", "terima kasih"], ["ok"], []]
    usage = {r.term: (r.weight, r.n_texts) for r in lexicon_usage(frame).collect()}
    assert len(usage) == 102
    assert usage["baik"] == (1, 1) and usage["happy"] == (2, 0) and usage["gagal"] == (2, 0)


def test_scoring_needs_no_python_and_reads_the_text_once(spark):
    plan = score_texts(spark.createDataFrame([("a",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert plan.count("regexp_extract_all") == 1
