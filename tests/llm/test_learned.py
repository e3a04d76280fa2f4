import math
import random
import textwrap
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from voxtally.llm import cotraining, licenses, word_backoff

WORDS = {"aa": ["kala", "maka", "talo", "vesi"], "bb": ["strand", "grund", "hulk", "brust"]}


def prose(rng, lang, n=12):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "a" if lang == "aa" else "st"]) for _ in range(n))


def test_languages_are_learned_and_held_out(documents):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang := rng.choice(["aa", "bb"])), lang) for i in range(150)]
    rows += [(900, None, "aa"), (901, "12 !!", "bb"), (902, "kalamaka", None), (None, "vesi talo", "bb"), (903, "grundhulk " * 3000, None)]
    found = word_backoff.identify(documents(rows)).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r for r in found}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:150])
    assert [got[i].lang_pred for i in (900, 901, 902, None, 903)] == ["und", "und", "aa", "aa", "bb"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in found)


def test_held_out_labels_are_not_learned(documents):
    rows = [(i, "zzz qqq", "cc") for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows += [(i, "kala", "aa") for i in range(300, 330)]
    assert {r.lang_pred for r in word_backoff.identify(documents(rows)).collect()} == {"aa"}


def test_words_are_letters_with_their_marks():
    """Numbers that Python counts among word characters are no letters; marks do not part a word."""
    for text in ("½ ²", "Ⅷ ①", "12 _ ३", "\u0301", ""):
        assert word_backoff.words_of(text) == []
    assert word_backoff.words_of("Die Straße, x²y") == ["die", "straße", "x", "y"]
    assert word_backoff.words_of("हिन्दी में किताब") == ["हिन्दी", "में", "किताब"]
    assert word_backoff.words_of("สวัสดี ภาษาไทย") == ["สวัสดี", "ภาษาไทย"]
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(chr(rng.choice((rng.randint(1, 0x2FF), rng.randint(0x900, 0xD7FF), rng.randint(0x10000, 0x1FFFF)))) for _ in range(60))
        want = regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower())
        known = lambda c: unicodedata.category(c) != "Cn"  # noqa: E731  tables of other ages know other letters
        if all(map(known, text)):
            assert word_backoff.words_of(text) == want


def plain_scores(rows, text):
    """The method restated: counts of words and n-grams by language, longest known n-grams first."""
    langs = sorted({lang for _, _, lang in rows})
    words, grams = Counter(), Counter()
    for _, t, lang in rows:
        for word in regex.findall(r"\p{L}[\p{L}\p{M}]*", t.lower()):
            words[word, lang] += 1
            for n in (1, 2, 3, 4):
                shown = f"^{word}$" if n > 1 else word
                for i in range(len(shown) - n + 1):
                    grams[shown[i : i + n], lang] += 1
    size = {lang: sum(n for (_, x), n in words.items() if x == lang) for lang in langs}

    def table(counts, per_word):
        total = Counter()
        for (item, _), n in counts.items():
            total[item] += n
        kept = {item for item, n in total.items() if n > 1}
        low = 0.5 * (len(kept) + 1)
        return {item: [math.log((counts[item, x] + 0.5) / (per_word * size[x] + low)) for x in langs] for item in kept}

    by_word, by_gram, sums = table(words, 1), table(grams, 4), [0.0] * len(langs)
    for word in regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()):
        found, weight = [by_word[word]] if word in by_word else [], 1.0
        for n in (4, 3, 2, 1):
            if not found:
                shown = f"^{word}$" if n > 1 else word
                found = [by_gram[g] for i in range(len(shown) - n + 1) if (g := shown[i : i + n]) in by_gram]
                weight = 0.4 ** (4 - n)
        for k in range(len(langs)):
            sums[k] += weight * sum(x[k] for x in found) / len(found) if found else 0.0
    shares = [math.exp(x - max(sums)) for x in sums]
    best = max(range(len(langs)), key=lambda k: (shares[k], -k))
    return langs[best], shares[best] / sum(shares)


def test_scores_equal_a_plain_restatement(documents):
    rng = random.Random(8)
    rows = [(i, prose(rng, lang := rng.choice(["aa", "bb"]), rng.randint(1, 9)), lang) for i in range(90)]
    trained = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    asked = [(1000 + i, "".join(rng.choice("abekltsu ") for _ in range(rng.randint(1, 14))) + "a", None) for i in range(40)]
    found = {r.doc_id: (r.lang_pred, r.score) for r in word_backoff.identify(documents(rows + asked)).collect()}
    for doc_id, text, _ in rows + asked:
        lang, score = plain_scores(trained, text)
        assert found[doc_id][1] == pytest.approx(score) and (found[doc_id][0] == lang or score < 0.5 + 1e-9)


def test_nothing_to_learn(documents):
    assert {r.lang_pred for r in word_backoff.identify(documents([(1, "kala"), (2, None)])).collect()} == {"und"}
    assert word_backoff.identify(documents([])).count() == 0


def test_backoff_takes_the_longest_known_grams():
    model = word_backoff.Model(["x", "y"], {"cat": 0}, {"^dog": 1, "o": 2}, np.array([[1.0, 2], [3, 5], [7, 11]]))
    assert model.vector("cat").tolist() == [1, 2]
    assert model.vector("dogs").tolist() == [3, 5]
    assert model.vector("foo") == pytest.approx([7 * 0.4**3, 11 * 0.4**3])
    assert model.vector("xyz").tolist() == [0, 0]


def corpus(rng, n):
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [f"w{rng.randint(0, 300)}" for _ in range(40)]
        text = " ".join(w.upper() + "!!" for w in words) if bad else ". ".join(" ".join(words[k : k + 8]) for k in range(0, 40, 8)) + "."
        source = ("junk" if rng.random() < 0.8 else "site") if bad else ("site" if rng.random() < 0.8 else "junk")
        docs.append((i, text, "en", source, len(text)))
        if rng.random() < 0.6:
            labels.append((i, int(not bad), 0))
    return docs, labels


def test_co_training_finds_bad_documents(spark):
    docs, labels = corpus(random.Random(2), 700)
    odd = [(None, docs[0][1], None, None, None), (9000, None, "en", "site", 0), (9001, "", None, None, None)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", "'x' as label", "1 as view", "2 as meta", "3 as score", "4 as odds")
    model = cotraining.fit(df, spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"))
    found = cotraining.classify(df, model).collect()
    assert len(found) == len(docs) + 3
    good = {i: "!!" not in text for i, text, *_ in docs}
    right = [r.kept == good[r.doc_id] for r in found if r.doc_id in good]
    assert sum(right) > 0.97 * len(right)
    assert all(0 <= r.score <= 1 for r in found)
    again = cotraining.classify(df, model, cotraining.figures(df)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    kept = cotraining.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in found)


def test_all_sure_documents_are_handed_over(spark):
    """However many they are, none is left out; together they weigh as much as the labelled ones."""
    rows = [(i, float(i % 100 - 50) / 5) for i in range(5000)]
    scored = spark.createDataFrame(rows, "doc_id long, odds double").selectExpr("*", "1 as view", "2 as meta")
    got = cotraining._sure(scored, [30, 10_000], 0.5).collect()
    bound = math.log(0.95 / 0.05)
    assert {r.doc_id for r in got} == {i for i, odds in rows if abs(odds + 0.5) >= bound}
    bad = [r for r in got if r.label == 0]
    assert sum(r.weight for r in bad) == pytest.approx(30) and {r.weight for r in got if r.label == 1} == {1.0}


def test_long_repeated_and_disagreeing_rows(spark):
    docs, labels = corpus(random.Random(4), 400)
    docs += [(7000, "long words here. " * 60_000, "en", "site", 1_020_000), docs[0], docs[0]]
    labels += [(docs[1][0], 1, 0), (docs[1][0], 0, 0), (7000, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    found = cotraining.classify(df, cotraining.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert len(found) == len(docs) and len({r.score for r in found if r.doc_id == docs[0][0]}) == 1


def test_rare_bad_labels_are_learned(spark, monkeypatch):
    monkeypatch.setattr(cotraining, "LABELLED", 200)
    rng = random.Random(5)
    docs = []
    for i in range(3000):
        bad = i % 150 == 7
        words = [f"w{rng.randint(0, 300)}" for _ in range(40)]
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        docs.append((i, text, "en", "junk" if bad else "site", len(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 150 != 7), 0) for i in range(3000) if i % 10 != 3], "doc_id long, quality int, toxic int")
    model = cotraining.fit(df, labels)
    assert model.content is not None and model.shift > 1
    found = {r.doc_id: r.kept for r in cotraining.classify(df, model).collect()}
    bad = [i for i in found if i % 150 == 7]
    assert sum(not found[i] for i in bad) >= 0.9 * len(bad)
    assert sum(not kept for kept in found.values()) <= 1.1 * len(bad)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)]])
def test_nothing_learned_keeps_all(spark, documents, labels):
    docs = documents([(1, "a"), (2, None)], extra=False)
    model = cotraining.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert all(r.kept for r in cotraining.classify(docs, model).collect())
    assert cotraining.classify(documents([], extra=False), model).count() == 0


@pytest.fixture(scope="module")
def scanner(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(" ".join(f"w{rng.randint(0, 200)}" for _ in range(12)) + "." for _ in range(4))) for i in range(200)]
    return licenses.fit(spark, spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize(
    ("text", "families"),
    [
        ("Licensed under the Apache License, Version 2.0.", ["Apache"]),
        ("intro\nReleased under the MIT License.\nAll rights reserved.", ["MIT", "Proprietary"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL"]),
        ("w1 w2 w3 w4 " * 60 + "Licensed under CC BY-NC 4.0. " + "w5 w6 " * 60, ["CC-BY-NC"]),
        ("My driving license was under the old table in general.", []),
        (None, []),
        ("", []),
    ],
)
def test_licenses(scanner, text, families):
    assert licenses.scan_text(scanner, text)[0] == families


LONG_NOTICES = [
    (family, text) for family, texts in licenses.TEMPLATES.items() for text in texts if len(text) > 72
]


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
@pytest.mark.parametrize(("family", "notice"), LONG_NOTICES)
def test_wrapped_notices(scanner, family, notice, prefix):
    lines = [prefix + line for line in textwrap.wrap(notice, 72)]
    text = "\n".join(["w1 w2 w3 w4.", prefix.rstrip(), *lines, prefix.rstrip(), "w5 w6."])
    found = licenses.scan_text(scanner, text)
    assert found[0] == [family] and found[3] >= 1 and found[4] == 0


def test_wrapped_notices_among_other_lines(scanner):
    mit, bsd = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["BSD"][2]
    prose = "\n".join("w1 w2 w3 w4 w5 w6 w7 w8." for _ in range(20))
    text = "\n".join([prose, *textwrap.wrap(mit, 72), *textwrap.wrap(bsd, 72), prose])
    assert licenses.scan_text(scanner, text)[0] == ["BSD", "MIT"]
    assert licenses.scan_text(scanner, text.replace("\n", "\r\n"))[0] == ["BSD", "MIT"]


def test_scan_documents(scanner, documents):
    rows = [(1, "Released under the MIT License."), (None, None), (2, ""), (3, "w1 " * 50_000 + "All rights reserved.")]
    got = {r.doc_id: (r.license, r.n_confirmed) for r in licenses.scan(documents(rows), scanner).collect()}
    assert {i: got[i] for i in (1, None, 2)} == {1: ("MIT", 1), None: (None, 0), 2: (None, 0)}
    assert got[3][0] == "Proprietary" and got[3][1] >= 1
    assert licenses.scan(documents([]), scanner).count() == 0


def test_labels_without_documents_teach_nothing(spark, documents):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert cotraining.fit(documents([], extra=False), labels).content is None


def test_a_worker_holds_one_model():
    """The scorer of an earlier model is gone when the next one is loaded, or when a new one is being counted."""
    held = []

    def load():
        held.append(len(word_backoff._scorers))
        return word_backoff.Model(["en"], table=np.zeros((0, 1)))

    first = word_backoff.scorer("first", load)
    assert word_backoff.scorer("first", load) is first
    word_backoff.scorer("second", load)
    assert held == [0, 0]
    assert list(word_backoff._words(iter([]))) == [] and not word_backoff._scorers
