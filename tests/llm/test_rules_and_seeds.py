import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxtally.llm import line_rules, spaced_seeds


def repeated(words):
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)})


def test_repeated_words_by_counting():
    rng = random.Random(3)
    texts = [[*map(str.encode, rng.choices("ab", k=rng.randint(0, 60)))] for _ in range(300)]
    assert line_rules.repeated_words(texts) == [repeated(x) for x in texts]
    assert line_rules.repeated_words([]) == [] and line_rules.repeated_words([[]]) == [0]


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("A sentence, as usual.", None),
        ('He said "no."', None),
        ("no mark at all", "punctuation"),
        ("of%%% and*** the### x.", "punctuation"),
        ("home. | news | faq | x.", "navigation"),
        ("Home. Next.", "navigation"),
        ("Please read our Privacy Policy here.", "boilerplate"),
    ],
)
def test_line_rules(line, rule):
    assert line_rules.failed_rule(line, len(line.split())) == rule


CLEAN = {
    "hi": "भारत की राजधानी नई दिल्ली में आज सुबह से हल्की बारिश हो रही है और सड़कों पर पानी भर गया है। "
    "लोगों को अपने काम पर पहुँचने में काफी देर लगी।",
    "bn": "আজ সকালে শহরের সব রাস্তায় অনেক মানুষ বের হয়েছিল কারণ নতুন বছরের প্রথম দিন ছিল এবং সবাই আনন্দে গান গাইছিল।",
    "ar": "هل تعرف أن المدينة القديمة تقع على ضفة النهر، وأن الناس كانوا يأتون إليها من كل مكان لشراء الكتب والقماش والتوابل؟",
    "ur": "آج صبح شہر میں بارش ہوئی اور بہت سے لوگ اپنے گھروں سے باہر نہیں نکلے کیونکہ سڑکوں پر پانی جمع ہو گیا تھا۔",
    "th": "วันนี้ อากาศ ดี มาก ผู้คน ออก ไป เดิน เล่น ที่ สวน ใหญ่ ใน เมือง และ เด็ก ๆ เล่น น้ำ อย่าง สนุกสนาน กับ เพื่อน",
    "am": "ዛሬ ጠዋት በከተማው ውስጥ ብዙ ሰዎች ወደ ገበያ ሄዱ ምክንያቱም ነገ በዓል ነው እና ሁሉም ቤተሰብ አብሮ ምግብ ይበላል ሰላም ለሁሉም ሰው።",
    "my": "ယနေ့ နံနက် တွင် မြို့ ထဲ ၌ လူ များ စွာ ဈေး သို့ သွား ကြ သည် နက်ဖြန် သည် ပွဲတော် နေ့ ဖြစ် သော ကြောင့် တည်း။",
}


@pytest.mark.parametrize("lang", sorted(CLEAN))
def test_clean_texts_of_other_scripts(lang):
    found = line_rules.judge([CLEAN[lang]])[0]
    assert found["kept"] and found["n_failed_lines"] == 0


@pytest.mark.parametrize("line", ["यह एक शीर्षक है", "هذا عنوان بلا علامة", "วันนี้ ☃☃☃☃ ★★★★", "ก only latin words here", "मेनू ★★★★ है।"])
def test_other_scripts_still_fail(line):
    assert line_rules.failed_rule(line, len(line.split())) == "punctuation"


def test_thai_line_without_spaces():
    assert line_rules.failed_rule("ผู้คนออกไปเดินเล่นที่สวนใหญ่ในเมือง และเด็กๆเล่นน้ำอย่างสนุกสนาน", 2) is None


def test_verdicts(documents):
    good = "These words are all different and make one sentence of some length, as people write it every day here. It ends now."
    rows = [(1, good), (2, good + "\n" + "menu | of | a | site\n" * 1), (3, ("no mark here " * 2).strip() + " x1 x2\n" + good[:0] + " ".join(f"w{i}" for i in range(30)))]
    rows += [(4, None), (5, ""), (None, good), (6, good + "\n" + good), (7, "a b c d e f g h " * 40), (7, "a b c d e f g h " * 40)]
    docs = documents(rows)
    found = line_rules.apply_rules(docs, clean_text=True).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert [got[i].kept for i in (1, 2, 3, 4, 5, 6, 7, None)] == [True, True, False, False, False, False, False, True]
    assert got[2].clean_text == good + "\n" and got[2].n_failed_lines == 1 and got[6].n_dup_lines == 1
    assert not got[3].base_failed and got[7].base_failed and got[7].n_repeat_words == 320
    kept = line_rules.keep_good(docs)
    assert kept.schema == docs.schema
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == {1, 2, None} and rows[2].text == good + "\n" and rows[2].n_chars == len(good) + 1
    assert rows[1].text == good and rows[1].n_chars == len(good) and rows[1].path == "x"
    assert line_rules.apply_rules(documents([])).count() == 0


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    """All offsets at which a masked stretch agrees, and the best window that holds it."""
    out = {}
    for doc_id, text in docs:
        doc = words_of(text)
        for item_id, item in ((i, words_of(t)) for i, t in items):
            width = min(spaced_seeds.WINDOW, len(item))
            for mask in spaced_seeds.MASKS:
                for p in range(len(doc) - len(mask) + 1):
                    for q in range(len(item) - len(mask) + 1):
                        if all(doc[p + k] == item[q + k] for k, used in enumerate(mask) if used == "1"):
                            for s in range(len(item) - width + 1):
                                if s <= q and s + width >= q + len(mask):
                                    n = sum(0 <= p - q + k < len(doc) and doc[p - q + k] == item[k] for k in range(s, s + width))
                                    if 100 * n >= 80 * width:
                                        key = doc_id, item_id
                                        out[key] = max(out.get(key, 0), n)
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_overlaps_by_brute_force(spark, documents, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", 0)
    rng = random.Random(6)
    items = [(i, " ".join(f"t{rng.randint(0, 60)}" for _ in range(rng.choice((5, 8, 12, 30))))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "the the the the the the the the the")]
    docs = [(100, None), (101, ""), (102, "the " * 30), (None, items[2][1] + " " + items[3][1])]
    for i in range(40):
        words = rng.choice(items[:12])[1].split()
        words = [f"u{rng.random()}"[:6] if rng.random() < rng.choice((0, 0.1, 0.25)) else w for w in words]
        docs.append((i, f"before, {' '.join(words).title()}! After it " + " ".join(f"t{rng.randint(0, 60)}" for _ in range(15))))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_agreed for r in spaced_seeds.overlaps(documents(docs).drop("seed"), benchmark).collect()}
    assert got == brute(docs, items) and got


@pytest.mark.parametrize("n", range(5, 17))
def test_masks_hit_every_placing(n):
    masks = spaced_seeds.LONG_MASKS if n >= spaced_seeds.LONG else spaced_seeds.MASKS
    for k in range(n * (100 - spaced_seeds.MIN_AGREED) // 100 + 1):
        for gone in itertools.combinations(range(n), k):
            assert any(
                all(flag == "0" or p + j not in gone for j, flag in enumerate(mask))
                for mask in masks
                for p in range(n - len(mask) + 1)
            ), (n, gone)


@pytest.mark.parametrize("broadcast", [True, False])
def test_all_windows_without_seeds(spark, documents, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", 0)
    rng = random.Random(8)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (1, 2, 3, 4, 5, 6, 7, 8, 10, 15, 16, 20)]
    docs = []
    for n, text in items:
        for k in range(n // 5 + 2):
            for _ in range(8):
                words = text.split()
                for gone in rng.sample(range(n), min(k, n)):
                    words[gone] = "other"
                docs.append((len(docs), "before " + " ".join(words) + " after"))
    docs.append((len(docs), "before i16x0 i16x1 i16x2 i16x3 i16x4 i16x5 i16x6 a i16x8 b i16x10 c i16x12 i16x13 i16x14 i16x15"))
    want = {}
    for doc_id, text in docs:
        doc = words_of(text)
        for item_id, item in ((i, words_of(t)) for i, t in items):
            width = min(spaced_seeds.WINDOW, len(item))
            for s in range(len(item) - width + 1):
                for at in range(1 - width, len(doc)):
                    n = sum(0 <= at + k < len(doc) and doc[at + k] == item[s + k] for k in range(width))
                    if 100 * n >= spaced_seeds.MIN_AGREED * width:
                        want[doc_id, item_id] = max(want.get((doc_id, item_id), 0), n)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_agreed for r in spaced_seeds.overlaps(documents(docs, extra=False), benchmark).collect()}
    assert got == want and {i for _, i in got} == {i for i, _ in items}


def test_without_overlaps(spark, documents):
    item = "one two three four five six seven eight nine ten"
    docs = documents([(1, "x " + item), (2, "clean text"), (2, item), (None, item), (None, "clean too"), (3, None)])
    kept = spaced_seeds.without_overlaps(docs, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("2", "clean text"), ("3", "None"), ("None", "clean too")]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert spaced_seeds.without_overlaps(docs, empty).count() == 6


def test_short_items_and_odd_columns_drop_nothing(spark, documents):
    docs = documents([(1, "yes we can"), (2, "they said yes to it"), (3, "a b c d")])
    docs = docs.selectExpr("*", "5 as __id", "6 as __print", "'i' as Item_Id", "'r' as row_id", "'s' as ROW_PRINT")
    items = spark.createDataFrame([(0, "Yes"), (1, "yes we can"), (2, "a b c d"), (2, "other words of one id")], "item_id long, text string")
    kept = spaced_seeds.without_overlaps(docs, items)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(r.doc_id for r in got) == [1, 2]
    assert {(r["__id"], r["__print"], r["Item_Id"], r["row_id"], r["ROW_PRINT"]) for r in got} == {(5, 6, "i", "r", "s")}
    found = {(r.doc_id, r.item_id) for r in spaced_seeds.overlaps(docs, items).collect()}
    assert found == {(1, 0), (1, 1), (2, 0), (3, 2)}


def test_many_seeds_of_long_items_are_broadcast_without_their_words(spark, documents):
    words = [f"w{i}" for i in range(3000)]
    items = spark.createDataFrame([(i, " ".join(words[i:] + words[:i])) for i in range(40)], "item_id long, text string")
    docs = documents([(1, " ".join(words[100:140])), (2, "nothing of the kind")])
    got = spaced_seeds.overlaps(docs, items)
    assert {r.doc_id for r in got.collect()} == {1}
    rows = items.select("item_id", spaced_seeds.word_hashes("text").alias("item_words")).withColumn("item", F.col("item_id"))
    assert spaced_seeds.benchmark_seeds(rows, spaced_seeds.LONG_MASKS).columns == ["seed", "item", "item_place", "span"]
