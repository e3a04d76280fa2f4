"""Indexed search against the scan."""

import random

import pytest

from voxtally.operators import browse, search_index
from voxtally.operators.search_index import required_grams

WORDS = ["terima", "KASIH", "luar", "biasa", "gagal", "Total", "aſk", "KKelvin", "İstanbul", "ılık", "straße", "漢字漢字", "naïve", "a.b", "x", "100%"]


@pytest.fixture(scope="module")
def comments(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))) for i in range(3000)]
    rows += [(5000, None), (5001, ""), (5002, "ab"), (5003, "luar\nbiasa"), (5004, "ask ELVIN ISTANBUL"), (5005, "terima " * 9000)]
    return spark.createDataFrame(rows, "comment_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def index(comments, tmp_path_factory):
    return search_index.build_index(comments, str(tmp_path_factory.mktemp("index") / "it"))


QUERIES = [
    "terima kasih", "luar biasa|gagal (total|semua)", "ask", "elvin", "istanbul", "ilik", "漢字漢", "straße", "STRASSE", r"a\.b", "a.b x",
    "gagal?", "gaga(l|x)?", "luar\\s+biasa", "^terima", "biasa$", "to[tx]al", "(?-i)KASIH", "na.ve", "tot{1}al", "tota{0,1}l x", "xx", "",
    "nothing here", "100%", "kasih|x", "kas(ih luar)+", "(terima|gagal) kasih", "[^a]erima", r"\bkasih\b", "luar biasa gagal total",
]


@pytest.mark.parametrize("query", QUERIES)
def test_patterns_equal_the_scan(comments, index, query):
    want = sorted(r.comment_id for r in browse.search(comments, query).select("comment_id").collect())
    assert sorted(r.comment_id for r in index.search(query).collect()) == want


@pytest.mark.parametrize("query", ["Terima Kasih", "a.b", "(", "ask", "istanbul", "KKelvin", "100% x", "ab", "漢字"])
def test_literals_equal_the_scan(comments, index, query):
    want = sorted(r.comment_id for r in browse.search(comments, query, literal=True).select("comment_id").collect())
    assert sorted(r.comment_id for r in index.search(query, literal=True).collect()) == want


def test_required_grams():
    assert required_grams("Terima") == [{"ter", "eri", "rim", "ima"}]
    assert required_grams("abc|xyz") == [{"abc"}, {"xyz"}]
    assert required_grams("abcd?") == [{"abc"}] and required_grams("abc+d") is None
    assert required_grams("ab[cd]efg") == [{"efg"}] and required_grams("abc(d|e)") == [{"abc"}]
    assert required_grams(r"ab\.c") == [{"ab.", "b.c"}] and required_grams(r"abc\d") == [{"abc"}]
    for plain in ("ab", "abc|x", "a.b.c", "(?i)abc", r"\Qabc\E", "(abc)", "äöü", "[a|b]cde", "a{2", r"\x61bc"):
        assert required_grams(plain) is None, plain
    assert required_grams("(abc|", literal=True) == [{"(ab", "abc", "bc|"}]


def test_only_candidates_are_read(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 16).selectExpr("id AS comment_id", "concat('comment number ', hex(id * 7919), if(id = 777, ' needle', '')) AS text")
    index = search_index.build_index(rows, str(tmp_path / "it"))
    found = index.search("needle")
    assert [r.comment_id for r in found.collect()] == [777]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_folder" in plan.split("PartitionFilters", 1)[1]
    assert index.candidates(required_grams("needle")).count() == 1
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "_folder" in line]
    assert scans and all("PushedFilters: [" in line and "_block" in line.split("PushedFilters", 1)[1] for line in scans)
    looked = index.candidates(required_grams("needle"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in looked and "PushedFilters: [In(gram" in looked


def test_blocks_that_are_read_in_parts(spark, comments, index):
    """Small file ranges cut blocks and lists in the middle."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    spark.conf.set(names[0], 2000), spark.conf.set(names[1], 0)
    try:
        assert index.search("terima kasih").count() == browse.search(comments, "terima kasih").count() > 0
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def test_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "comment_id long, text string")
    assert search_index.build_index(empty, str(tmp_path / "it")).search("terima").count() == 0
