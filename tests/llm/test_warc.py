import hashlib
from collections import Counter

import pytest

from voxtally.llm import common, warc

SCHEMA = "page_id long, url string, html string"


def fake():
    """A payload that looks like records."""
    inner = warc.record(99, "http://x", b"q" * 50, "d", None)
    return (inner + warc.MAGIC + b"Content-Length: 7\r\n\r\n" + warc.MAGIC * 3).decode()


def pages(spark):
    bodies = [None, "", "short", None, "dup" * 100 + fake(), "é"]
    rows = [(i, f"http://e/{i} ü\r\nX: y" if i % 7 else None, bodies[i % 6] if i % 6 != 3 else fake() * (i % 5)) for i in range(150)]
    rows += [(None, "u", "dup" * 100 + fake()), (3, "a", fake() * 3), (3, "a", fake() * 3)]
    return rows, spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as path", "1 as size", "2 as digest").repartition(5)


def expected(rows):
    first: dict = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out: Counter = Counter()
    for page_id, _, html in rows:
        payload = (html or "").encode()
        original = first.get(html or "") if len(payload) >= warc.MIN_REVISIT else None
        again = original is not None and original != page_id
        kind = "revisit" if again else "response"
        out[page_id, len(payload), hashlib.sha256(payload).hexdigest(), kind, original if again else None] += 1
    return out


@pytest.mark.parametrize("split_bytes", [700, 1 << 20])
def test_round_trip_with_magic_in_payloads(spark, split_bytes):
    rows, df = pages(spark)
    files = warc.write_archives(df, common.shared_folder(spark, "warc"), file_bytes=3000)
    assert files.count() > 5
    got = warc.read_archives(files, split_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(map(tuple, got.collect())) == expected(rows)
    assert warc.broken_files(files, split_bytes).count() == 0


def test_no_pages(spark):
    assert warc.archive_round_trip(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_broken_chain_is_reported(spark, tmp_path):
    good = warc.record(1, None, b"x" * 500, "d", None)
    path = str(tmp_path / "broken.warc")
    common.put_file(path, [good, good[:200]])
    files = spark.createDataFrame([(path, len(good) + 200)], "path string, size long")
    assert [r.page_id for r in warc.read_archives(files, 300).collect()] == [1]
    assert warc.broken_files(files, 300).count() == 1
