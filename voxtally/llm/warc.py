"""WARC archives: written in parallel, read in parallel by boundary chains.

Writing: one response record a page; pages with a payload of at least 100 bytes that an earlier page (by
id) has too become revisit records of that page, without payload. Each task streams its pages into files
of its own.

Reading: a file is cut into splits. A task looks for the record magic in its splits and emits, for each
candidate, the offset of its successor by the stated length, and where its chain leaves the split. The
magic may also stand inside payloads, so candidates prove nothing. Pointer jumping from each file's
start over the leaving offsets finds the one true entry of each split, in as many rounds as the
logarithm of a file's splits; records are then read from the true entries on. A candidate inside a payload
is not on that chain.

Rows: a null html is an empty payload; a null url leaves the target header out, any other is percent-encoded
where a header needs it. A page without id is never an original and has a null page_id when read back.
Repeated rows (one id, one payload) are all responses. A chain that breaks ends there; ``broken_files`` lists
the files whose chain does not reach the end.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.common import file_store, map_batches, shared_folder, written
from voxtally.session import bounded_broadcast

MAGIC = b"WARC/1.1\r\n"
MIN_REVISIT = 100
FILE_BYTES = 256 << 20
SPLIT_BYTES = 16 << 20
HEADER_BYTES = 4096
DATE = "2024-01-01T00:00:00Z"
URN = "urn:voxtally:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_field = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record if the page refers to another one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, "WARC-Target-URI: " + quote(url, safe="%:/?#[]@!$&'()*+,;=~-._"))
    if refers_to is not None:
        lines[1:1] = [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return MAGIC + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Stream:
    """A file that gets its name when it is whole."""

    def __init__(self, path: str):
        self.path, self.size = path, 0
        self.store, self.name = file_store(path)
        self.store.create_dir(self.name.rsplit("/", 1)[0], recursive=True)
        self.attempt = f"{self.name}.{uuid.uuid4().hex}.attempt"
        self.out = self.store.open_output_stream(self.attempt)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> tuple[str, int]:
        self.out.close()
        self.store.move(self.attempt, self.name)
        return self.path, self.size


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to: the smallest id with an equal payload, null for that page."""
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2("html", 256))
    long = F.octet_length("html") >= MIN_REVISIT
    groups = rows.filter(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = bounded_broadcast(groups.filter("n > 1 and first is not null").select("digest", "first"))
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(repeated, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files; the files written: path, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, out = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = _Stream(f"{folder}/part-{part:06d}-{len(made):06d}.warc")
                payload = row["html"].encode()
                out.write(record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"]))
                if out.size >= file_bytes:
                    made.append(out.close())
                    out = None
        if out is not None:
            made.append(out.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.int64())], ["path", "size"]
        )

    return written(map_batches(with_originals(pages), run, "path string, size long"))


def header_at(file, at: int, size: int) -> tuple[dict[str, str], int] | None:
    """The fields of the record header at an offset and where its block starts; None if there is no header."""
    length = HEADER_BYTES
    while True:
        data = file.read_at(min(length, size - at), at)
        if not data.startswith(MAGIC):
            return None
        place, fields = len(MAGIC), {}
        while (found := _field.match(data, place)) is not None:
            fields.setdefault(found[1].decode("latin-1").lower(), found[2].decode("latin-1"))
            place = found.end()
        if data.startswith(b"\r\n", place):
            return fields, at + place + 2
        if at + len(data) >= size or b"\r\n" in data[place:].removeprefix(b"\r"):
            return None
        length *= 4


def successor(file, at: int, size: int) -> int | None:
    """Where the record at an offset says that the next one starts."""
    head = header_at(file, at, size)
    length = head[0].get("content-length", "") if head else ""
    if not re.fullmatch("[0-9]{1,18}", length):
        return None
    following = head[1] + int(length) + 4
    return following if following <= size else None


def splits(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    cut = files.select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(split_bytes))).alias("begin"))
    cut = cut.filter("size > 0").withColumn("end", F.least(F.col("begin") + split_bytes, "size"))
    return cut.repartition(max(1, cut.count()), "path", "begin")


def candidates(cut: DataFrame) -> DataFrame:
    """Per magic in a split: path, offset, successor, and ``leaves``: where its chain leaves the split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                begin, end, size = row["begin"], row["end"], row["size"]
                store, name = file_store(row["path"])
                with store.open_input_file(name) as file:
                    data = file.read_at(min(end + len(MAGIC) - 1, size) - begin, begin)
                    found = [begin + m.start() for m in re.finditer(re.escape(MAGIC), data)]
                    chain = {at: successor(file, at, size) for at in found}
                leaves: dict[int, int | None] = {}
                for at in reversed(found):
                    following = chain[at]
                    leaves[at] = leaves.get(following) if following is not None and following < end else following
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["path"]] * len(found), pa.string()),
                        pa.array(found, pa.int64()),
                        pa.array([chain[x] for x in found], pa.int64()),
                        pa.array([leaves[x] for x in found], pa.int64()),
                    ],
                    ["path", "offset", "successor", "leaves"],
                )

    return map_batches(cut.select("path", "size", "begin", "end"), run, "path string, offset long, successor long, leaves long")


def reached(edges: DataFrame) -> DataFrame:
    """(path, offset) of the entries reachable from each file's start, by pointer jumping over ``leaves``.

    After round k the set holds all entries within 2^k jumps, and a jump spans 2^k splits.
    """
    targets = edges.select("path", F.col("leaves").alias("offset")).filter("offset is not null").distinct()
    entered = edges.join(targets, ["path", "offset"], "left_semi").unionByName(edges.filter("offset = 0"))
    jumps = written(entered.select("path", "offset", F.col("leaves").alias("to")))
    found = jumps.filter("offset = 0").select("path", "offset")
    while True:
        step = found.join(jumps, ["path", "offset"]).select("path", F.col("to").alias("offset")).filter("offset is not null")
        further = jumps.select("path", F.col("offset").alias("to"), F.col("to").alias("beyond"))
        found = written(found.union(step).distinct())
        jumps = written(jumps.join(further, ["path", "to"]).select("path", "offset", F.col("beyond").alias("to")))
        if jumps.isEmpty():
            return found


def records(cut: DataFrame, entries: DataFrame, split_bytes: int) -> DataFrame:
    """The records from the true entries of the splits on, parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                store, name = file_store(row["path"])
                with store.open_input_file(name) as file:
                    at = row["offset"]
                    while at is not None and at < row["end"]:
                        head = header_at(file, at, row["size"])
                        if head is None:
                            break
                        fields, start = head
                        block = file.read_at(int(fields["content-length"]), start)
                        rows.append(_parsed(row["path"], at, fields, block))
                        at = successor(file, at, row["size"])
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = [("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string())]
    kinds += [("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())]
    schema = pa.schema(kinds + [("payload_digest", pa.string())])
    split = (F.col("offset") - F.col("offset") % split_bytes).alias("begin")
    inside = cut.join(entries.select("path", "offset", split), ["path", "begin"])
    names = "path string, offset long, page_id long, url string, record_type string, refers_to long, "
    return map_batches(
        inside.select("path", "size", "end", "offset"), run, names + "payload_bytes long, payload_digest string"
    )


def _parsed(path: str, at: int, fields: dict[str, str], block: bytes) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    if kind == "revisit":
        stated = re.search(rb"(?mi)^Content-Length:[ ]*([0-9]+)", head)
        size, digest = int(stated[1]), fields["warc-payload-digest"].partition(":")[2]
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    of = lambda name: int(x) if (x := fields.get(name, "").strip("<>").removeprefix(URN)) else None
    return {
        "path": path,
        "offset": at,
        "page_id": of("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": of("warc-refers-to"),
        "payload_bytes": size,
        "payload_digest": digest,
    }


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of WARC files (path, size) that ``write_archives`` made."""
    cut = splits(files, split_bytes)
    edges = written(candidates(cut))
    return records(cut, reached(edges), split_bytes)


def broken_files(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The files whose chain of records does not reach the end."""
    entries = reached(written(candidates(splits(files, split_bytes))))
    return files.filter("size > 0").join(
        entries.withColumnRenamed("offset", "size"), ["path", "size"], "left_anti"
    )


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages under the shared folder and read the archives back."""
    return read_archives(write_archives(pages, shared_folder(spark, "warc")))
