"""Token files with directly addressable codes: any token is read without decoding others.

An id is split into 8-bit chunks, the lowest first. Level 0 holds the first chunk of every id, level 1 the
second chunk of those that have one, and so on. Each level has a bitmap that tells which of its chunks go on
in the next level, and a directory of ranks (set bits before each block of 512), so that the place of a
chunk in the next level is one directory entry and one popcount away.

Documents are written in ascending order of id, each followed by an end id; a row without id comes first.
Files hold whole documents and at most about ``FILE_IDS`` ids, so a task needs memory for one file. The
layout (little-endian): magic, number of documents, ids and levels; per level its number of chunks and the
places of chunks, bitmap and directory; then doc ids, null flags, first positions, and the levels.

Rows: a null text is an empty one and has the end id only. Repeated rows are all written. Rows of equal ids (or
without one) stand in the order of their texts' hashes. A document is never split, so a very long one
makes its file as long as it is. An empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtally.llm import pieces
from voxtally.llm.common import file_store, map_batches, put_file, shared_folder, written

MAGIC = b"VXDAC1\0\0"
BLOCK = 512
FILE_IDS = 1 << 22
#: Bytes that a worker may take to remember cuts and the pattern's matches in them: the library is slow on single
#: words, so they are looked up if possible.
CUTS_ROOM, MATCHES_ROOM = 256 << 20, 96 << 20
#: Documents of a file that one step of the reader takes.
READ_DOCS = 4096

_loaded: dict[tuple[str, str], TextEncoder] = {}


class TextEncoder:
    """Ids of texts by a file of the tokenizers library, as little-endian 32-bit numbers.

    Cuts of a text that were met before are looked up; the library's model encodes the other ones. A text that holds
    the string of a token that was added to the file's vocabulary goes to the library whole.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.added = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        self.split = pieces.splitter(pattern)
        self.memory, self.matches = pieces.Memory(self.ids, CUTS_ROOM), pieces.Memory(self.match_ids, MATCHES_ROOM)
        plain = ByteLevel(add_prefix_space=False, use_regex=False)
        # the library's character for each byte, read off valid two-byte and one-byte strings
        self.shown = {}
        for code in range(0x800):
            for byte, char in zip(chr(code).encode(), plain.pre_tokenize_str(chr(code))[0][0], strict=True):
                self.shown[byte] = char
        for code in (0x800, 0x1000, 0x10000, 0x40000, 0x100000, *range(0x1000, 0x10000, 0x1000)):
            if not 0xD000 <= code < 0xE000:
                for byte, char in zip(chr(code).encode(), plain.pre_tokenize_str(chr(code))[0][0], strict=True):
                    self.shown[byte] = char

    def ids(self, part: str) -> bytes:
        """The ids of a cut, from those of the pattern's matches in it, which many cuts share."""
        found = [self.matches[match] for match in self.split(part)]
        return found[0] if len(found) == 1 else b"".join(found)

    def match_ids(self, match: str) -> bytes:
        shown = match.encode().decode("latin-1").translate(self.shown)
        ids = [token.id for token in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if any(token in text for token in self.added):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.memory.__getitem__, pieces.cuts(text)))


def text_encoder(path: str, pattern: str) -> TextEncoder:
    """The worker's encoder for a tokenizer file; it is built once a worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = TextEncoder(path, pattern)
    return _loaded[path, pattern]


def pack(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a file: documents' ids, their first positions (one more for the end), token ids."""
    levels, rest = [], ids.astype("<u4")
    while not levels or len(rest):
        goes_on = rest > 0xFF
        bits = np.packbits(goes_on, bitorder="little")
        blocks = np.add.reduceat(goes_on, np.arange(0, len(rest), BLOCK)) if len(rest) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u4")
        levels.append((rest.astype(np.uint8), bits, ranks))
        rest = rest[goes_on] >> 8
    flags = np.array([x is None for x in doc_ids], np.uint8)
    table = [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), flags.tobytes(), starts.astype("<i8").tobytes()]
    at = len(MAGIC) + 8 * (3 + 4 * len(levels)) + sum(map(len, table))
    head, body = [len(doc_ids), len(ids), len(levels)], []
    for chunks, bits, ranks in levels:
        places = []
        for part in (chunks, bits, ranks):
            places.append(at)
            body.append(part.tobytes())
            at += len(body[-1])
        head += [len(chunks), *places]
    return [MAGIC, np.array(head, "<i8").tobytes(), *table, *body]


class TokenFile:
    """Random access to a token file."""

    def __init__(self, path: str):
        store, name = file_store(path)
        self.file = store.open_input_file(name)
        magic = self._bytes(0, len(MAGIC) + 24)
        if not magic.startswith(MAGIC):
            raise ValueError(f"not a token file: {path}")
        self.n_docs, self.n_ids, n_levels = np.frombuffer(magic, "<i8", 3, len(MAGIC)).tolist()
        self.levels = np.frombuffer(self._bytes(len(magic), 32 * n_levels), "<i8").reshape(n_levels, 4).tolist()
        self.table = len(magic) + 32 * n_levels

    def _bytes(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def close(self) -> None:
        self.file.close()

    def documents(self, first: int, count: int) -> tuple[list[int | None], np.ndarray]:
        """Ids and first positions (one more) of some documents."""
        ids = np.frombuffer(self._bytes(self.table + 8 * first, 8 * count), "<i8").tolist()
        flags = self._bytes(self.table + 8 * self.n_docs + first, count)
        starts = np.frombuffer(self._bytes(self.table + 9 * self.n_docs + 8 * first, 8 * (count + 1)), "<i8")
        return [None if null else x for x, null in zip(ids, flags, strict=True)], starts

    def _rank(self, level: int, place: int) -> int:
        """Set bits of a level's bitmap before a place."""
        _, _, bitmap, directory = self.levels[level]
        block = place // BLOCK
        known = int.from_bytes(self._bytes(directory + 4 * block, 4), "little")
        whole = self._bytes(bitmap + block * BLOCK // 8, (place % BLOCK + 7) // 8)
        return known + (int.from_bytes(whole, "little") & ((1 << place % BLOCK) - 1)).bit_count()

    def token(self, place: int) -> int:
        """The token at a place: a byte, a bit and a rank a level."""
        value = 0
        for level, (_, chunks, bitmap, _) in enumerate(self.levels):
            value |= self._bytes(chunks + place, 1)[0] << 8 * level
            if not self._bytes(bitmap + place // 8, 1)[0] >> place % 8 & 1:
                return value
            place = self._rank(level, place)
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The tokens of a range; of each level only the chunks in question are read."""
        return self._range(0, start, end)

    def _range(self, level: int, start: int, end: int) -> np.ndarray:
        _, chunks, bitmap, _ = self.levels[level]
        out = np.frombuffer(self._bytes(chunks + start, end - start), np.uint8).astype("<u4")
        if end > start and level + 1 < len(self.levels):
            bits = np.frombuffer(self._bytes(bitmap + start // 8, (end + 7) // 8 - start // 8), np.uint8)
            goes_on = np.unpackbits(bits, bitorder="little")[start % 8 : start % 8 + end - start].astype(bool)
            more = int(goes_on.sum())
            if more:
                below = self._rank(level, start)
                out[goes_on] |= self._range(level + 1, below, below + more) << 8
        return out


def write_tokens(
    docs: DataFrame, path: str, pattern: str, folder: str, end_id: int = 0, file_ids: int = FILE_IDS
) -> DataFrame:
    """Write token files of ``docs`` (doc_id, text) and return them: path, n_docs, n_ids, base.

    A file is closed when it holds ``file_ids`` ids or more. ``base`` is the number of ids in the files before. The
    table has a row a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = text_encoder(path, pattern), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        held, sizes, ids, made = 0, [], [], []

        def flush() -> None:
            nonlocal held
            name = f"{folder}/part-{part:06d}-{len(made):06d}.dac"
            starts = np.cumsum([0, *sizes])
            put_file(name, pack(ids, starts, np.frombuffer(b"".join(encoded), "<u4")))
            made.append((name, len(ids), int(starts[-1])))
            held = 0
            sizes.clear(), ids.clear(), encoded.clear()

        encoded: list[bytes] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                encoded.append(tool.encode(text) + end)
                sizes.append(len(encoded[-1]) // 4), ids.append(doc_id)
                held += sizes[-1]
                if held >= file_ids:
                    flush()
        if ids:
            flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in made], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))],
            ["path", "n_docs", "n_ids"],
        )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    in_order = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = written(map_batches(in_order.select("doc_id", "text"), run, "path string, n_docs long, n_ids long"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["path"])
                for first in range(0, file.n_docs, READ_DOCS):
                    doc_ids, starts = file.documents(first, min(READ_DOCS, file.n_docs - first))
                    ids, low = file.tokens(int(starts[0]), int(starts[-1])), int(starts[0])
                    ends = (starts - low).tolist()
                    sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc_ids, pa.int64()),
                            pa.array(starts[:-1] + row["base"], pa.int64()),
                            pa.array(np.diff(starts), pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                file.close()

    dealt = files.repartition(max(1, files.count()), "path")
    return map_batches(dealt.select("path", "base"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Write the documents' tokens under the shared folder and read the files back."""
    return read_tokens(write_tokens(docs, path, pattern, shared_folder(spark, "tokens")))
