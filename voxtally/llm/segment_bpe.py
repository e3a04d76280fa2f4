"""Byte-level BPE: merges found by a segment tree over byte positions, and decoding.

Each match of the splitting pattern is encoded by itself. Leaf i of the tree holds the rank of the pair
that starts at byte i, with i as the tie-break; the root is the leftmost pair of least rank. A merge
changes three leaves (the merged position, the one it swallows, the live neighbour before), each a
point update up to the root. Trees of the same height are kept in one array and merged together.

Rows: a null text encodes as an empty one: no ids. Repeated rows give equal results. Any text round-trips,
as every byte is a token. Work on a text grows with n log n, whatever its words are, and a very long one takes
memory in proportion to its bytes while its batch is worked on. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm import pieces
from voxtally.llm.common import map_batches

NONE = np.int64(1) << np.int64(62)
#: Longer pieces get a tree of their own in plain Python.
SHARED_BYTES = 64
#: Trees merged together.
TOGETHER = 20_000

_loaded: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Encodes pieces of text by a table of ranks, which are the token ids too."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.ranks, self.split, self.memory = ranks, pieces.splitter(pattern), pieces.Memory()
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(len(self.tokens))]
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {
            (left << 32) | right: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None
        }
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of tokens, NONE where there is none."""
        keys = (left << np.int64(32)) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def encode_pieces(self, found: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece."""
        out: list[tuple[int, ...] | None] = [None] * len(found)
        by_height: dict[int, list[int]] = {}
        for i, piece in enumerate(found):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = (whole,)
            elif len(piece) > SHARED_BYTES:
                out[i] = tuple(self.merge_one(piece))
            else:
                by_height.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for leaves, members in by_height.items():
            for start in range(0, len(members), TOGETHER):
                part = members[start : start + TOGETHER]
                for i, ids in zip(part, self.merge_many([found[i] for i in part], leaves), strict=True):
                    out[i] = ids
        return out

    def merge_many(self, found: list[bytes], leaves: int) -> list[tuple[int, ...]]:
        """Merge pieces of at most ``leaves`` bytes, all trees side by side. Column ``leaves`` stands for none."""
        count, width = len(found), leaves + 1
        lengths = np.array([len(x) for x in found])
        padded = np.frombuffer(b"".join(x.ljust(leaves, b"\0") for x in found), np.uint8).reshape(count, leaves)
        place = np.arange(leaves)
        inside = place < lengths[:, None]
        token = np.zeros((count, width), np.int64)
        token[:, :leaves] = self.of_byte[padded]
        after = np.full((count, width), leaves)
        after[:, :leaves] = np.where(place + 1 < lengths[:, None], place + 1, leaves)
        before = np.full((count, width), leaves)
        before[:, 1:leaves] = place[: leaves - 1]
        rank = self.pair_rank(token[:, : leaves - 1].ravel(), token[:, 1:leaves].ravel()).reshape(count, leaves - 1)
        tree = np.full((count, 2 * leaves), NONE)
        held = inside[:, 1:] & (rank != NONE)
        tree[:, leaves : 2 * leaves - 1] = np.where(held, rank * leaves + place[: leaves - 1], NONE)
        size = leaves // 2
        while size:
            tree[:, size : 2 * size] = np.minimum(tree[:, 2 * size : 4 * size : 2], tree[:, 2 * size + 1 : 4 * size : 2])
            size //= 2
        alive = inside.copy()
        token, after, before, tree, live = token.ravel(), after.ravel(), before.ravel(), tree.ravel(), alive.ravel()
        rows = np.arange(count)
        while True:
            least = tree[rows * (2 * leaves) + 1]
            going = least != NONE
            if not going.all():
                rows, least = rows[going], least[going]
            if not len(rows):
                break
            merged, at = np.divmod(least, leaves)
            base, root = rows * width, rows * (2 * leaves)
            swallowed = after[base + at]
            following, previous = after[base + swallowed], before[base + at]
            token[base + at] = merged
            after[base + at] = following
            before[base + following] = at
            live[rows * leaves + swallowed] = False
            tree[root + leaves + swallowed] = NONE
            right = self.pair_rank(merged, token[base + following])
            right = np.where((following < leaves) & (right != NONE), right * leaves + at, NONE)
            tree[root + leaves + at] = right
            has = previous < leaves
            left = self.pair_rank(token[base + previous], merged)
            left = np.where(left != NONE, left * leaves + previous, NONE)
            tree[(root + leaves + previous)[has]] = left[has]
            spots = [at, swallowed, np.where(has, previous, at)]
            nodes = [leaves + x for x in spots]
            while nodes[0][0] > 1:
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    child = root + 2 * x
                    tree[root + x] = np.minimum(tree[child], tree[child + 1])
        token = token.reshape(count, width)[:, :leaves]
        flat, ends = token[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_one(self, piece: bytes) -> list[int]:
        """Merge one long piece."""
        size, ranks, pairs = len(piece), [], self.pairs
        token = [int(self.of_byte[b]) for b in piece]
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        leaves = 1 << (size - 1).bit_length()
        none = int(NONE)
        for i in range(size - 1):
            rank = pairs.get((token[i] << 32) | token[i + 1])
            ranks.append(none if rank is None else rank * leaves + i)
        tree = [none] * leaves + ranks + [none] * (leaves - len(ranks))
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(leaf: int, value: int) -> None:
            i = leaves + leaf
            tree[i] = value
            while i > 1:
                i >>= 1
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    break
                tree[i] = least

        while tree[1] != none:
            merged, at = divmod(tree[1], leaves)
            swallowed = after[at]
            following, previous = after[swallowed], before[at]
            token[at], token[swallowed], after[at] = merged, -1, following
            put(swallowed, none)
            rank = None
            if following < size:
                before[following] = at
                rank = pairs.get((merged << 32) | token[following])
            put(at, none if rank is None else rank * leaves + at)
            if previous >= 0:
                rank = pairs.get((token[previous] << 32) | merged)
                put(previous, none if rank is None else rank * leaves + previous)
        return [x for x in token if x >= 0]

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text."""
        memory, old = self.memory, self.memory.old
        cut = [pieces.cuts(text or "") for text in texts]
        fresh = {x for parts in cut for x in parts if x not in memory}
        known = {x: old[x] for x in fresh if x in old}
        matches = {x: [m.encode() for m in self.split(x)] for x in fresh if x not in known}
        if matches:
            distinct = list(dict.fromkeys(chain.from_iterable(matches.values())))
            ids = dict(zip(distinct, self.encode_pieces(distinct), strict=True))
            for x, found in matches.items():
                known[x] = ids[found[0]] if len(found) == 1 else tuple(chain.from_iterable(ids[m] for m in found))
        memory.update(known)  # for these texts, the long ones too
        for parts in cut:
            yield list(chain.from_iterable(map(memory.__getitem__, parts)))
        for x in known:
            del memory[x]
        for x, found in known.items():
            memory.keep(x, found)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a rank file; it is built once a worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Encoder(pieces.read_ranks(path), pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; the ids too if ``keep_ids``.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the bytes that the ids
    decode to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in batches:
            counts, digests, decoded, kept = [], [], [], []
            for ids in tool.encode(batch.column(1).to_pylist()):
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(tool.names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(tool.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string())]
            columns.append(pa.array(decoded, pa.string()))
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, run, schema + ", ids array<int>" * keep_ids)
