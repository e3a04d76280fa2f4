"""Token counts by a linear longest-match automaton.

Greedy word pieces (the longest token at each place) are counted without building them: a vocabulary
trie has at each node a failure link, where matching goes on when the trie has no child for the next
symbol, and the number of tokens that are complete once the link is taken. A word of n symbols takes
at most 2n steps.

With a ``prefix`` (such as ``##``) tokens that go on inside a word carry it, and first tokens do not; without one
every token may stand anywhere. A word that the vocabulary cannot cover counts as one unknown token.

Rows: a null or empty text has no words and no tokens. Repeated rows give equal results. Texts of any length are
counted whole, in time that grows with their length. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm import pieces
from voxtally.llm.common import map_batches

_loaded: dict[tuple[str, str], Counter] = {}


class Automaton:
    """The trie over byte strings with its links and counts."""

    def __init__(self, vocabulary: Iterable[bytes], prefix: bytes = b""):
        self.child: dict[int, int] = {}
        self.parent, self.symbol, self.complete = [-1], [0], [False]
        self.root = 0
        self.inner = self._path(0, prefix)
        for token in vocabulary:
            if token and token != prefix:
                self.complete[self._path(0, token)] = True
        self._link()

    def _path(self, node: int, text: bytes) -> int:
        for byte in text:
            key = node << 8 | byte
            if key not in self.child:
                self.child[key] = len(self.parent)
                self.parent.append(node), self.symbol.append(byte), self.complete.append(False)
            node = self.child[key]
        return node

    def _link(self) -> None:
        """Links by length without prefix: a node's link is a shorter one inside a word, found from its parent's."""
        size = len(self.parent)
        self.link: list[int] = [-1] * size
        self.popped: list[int] = [0] * size
        depth = [0] * size
        for node in range(1, size):
            depth[node] = 0 if node == self.inner else depth[self.parent[node]] + 1
        for node in sorted(range(1, size), key=depth.__getitem__):
            if node == self.inner:
                continue
            if self.complete[node]:
                self.link[node], self.popped[node] = self.inner, 1
                continue
            count, at = self.popped[self.parent[node]], self.link[self.parent[node]]
            while at >= 0 and (at << 8 | self.symbol[node]) not in self.child:
                count, at = count + self.popped[at], self.link[at]
            if at >= 0:
                self.link[node], self.popped[node] = self.child[at << 8 | self.symbol[node]], count

    def length(self, word: bytes) -> int:
        """Number of greedy pieces; 0 if the vocabulary cannot cover the word."""
        child, link, popped = self.child, self.link, self.popped
        node, count = self.root, 0
        for byte in word:
            following = child.get(node << 8 | byte)
            while following is None:
                count += popped[node]
                node = link[node]
                if node < 0:
                    return 0
                following = child.get(node << 8 | byte)
            node = following
        while node != self.inner:
            count += popped[node]
            node = link[node]
            if node < 0:
                return 0
        return count


class Counter:
    """Counts of words, tokens and unknown words of texts."""

    def __init__(self, automaton: Automaton, pattern: str):
        self.automaton, self.split, self.memory = automaton, pieces.splitter(pattern), pieces.Memory(self.part_counts)

    def part_counts(self, part: str) -> tuple[int, int, int]:
        lengths = [self.automaton.length(x.encode()) for x in self.split(part)]
        missed = lengths.count(0)
        return len(lengths), sum(lengths) + missed, missed

    def counts(self, text: str | None) -> tuple[int, int, int]:
        memory = self.memory
        words = tokens = unknown = 0
        for part in pieces.cuts(text or ""):
            known = memory[part]
            words += known[0]
            tokens += known[1]
            unknown += known[2]
        return words, tokens, unknown


def counter(path: str, pattern: str) -> Counter:
    """The worker's counter for the tokens of a rank file; it is built once a worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Counter(Automaton(pieces.read_ranks(path)), pattern)
    return _loaded[path, pattern]


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_words (matches of the pattern), n_tokens, n_unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path, pattern)
        for batch in batches:
            counted = [tool.counts(text) for text in batch.column(1).to_pylist()]
            columns = [pa.array([x[i] for x in counted], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, run, "doc_id long, n_words long, n_tokens long, n_unknown long")
