import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from voxtally.llm import common, pieces, segment_bpe, token_counts, token_files
from voxtally.llm.queries import JSON_TOKENIZER, MULTI_RANKS, PATTERN, RANKS

PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "'s", "'ll", "1", "22", "!", "###", "\x1c", "\x85", "漢字", "😀",
         "<|endoftext|>", "\x00", "the", " the", "A", "x" * 70, "ab" * 60, "नि", " "]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    odd = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(1500)]
    return [*odd, "etaoin" * 3000, "word " * 20000, " ", "\n", "\n x"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pieces.read_ranks(MULTI_RANKS), special_tokens={})


def test_cuts_join_to_the_text(texts):
    assert all("".join(pieces.cuts(x)) == x for x in texts)


def test_segment_tree_encodes_as_the_library(texts, reference):
    tool = segment_bpe.encoder(MULTI_RANKS, PATTERN)
    got = list(tool.encode(texts))
    assert got == [reference.encode_ordinary(x) for x in texts]
    assert [tool.decode(ids) for ids in got] == [x.encode() for x in texts]


def test_one_tree_and_many_trees_agree():
    tool, rng = segment_bpe.encoder(MULTI_RANKS, PATTERN), random.Random(3)
    found = [bytes(rng.choices(b"etaonrish ", k=rng.randint(2, 64))) for _ in range(400)]
    for leaves in (64, 128):
        assert tool.merge_many(found, leaves) == [tuple(tool.merge_one(x)) for x in found]


def test_ranks_without_a_byte_are_refused():
    with pytest.raises(ValueError, match="without a token"):
        segment_bpe.Encoder({b"a": 0}, PATTERN)


def test_encode_documents(spark, documents, texts, reference):
    rows = [(i, x) for i, x in enumerate(texts) if "\x00" not in x][:200] + [(500, None), (None, "twice"), (None, "twice")]
    got = segment_bpe.encode_documents(documents(rows), MULTI_RANKS, PATTERN, keep_ids=True).collect()
    want = []
    for i, x in rows:
        ids = reference.encode_ordinary(x or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256((x or "").encode()).hexdigest(), ids))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_token_files_round_trip(spark, documents, texts):
    rows = [(1000 - i, x) for i, x in enumerate(texts[-80:])] + [(-4, None), (2, ""), (None, "no id")]
    rows.append((3, "same")), rows.append((3, "same"))
    rows += [(i, f"hello {special} world") for i, special in enumerate(("<|endoftext|>", "<|endoftext|><|endoftext|>"), 2000)]
    tool = Tokenizer.from_file(JSON_TOKENIZER)
    got = token_files.token_file_round_trip(spark, documents(rows), JSON_TOKENIZER, PATTERN).collect()
    start, want = 0, []
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tool.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_token_files_of_no_documents(spark, documents):
    assert token_files.token_file_round_trip(spark, documents([]), JSON_TOKENIZER, PATTERN).count() == 0


def test_files_roll_over(spark, documents, tmp_path):
    rows = [(i, f"text number {i} " * (i % 9)) for i in range(60)]
    files = token_files.write_tokens(documents(rows), JSON_TOKENIZER, PATTERN, str(tmp_path / "tokens"), file_ids=50)
    found = files.orderBy("path").collect()
    assert any(r.path.endswith("000001.dac") for r in found) and sum(r.n_docs for r in found) == 60
    assert [r.base for r in found] == list(np.cumsum([0, *(r.n_ids for r in found[:-1])]))
    tool = Tokenizer.from_file(JSON_TOKENIZER)
    start = 0
    for row, (i, text) in zip(token_files.read_tokens(files).orderBy("doc_id").collect(), rows, strict=True):
        ids = [*tool.encode(text, add_special_tokens=False).ids, 0]
        assert tuple(row) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_memories_stay_within_their_bytes():
    """Long texts without spaces, and more distinct words than there is room for."""
    rng = random.Random(6)
    long = ["漢字" * 6000 + str(i) for i in range(30)] + ["x" * 50_000]
    many = [" ".join(str(rng.random()) for _ in range(400)) for _ in range(250)]
    encoder = segment_bpe.Encoder(pieces.read_ranks(MULTI_RANKS), PATTERN)
    counter = token_counts.Counter(token_counts.Automaton(pieces.read_ranks(RANKS)), PATTERN)
    files = token_files.TextEncoder(JSON_TOKENIZER, PATTERN)
    for memory in (encoder.memory, counter.memory, files.memory, files.matches):
        memory.room = 4 << 20
    for text in long + many:
        list(encoder.encode([text])), counter.counts(text), files.encode(text)
    for memory in (encoder.memory, counter.memory, files.memory, files.matches):
        assert memory and memory.used <= memory.room // 2 and max(map(len, memory)) <= pieces.LONGEST
        for part in (memory, memory.old):
            sizes = (len(k) + len(v) * (1 if type(v) is bytes else pieces.NUMBER) for k, v in part.items())
            assert sum(pieces.ENTRY + x for x in sizes) <= memory.room // 2 + 4096


def test_random_access(tmp_path):
    rng = random.Random(2)
    ids = np.array([rng.choice([0, 3, 255, 256, 65535, 65536, 2**31]) for _ in range(3000)], "<u4")
    path = str(tmp_path / "one.dac")
    common.put_file(path, token_files.pack([4, None], np.array([0, 1000, 3000]), ids))
    file = token_files.TokenFile(path)
    assert [file.token(i) for i in range(0, 3000, 11)] == ids[::11].tolist()
    for _ in range(60):
        a, b = sorted(rng.choices(range(3001), k=2))
        assert file.tokens(a, b).tolist() == ids[a:b].tolist()
    assert file.documents(0, 2)[0] == [4, None]


def greedy(word, vocabulary, prefix=b""):
    at = count = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if (prefix if at else b"") + word[at:end] in vocabulary:
                break
        else:
            return 0
        at, count = end, count + 1
    return count


def test_automaton_is_greedy():
    rng = random.Random(2)
    for _ in range(600):
        prefix, vocabulary = rng.choice([b"", b"##"]), set()
        for _ in range(rng.randint(1, 14)):
            token = bytes(rng.choices(b"abc", k=rng.randint(1, 4)))
            vocabulary.add(token if rng.random() < 0.5 else prefix + token)
        automaton = token_counts.Automaton(vocabulary, prefix)
        for _ in range(20):
            word = bytes(rng.choices(b"abc", k=rng.randint(1, 9)))
            assert automaton.length(word) == greedy(word, vocabulary, prefix), (vocabulary, word)


def test_count_tokens(documents, texts):
    vocabulary, split = set(pieces.read_ranks(RANKS)), pieces.splitter(PATTERN)
    rows = [(i, x) for i, x in enumerate(texts[:60])] + [(100, None), (101, ""), (None, "a b"), (7, "a b")]
    want = []
    for i, x in rows:
        words = split(x or "")
        want.append((i, len(words), sum(greedy(w.encode(), vocabulary) for w in words), 0))
    got = token_counts.count_tokens(documents(rows), RANKS, PATTERN).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert public_tokenizers.path("") not in "".join(map(str, got))
