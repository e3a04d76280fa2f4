import itertools
import math
import random

import numpy as np
import pytest

from voxtally.llm import circulant_minhash as op


def brute(rows):
    """doc_id -> (set size, smallest doc_id reachable), over all pairs."""
    sets = {i: op.exact_set(text) for i, text in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in sets}


def edited(rng, words, rate):
    return [rng.choice("mno") + str(rng.random()) if rng.random() < rate else w for w in words]


def test_against_all_pairs(documents):
    rng = random.Random(5)
    rows, bases = [], [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 120))] for _ in range(12)]
    for i in range(240):
        base = rng.choice(bases)
        rows.append((i, " ".join(edited(rng, base, rng.choice((0, 0.01, 0.03, 0.06))))))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "ONE\ttwo"), (1005, "one two three")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.near_duplicates(documents(rows)).collect()}
    assert got == brute(rows)


def test_ids_nulls_and_repeats(documents):
    text = "a b c d e f g h"
    rows = [(7, text), (7, text), (3, text), (None, text), (None, "p q r s t u"), (9, "x y"), (9, "z w")]
    got = sorted(
        ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op.near_duplicates(documents(rows)).collect()), key=str
    )
    assert got == sorted(
        [(7, 4, 3, False), (7, 4, 3, False), (3, 4, 3, True), (None, 4, 3, False), (None, 2, None, True), (9, 1, 9, True), (9, 1, 9, True)],
        key=str,
    )


def test_empty_table(documents):
    assert op.near_duplicates(documents([])).count() == 0


def test_open_buckets_go_on_in_rounds(documents, monkeypatch):
    """With one leader a round the components are the same."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rng, base, rng.choice((0.02, 0.05, 0.08))))) for i in range(60)]
    monkeypatch.setattr(op, "LEADERS", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.near_duplicates(documents(rows)).collect()}
    assert got == brute(rows)


def test_few_unlinked_pairs_are_compared_by_text(documents, monkeypatch):
    """In a group of copies that lack different parts most pairs are just below the bound."""
    rng, base, rows = random.Random(4), [f"w{i}" for i in range(300)], []
    for i in range(40):
        gone = {k for start in rng.sample(range(290), 4) for k in range(start, start + 9)}
        rows.append((i, " ".join(w for k, w in enumerate(base) if k not in gone)))
    compared, verify = [], op.verify
    monkeypatch.setattr(op, "verify", lambda pairs, texts: (compared.append(pairs.count()), verify(pairs, texts))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.near_duplicates(documents(rows)).collect()}
    assert got == brute(rows)
    sets = [op.exact_set(text) for _, text in rows]
    linked = sum(100 * len(a & b) >= 75 * len(a | b) for a, b in itertools.combinations(sets, 2))
    assert sum(compared) < 1.2 * linked + 40  # of 780


def test_cells_rule_out_no_link():
    """What two maps allow is never less than what the sets share, and near it."""
    rng = np.random.default_rng(11)
    for size in (1, 5, 60, 400, 3000, 20_000):
        common = rng.integers(0, 2**63, size, np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, size // 5, np.uint64)])) for _ in "ab")
        maps = [op.cells(x).view(np.uint64) for x in (a, b)]
        beside = [len(x) - int(np.bitwise_count(m).sum()) for x, m in zip((a, b), maps, strict=True)]
        allowed = int(np.bitwise_count(maps[0] & maps[1]).sum()) + min(beside)
        shared = len(np.intersect1d(a, b))
        assert allowed >= shared
        if size <= 400:
            assert allowed <= 1.03 * shared + 1


def test_keep_first_keeps_columns(documents):
    docs = documents([(2, "a b c d e f"), (1, "a b c d e f"), (5, None), (None, "a b c d e f")])
    kept = op.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5"]


def test_keep_first_keeps_one_row_of_a_group(documents):
    """Whatever ids its rows have or lack, and whatever the extra columns are called."""
    text, other, alone = "a b c d e f", "p q r s t u v", "only here and nowhere else at all"
    rows = [(None, text), (None, text), (5, text), (5, text), (None, other), (None, other), (None, alone), (None, ""), (None, "")]
    docs = documents(rows).selectExpr("*", "7 as __id", "'p' as __print", "'q' as ROW_ID", "1.5 as row_print", "2 as group_id")
    kept = op.keep_first(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("5", text), ("None", other), ("None", alone), ("None", ""), ("None", "")])
    assert {(r["__id"], r["__print"], r["ROW_ID"], float(r["row_print"]), r["group_id"]) for r in got} == {(7, "p", "q", 1.5, 2)}
    assert op.keep_first(documents([])).count() == 0


def test_a_very_long_text(documents):
    words = [f"w{i}" for i in range(300_000)]
    changed = [*words[:-2000], *(f"x{i}" for i in range(2000))]
    rows = [(4, " ".join(words)), (2, " ".join(changed)), (9, " ".join(words[:100_000])), (8, "y" * 500_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.near_duplicates(documents(rows)).collect()}
    assert got == {4: (299_996, 2), 2: (299_996, 2), 9: (99_996, 9), 8: (1, 8)}


def test_sketches_lose_next_to_no_link():
    """100,000 lone pairs of similarity 0.75: the binomial tail allows less than one to be ruled out."""
    tail = sum(math.comb(op.SKETCH, k) * 0.125**k * 0.875 ** (op.SKETCH - k) for k in range(op.DIFFERENT + 1, op.SKETCH + 1))
    assert tail < 1e-6
    agree = np.random.default_rng(7).binomial(op.SKETCH, 0.125, 100_000)
    assert (agree > op.DIFFERENT).sum() <= 1


@pytest.mark.parametrize("similarity", [0.3, 0.75])
def test_signature_estimates_similarity(similarity):
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**63, round(400 * similarity), np.uint64)
    sides = [np.unique(np.concatenate([common, rng.integers(0, 2**63, (400 - len(common)) // 2, np.uint64)])) for _ in "ab"]
    a, b = (op.signature(x, op.SKETCH) for x in sides)
    true = len(common) / len(np.union1d(*sides))
    assert abs((a == b).mean() - true) < 0.06
    bits = sum((int(x) & 1) == (int(y) & 1) for x, y in zip(a, b, strict=True))
    assert sum((int(x) ^ int(y)).bit_count() for x, y in zip(op.sketch(a).view(np.uint64), op.sketch(b).view(np.uint64), strict=True)) == op.SKETCH - bits


def test_coordinates_are_circular_shifts():
    scatter, shifts = op.permutations()
    around = shifts[:, 0]
    hashes = np.array([12345678901234567], np.uint64)
    place = int(scatter[int(hashes[0]) & (len(around) - 1)])
    assert op.signature(hashes).tolist() == [int(around[(place + k) % len(around)]) for k in range(op.BANDS * op.ROWS)]
