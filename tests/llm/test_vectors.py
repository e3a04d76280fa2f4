"""Hard negatives and clusters against plain restatements."""

import hashlib
import math
import random

import numpy as np
import pytest

from voxtally.llm import bitplane_clusters, kronecker_negatives

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture
def vectors(spark):
    def make(rows):
        df = spark.createDataFrame(rows, VECTORS)
        return df.selectExpr("*", *(f"'x' as `{x}`" for x in ("block", "key", "parts", "planes", "cluster", "score", "hash")))

    return make


def sound(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def whole(vector):
    return [math.floor(256 * float(np.float32(x))) for x in vector]


def random_rows(seed, count, labels=4, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(labels)]
    out = []
    for i in range(count):
        label = 0 if rng.random() < 0.4 else rng.randrange(labels)
        out.append((i, [c + rng.gauss(0, spread) for c in centres[label]], label))
    return out


ODD = [
    (300, None, 1), (301, [0.5] * 64, None), (302, [None] + [0.5] * 63, 1), (303, [float("nan")] * 64, 1),
    (304, [float("inf")] * 64, 2), (305, [0.25] * 63, 0), (306, [], 1), (None, [0.5] * 64, 0), (400, [0.0] * 64, 0),
]


def brute_negatives(rows):
    kept = []
    for vec_id, vector, label in rows:
        if label is not None and sound(vector):
            if vec_id is not None and vec_id % 7 == 0:
                label = (label + 1) % 10
            kept.append((vec_id, whole(vector), label))
    late = lambda x: math.inf if x is None else x
    out = []
    for anchor, a, label in kept:
        if anchor is None or anchor % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v, strict=False)), late(i), other) for i, v, other in kept]
        mine = sorted((s, i) for s, i, other in scored if other == label and i != anchor)[:5]
        for positive, positive_id in mine:
            band = sorted((s, i) for s, i, other in scored if other != label and -30 * positive <= -100 * s <= -90 * positive)
            for rank, (score, negative) in enumerate(band[:10], 1):
                named = [None if x == math.inf else x for x in (anchor, positive_id, rank, negative)]
                out.append((*named, -positive, -score))
    return sorted(out, key=str)


def mined(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r[x] for x in names) for r in kronecker_negatives.mine(df).collect()), key=str)


@pytest.mark.parametrize("blocks", [(2048, 256), (16, 2)])
def test_negatives_against_all_products(vectors, monkeypatch, blocks):
    monkeypatch.setattr(kronecker_negatives, "CANDIDATES", blocks[0])
    monkeypatch.setattr(kronecker_negatives, "ANCHORS", blocks[1])
    rows = random_rows(1, 260) + ODD + [(500 + i, v, 3) for i, (_, v, _) in enumerate(random_rows(1, 30))]
    rows += [(17, rows[17][1], rows[17][2]), (700, rows[3][1], 2), (101, rows[3][1], 2)]
    got = mined(vectors(rows))
    assert got and got == brute_negatives(rows)


def test_negatives_with_ties_and_long_values(vectors):
    rows = [(100 * i, [float(i % 3)] * 64, i % 2) for i in range(1, 12)] + [(i, [1.0] * 64, i % 3) for i in range(1, 40)]
    rows += [(1000 + i, [300.0 + i] * 64, i % 3) for i in range(4)]  # fields of 64 bits
    assert mined(vectors(rows)) == brute_negatives(rows)


def test_negatives_of_few_rows(vectors):
    assert mined(vectors([])) == []
    assert mined(vectors([(100, [1.0] * 64, 1)])) == []
    assert mined(vectors([(100, [], 1), (3, [], 1), (4, [], 2)])) == [(100, 3, 1, 4, 0, 0)]
    with pytest.raises(ValueError, match="56 bits"):
        kronecker_negatives.mine(vectors([(100, [1e9] * 64, 1)]))


def test_packed_scores_are_exact():
    rng = np.random.default_rng(3)
    for size in (1 << 9, 1 << 20):
        values = rng.integers(-size, size, (33, 64))
        shape = kronecker_negatives.Shape(64, int(values.min()), int(values.max()))
        packed = kronecker_negatives.Packed(values.astype("<i4").tobytes(), 33, shape)
        for anchor in values[:5]:
            assert packed.scores(anchor).tolist() == (values @ anchor).tolist()


def brute_clusters(rows, centroids, rounds):
    kept = [(vec_id, whole(v)) for vec_id, v, _ in rows if sound(v) and len(v) == 64]
    first = sorted((vec_id is None, hashlib.sha256(f"2:{vec_id}".encode()).hexdigest(), v) for vec_id, v in kept)
    centres = [v for _, _, v in first[:centroids]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        centres = [
            [sum(column) // len(column) for column in zip(*members, strict=True)] if members else centres[k]
            for k in range(len(centres))
            for members in [[v for (_, v), own in zip(kept, found, strict=True) if own == k]]
        ]
    last = [(vec_id, *near(v)) for vec_id, v in kept]
    total = sum(d for _, d, _ in last)
    out = []
    for vec_id, d, k in last:
        text = ",".join(map(str, centres[k]))
        out.append((vec_id, k, d, sum(x for _, x, j in last if j == k), total, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def clustered(df, **options):
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r[x] for x in names) for r in bitplane_clusters.cluster_vectors(df, **options).collect()), key=str)


def test_clusters_against_plain_rounds(vectors):
    rows = random_rows(2, 220) + ODD + [(5, random_rows(2, 6)[5][1], 1)] * 3
    rows += [(800 + i, [3.0] * 64, 1) for i in range(20)]
    assert clustered(vectors(rows), centroids=9, rounds=5) == brute_clusters(rows, 9, 5)


def test_clusters_of_few_rows(vectors):
    assert clustered(vectors([])) == []
    rows = [(None, [0.5] * 64, 1), (3, [-1.0] * 64, None), (3, [-1.0] * 64, 2), (4, [0.5] * 63, 1)]
    assert clustered(vectors(rows)) == brute_clusters(rows, 40, 5)
    with pytest.raises(ValueError, match="bits"):
        bitplane_clusters.cluster_vectors(vectors([(1, [1e9] * 64, 1), (2, [0.0] * 64, 1)]))


def test_planes_give_exact_distances():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 13, (40, 64))
    planes, lengths = bitplane_clusters.planes_of(values, 13), (values * values).sum(axis=1)
    assert (bitplane_clusters.values_of(planes) == values).all()
    got = bitplane_clusters.distances(planes, lengths, planes[:7], lengths[:7])
    assert (got == ((values[:, None, :] - values[None, :7, :]) ** 2).sum(axis=2)).all()
